"""Element rows, names and labels of fields, and pages written back with their fixes."""

import time

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_tree_edits import DIRTY

from wardlume.operators import names, remediation, rules
from wardlume.sources import html_writer
from wardlume.sources.html import element_nodes, page_elements, page_nodes, parse_elements
from wardlume.sources.staging import staged

#: Labels that each field gets, None where it has a name or none can be told.
FORMS = [
    ("<form>Name: <input name=a></form>", ["Name"]), ("<form><label>Mail</label> <input></form>", ["Mail"]), ("<label>Mail <input></label>", [None]), ("<label for=x>Mail</label><input id=x>", [None]),
    ("<form>Legal name <input><input></form>", [None, None]), ("<form>First: <input> Last: <input></form>", ["First", "Last"]), ("<fieldset><legend>Address</legend><input></fieldset>", [None]),
    ("<form><h2>Contact</h2>Phone <input></form>", ["Phone"]), ("<form>Please enter your name <input></form>", [None]), ("<form>Name <input type=radio></form>", [None]),
    ("<form>Amount $: <input></form>", ["Amount"]), ("<form>What is it? <input></form>", [None]), ("<form>Section 4 <input></form>", [None]), ("<form>* Town <input type=hidden><input></form>", [None]),
    ("<table><tr><td>Age<td><input></table>", ["Age"]), ("<table><tr><td>Age <select><option>1</select><td><input></table>", ["Age", "Age"]), ("<form><span>Street</span> <textarea>x</textarea></form>", ["Street"]),
    ("<form><label for=q>Other</label><input></form>", [None]), ("<form><input aria-labelledby=zz></form>", [None]), ("<form>Mail <input title=' '></form>", ["Mail"]),
    ("<form>Name <input><input type=submit value=Go></form>", ["Name"]), ("<form>Search <input></form>", [None]), ("<form>a b c d e f g <input></form>", [None]), ("<form>Mail required <input></form>", [None])]
LINKS = [
    ("<a href=x></a>", True), ("<a href=x>t</a>", False), ("<a></a>", False), ("<a href=x><img src=a alt=''></a>", True), ("<a href=x><img src=a></a>", False), ("<a href=x><img alt=A></a>", False), ("<a href=x aria-label=A></a>", False),
    ("<p id=i>T</p><a href=x aria-labelledby='i j'></a>", False), ("<p id=i></p><a href=x aria-labelledby=i></a>", True), ("<a href=x><b aria-label=A></b></a>", False), ("<div aria-hidden=true><a href=x></a></div>", False),
    ("<a href=x hidden></a>", False), ("<a href=x style='visibility: hidden'></a>", False), ("<a href=x role=none></a>", False), ("<a href=x><style>b</style></a>", True), ("<a href=x></a><img alt=B>", True), ("<a href=x><input type=image alt=Go></a>", False)]


def elements_of(spark, pages):
    return staged(parse_elements(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")))


def test_labels_of_fields(spark):
    e = elements_of(spark, [f for f, _ in FORMS])
    fields = names.named_fields(e)
    found = {}
    for r in fields.join(names.derived_labels(e, fields), ["doc_id", "pos"], "left").orderBy("doc_id", "pos").collect():
        found.setdefault(r["doc_id"], []).append(r["label"])
    assert [(f, found[i]) for i, (f, _) in enumerate(FORMS)] == FORMS


def test_links_without_a_name(spark):
    e = elements_of(spark, [x for x, _ in LINKS])
    found = {r["doc_id"] for r in names.nameless_links(e).collect()}
    assert [(x, i in found) for i, (x, _) in enumerate(LINKS)] == LINKS


def test_counters_of_a_page(spark):
    page = """<iframe src=a></iframe><iframe title=T></iframe><iframe width=1></iframe><iframe style="display: none"></iframe><button aria-label="Close it">close</button><button aria-label=Other>Close</button>
    <b tabindex=2></b><b tabindex=0></b><b tabindex=-1></b><input type=email><input name=user_email autocomplete=email><input name=q>"""
    got = names.page_counters(elements_of(spark, [page, "", None])).orderBy("doc_id").collect()
    assert got[0].asDict() == {"doc_id": 0, "inputs_missing_autocomplete": 1, "positive_tabindex_count": 1, "iframes_missing_title": 1, "label_in_name_mismatches": 1, "form_fields_total": 3,
                               "form_fields_unlabeled": 3, "form_fields_derivable": 0}
    assert all(v == 0 for r in got[1:] for k, v in r.asDict().items() if k != "doc_id")


@pytest.mark.parametrize("piece", ["<svg>", "<img src=a>", "</x>", "<p>a b<img>", "<section>x", "<a href=x>t", "<div>", "<p><button>x", "<label><input>", "<h1>a", "<ul><li>x", "<table><tr><td>x", "<object><select>"])
def test_time_is_in_proportion_to_the_page(piece):
    page_elements(1, piece * 100)
    began = time.process_time()
    page_elements(1, piece * (100_000 // len(piece)))
    small = time.process_time() - began
    began = time.process_time()
    page_elements(1, piece * (400_000 // len(piece)))
    assert time.process_time() - began < 8 * small + 1


def test_captions_of_images():
    page = "<p>one two three</p><img src=a><div><p>no</p><img src=b></div><figure><img src=c><figcaption>the figure</figcaption></figure><img src=d title=named><h2>four five six seven</h2><img src=e>"
    rows, _ = page_nodes(1, page)
    assert [r["props"].get("caption") for r in rows if r["node_type"] == "image"] == ["one two three", "one two three", "the figure", "named", "four five six seven"]


def test_attributes_and_styles():
    f, g = html_writer._with_attribute, html_writer._with_style
    assert f("<img src=a>", "alt", 'a "b" & c') == '<img src=a alt="a &quot;b&quot; &amp; c">' and f("<img ALT='x' src=a />", "alt", "y") == '<img alt="y" src=a />'
    assert f("<img/>", "alt", "y") == '<img alt="y"/>' and f("<b data-alt=x>", "alt", "y") == '<b data-alt=x alt="y">' and f("<b alt=x>", "alt", None) == "<b>"
    assert g("<p style='color:#999 !important; margin: 0'>", "color", "#111") == '<p style="color: #111 !important; margin: 0">' and g("<p>", "color", "#111") == '<p style="color: #111">'


def test_pages_without_edits_stay_as_they_are(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").union(spark.createDataFrame([(-1, None), (-2, "")], "page_id long, html string"))
    none = spark.createDataFrame([], "doc_id long, start int, stop int, kind string, name string, value string")
    got = {r["doc_id"]: (r["html"], r["status"]) for r in html_writer.written_pages(pages, none).collect()}
    assert got == {r["page_id"]: (r["html"], "unchanged") for r in pages.collect()}


def test_a_page_that_would_lose_words_is_refused():
    page = "<p>one two</p><p>three</p>"
    edit = lambda **k: {"start": 0, "stop": 0, "kind": "replace", "name": None, "value": ""} | k
    assert html_writer.written_page(page, [edit(start=3, stop=10, value="1 2")])[0] == "<p>1 2</p><p>three</p>"  # a text that is replaced
    assert html_writer.written_page(page, [edit(value="<script>")])[1:] == ("refused: words would be lost", 0, 1)
    out = html_writer.written_page(page, [edit(start=3, stop=10, value="x"), edit(start=4, stop=5, value="y"), edit(start=14, stop=14, value="<b>", name="b"), edit(start=14, stop=14, value="<a>", name="a")])
    assert out == ("<p>x</p><p><a><b>three</p>".replace("<p><a><b>three", "<a><b><p>three"), "written", 3, 1)


def test_what_is_written_is_what_was_fixed(spark):
    pages = spark.createDataFrame([(1, DIRTY), (2, "<p>Nothing but text</p>"), (3, "<html><head><title>Untitled</title></head><body>" + DIRTY[12:]), (4, None)], "page_id long, html string")
    elements = staged(parse_elements(pages))
    nodes = staged(remediation.marked_fake_lists(element_nodes(elements)))
    fixed, report, outcomes = remediation.remediated(nodes)
    out = staged(html_writer.written_pages(pages, html_writer.source_edits(elements, report)))
    status = {r["doc_id"]: (r["status"], r["left_out"]) for r in out.collect()}
    assert status[1] == status[3] == ("written", 0) and status[4] == ("unchanged", 0)
    back = staged(remediation.marked_fake_lists(element_nodes(staged(parse_elements(out, "doc_id", "html")))))

    def shape(df):
        text = F.when(F.col("props")["synthesized"].isNull() | (F.col("node_type") == "table_cell"), F.col("text"))
        rows = df.filter("doc_id in (1, 3)").select("doc_id", "dfs_pos", "bfs_pos", "depth", "sibling_pos", "node_type", text.alias("text"), "level", "ordered", "cell_type", "alt_text", "target", "language").collect()
        return sorted(tuple(r) for r in rows)

    a, b = shape(fixed), shape(back)
    names_ = {(r[0], r[1]): r for r in a}
    assert [r[:6] for r in a] == [r[:6] for r in b]
    for r in b:
        was = names_[r[0], r[1]]
        assert r[7:] == was[7:] and (was[6] is None or r[6] == was[6])
    left = sorted((r["doc_id"], r["rule_id"]) for r in outcomes.filter("outcome <> 'fixed'").collect())
    assert sorted((r["doc_id"], r["rule_id"]) for r in rules.audit(back).collect() if r["doc_id"] in (1, 3)) == [x for x in left if x[0] in (1, 3)]
