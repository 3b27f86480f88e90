"""Names and labels of fields, told in one pass over rows that lie together."""

from conftest import SF
from test_html_writer import FORMS, elements_of

from wardlume import queries as library
from wardlume.operators import names

#: Labels of fields whose stretches end in controls and headings that are no fields, and of fields in rows.
MORE = [
    ("<form>Name <input type=submit> Town <input></form>", ["Town"]), ("<form>Name <input> Town <h2>x</h2> <input></form>", ["Name", None]), ("<form>Name <input><h2>Town</h2><input></form>", [None, None]),
    ("<form><label>Old</label><label>Mail</label> Town <input></form>", ["Mail"]), ("<form><label>Mail <input type=hidden></label> Town <input></form>", ["Town"]), ("<form>Na<b>me</b><i></i> <input></form>", ["Name"]),
    ("<table><tr><td>Age<td><input><td><input></table>", ["Age", None]), ("<label for=x>A</label><form><input id=x>B <input id=y></form>", [None, "B"]), ("<label>A <select></select></label>B <input>", [None, "B"])]


def test_all_fields_with_their_labels(spark):
    every = FORMS + MORE
    e = elements_of(spark, [f for f, _ in every])
    rows = names.labelled_fields(e).orderBy("doc_id", "pos").collect()
    assert [(f, [r["label"] for r in rows if r["doc_id"] == i]) for i, (f, _) in enumerate(every)] == every
    named = names.named_fields(e).orderBy("doc_id", "pos").collect()
    assert [(r["doc_id"], r["pos"], r["named"]) for r in rows] == [(r["doc_id"], r["pos"], r["named"]) for r in named]


def test_rows_of_a_form_are_dealt_once(spark):
    """Else elements are written, and shuffled by every key that a label is looked for by."""
    out = library.QUERIES["field_labels"](spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("/lineitem.parquet" in f for f in out.inputFiles())
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("Exchange") <= 4 and "Broadcast" not in plan
