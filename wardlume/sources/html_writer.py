"""Web pages written back with their fixes: only what changes is touched, and no page loses words.

Fixes become edits of the source: places (start, stop) that the parser noted, each with what is to be done there. A page's edits
are merged from its end to its beginning, so that no place shifts before it is used; everything between them stays byte for byte.

- ``replace``: the characters from start to stop become ``value`` (an insertion where they are one place); text in it is escaped already.
- ``tag``: the element's start tag from start to stop gets another name; its end tag is a ``replace``.
- ``attr`` and ``style``: an attribute, or a declaration of the style attribute, of the start tag from start to stop is set.
- ``strip``: the marker of a list item goes from the beginning of the text from start to stop.

A page is refused, and returned as it was, if words of its visible text would be lost: all that stood there must still stand there as often, but
for list markers and for texts that an edit replaces. An edit within another that replaces it is left out and counted.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import names
from .html import SKIPPED, tree_of

_ATTRIBUTE = re.compile(r"""\s+([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_MARKER = re.compile(r"^\s*(?:[-*•‣◦–—·]|\d{1,3}[.)])\s+")
_MARKER_WORD = re.compile(r"[-*•‣◦–—·]|\d{1,3}[.)]")
_EDIT = "array<struct<start:int,stop:int,kind:string,name:string,value:string>>"


def _with_attribute(tag: str, name: str, value: str | None) -> str:
    """A start tag with an attribute set, or taken away."""
    text = "" if value is None else f' {name}="{entities.escape(value)}"'
    head = re.match(r"<[^\s/>]+", tag)
    at = head.end() if head else 1
    for m in _ATTRIBUTE.finditer(tag, at):
        if m[1].lower() == name:
            return tag[: m.start()] + text + tag[m.end() :]
    end = re.search(r"\s*/?>$", tag)
    at = end.start() if end else len(tag)
    return tag[:at] + text + tag[at:]


def _with_style(tag: str, name: str, value: str) -> str:
    """A start tag whose style attribute declares the value; weight by !important is kept."""
    head = re.match(r"<[^\s/>]+", tag)
    old = next((m[2] for m in _ATTRIBUTE.finditer(tag, head.end() if head else 1) if m[1].lower() == "style" and m[2]), "")
    out, done = [], False
    for part in filter(None, (p.strip() for p in entities.unescape(old.strip("\"'")).split(";"))):
        key, _, said = part.partition(":")
        if key.strip().lower() == name:
            part, done = f"{name}: {value}" + (" !important" if "!important" in said.lower() else ""), True
        out.append(part)
    return _with_attribute(tag, "style", "; ".join(out if done else [*out, f"{name}: {value}"]))


def visible_words(page: str) -> Counter:
    """The words that a reader sees, as often as they stand there; marks of list items are no words."""
    out, todo = Counter(), [tree_of(page)]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            out.update(w for w in e.split() if not _MARKER_WORD.fullmatch(w))
        elif e.tag not in SKIPPED and e.tag != "title":
            todo += e.children
    return out


def merged(page: str, edits: list[dict]) -> tuple[str, int, int, str]:
    """(page with its edits, how many were made, how many lay within others, words that edits replace)."""
    wide = [(e["start"], e["stop"]) for e in edits if e["kind"] == "replace" and e["stop"] > e["start"]]
    inside = lambda e, s, t: s <= e["start"] and e["stop"] <= t and (s, t) != (e["start"], e["stop"]) and not (e["start"] == e["stop"] and e["start"] in (s, t))
    kept = [e for e in edits if not any(inside(e, s, t) for s, t in wide)]
    out, replaced = page, []
    groups: dict[tuple[int, int], list[dict]] = {}
    for e in kept:
        groups.setdefault((e["start"], e["stop"]), []).append(e)
    for (start, stop), here in sorted(groups.items(), reverse=True):
        piece = page[start:stop]
        if any(e["kind"] == "replace" for e in here):
            replaced.append(piece)
            # of several texts for one stretch the first counts; insertions at one place stand in the order of their names
            texts = [e["value"] for e in sorted(here, key=lambda e: e["name"] or "")]
            piece = "".join(texts) if start == stop else texts[0]
        for e in here:
            if e["kind"] == "tag":
                piece = re.sub(r"^<[^\s/>]+", f"<{e['value']}", piece)
            elif e["kind"] == "attr":
                piece = _with_attribute(piece, e["name"], e["value"])
            elif e["kind"] == "style":
                piece = _with_style(piece, e["name"], e["value"])
            elif e["kind"] == "strip":
                piece = _MARKER.sub("", piece) if _MARKER.match(piece) else entities.escape(e["value"] or "", quote=False)
        out = out[:start] + piece + out[stop:]
    return out, len(kept), len(edits) - len(kept), " ".join(replaced)


def written_page(page: str, edits: list[dict]) -> tuple[str, str, int, int]:
    """(page, status, edits made, edits left out)."""
    if not edits:
        return page, "unchanged", 0, 0
    out, made, left, replaced = merged(page, edits)
    if visible_words(page) - visible_words(replaced) - visible_words(out):
        return page, "refused: words would be lost", 0, len(edits)
    return out, "written", made, left


def written_pages(pages: DataFrame, edits: DataFrame, doc_id: str = "page_id", page: str = "html") -> DataFrame:
    """(doc_id, html, status, edits, left_out) of every page, with its edits (doc_id, start, stop, kind, name, value): a join and one pass."""
    of = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind", "name", "value"))).cast(_EDIT).alias("edits"))
    x = pages.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(page).cast("string").alias("html")).join(of, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 50):
                part = batch.slice(s, 50)
                rows = [(p, "unchanged", 0, 0) if p is None else written_page(p, e or []) for p, e in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]], ["doc_id", "html", "status", "edits", "left_out"])

    return x.mapInArrow(run, "doc_id long, html string, status string, edits int, left_out int")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _edit(rows: DataFrame, kind: str, start, stop, value, name=None) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select("doc_id", col(start).cast("int").alias("start"), col(stop).cast("int").alias("stop"), F.lit(kind).alias("kind"), (F.lit(None) if name is None else name).cast("string").alias("name"), value.cast("string").alias("value"))


def _renamed(rows: DataFrame, tag: Column) -> list[DataFrame]:
    """Edits that give elements another name; an end tag that was left out is written."""
    ends = F.concat(F.lit("</"), tag, F.lit(">"))
    return [_edit(rows, "tag", "start", "body", tag), _edit(rows, "replace", "close", "stop", ends, F.lit("a"))]


def source_edits(elements: DataFrame, report: DataFrame) -> DataFrame:
    """Edits of the source for the applied tree edits of ``apply_fixes``: elements are written element rows, report has doc_id, op, node_id, field, value, new_id, status."""
    done = report.filter("status = 'applied'").select("doc_id", "op", "node_id", "field", "value", "new_id", "node_type", "ref_id", "action_code")
    plain = elements.filter("tag <> '#text'")
    held = plain.groupBy("doc_id", F.col("parent").alias("pos")).agg(F.count("*").alias("kids"))
    at = plain.select("doc_id", "pos", "parent", "tag", "attrs", "start", "body", "close", "stop", F.col("node.node_id").alias("node_id")).join(held, ["doc_id", "pos"], "left").fillna(0, ["kids"])
    nodes = at.filter("node_id is not null")
    sets = done.filter("op = 'set'").join(nodes, ["doc_id", "node_id"])
    of = lambda field, where="true": sets.filter((F.col("field") == field) & F.expr(where))
    is_heading = "tag in ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')"
    levels = of("level").select("doc_id", "pos", "tag", "start", "body", "close", "stop", "value")
    out = [*_renamed(levels.filter(f"{is_heading} or tag = 'p'"), F.concat(F.lit("h"), "value")),
           _edit(of("alt_text", "tag = 'img'"), "attr", "start", "body", F.coalesce("value", F.lit("")), F.lit("alt")),
           _edit(of("text", "tag = 'a' and kids = 0"), "replace", "body", "close", _escaped(F.col("value"))),
           _edit(of("props.color"), "style", "start", "body", F.col("value"), F.lit("color")),
           *_renamed(of("cell_type", "tag = 'td' and value = 'header'"), F.lit("th")), _edit(of("cell_type", "tag = 'td' and value = 'header'"), "attr", "start", "body", F.lit("col"), F.lit("scope")),
           _edit(of("props.caption", "tag = 'table'"), "replace", "body", "body", F.concat(F.lit("<caption>"), _escaped(F.col("value")), F.lit("</caption>")), F.lit("a"))]
    # the page's own: language, title
    roots = done.filter("op = 'set' and (field = 'language' or field = 'props.title')").join(nodes.filter("pos = 0").select("doc_id", "node_id"), ["doc_id", "node_id"]).select("doc_id", "field", "value")
    firsts = at.filter("tag in ('html', 'head', 'title')").groupBy("doc_id").agg(*[F.min_by(F.struct("start", "body", "close", "stop"), F.when(F.col("tag") == t, F.col("pos"))).alias(t) for t in ("html", "head", "title")])
    page = roots.join(firsts, "doc_id", "left")
    out.append(_edit(page.filter("field = 'language' and html is not null"), "attr", "html.start", "html.body", F.col("value"), F.lit("lang")))
    titles = page.filter("field = 'props.title'").withColumn("value", _escaped(F.col("value")))
    tag = F.concat(F.lit("<title>"), "value", F.lit("</title>"))
    place = F.coalesce("head.body", "html.body", F.lit(0))
    out += [_edit(titles.filter("title is not null"), "replace", "title.body", "title.close", F.col("value")),
            _edit(titles.filter("title is null"), "replace", place, place, F.when(F.col("head").isNull(), F.concat(F.lit("<head>"), tag, F.lit("</head>"))).otherwise(tag), F.lit("a"))]
    # header rows: in the head of the table, else in a new one before its first part
    cells = done.filter("op = 'insert' and node_type = 'table_cell'").select("doc_id", F.col("ref_id").alias("new_id"), F.col("new_id").alias("node_id"))
    texts = done.filter("op = 'set' and field = 'text'").select("doc_id", "node_id", "value")
    cells = cells.join(texts, ["doc_id", "node_id"]).groupBy("doc_id", "new_id").agg(F.sort_array(F.collect_list(F.struct(F.length("node_id").alias("n"), "node_id", "value"))).alias("cells"))
    row = F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", lambda c: F.concat(F.lit('<th scope="col">'), _escaped(c["value"]), F.lit("</th>"))), ""), F.lit("</tr>"))
    parts = at.filter("tag not in ('caption', 'colgroup', 'col')").groupBy("doc_id", F.col("parent").alias("pos")).agg(F.min_by(F.struct("tag", "start", "body"), "pos").alias("first"))
    rows = done.filter("op = 'insert' and node_type = 'table_row'").select("doc_id", "new_id", F.col("ref_id").alias("node_id")).join(cells, ["doc_id", "new_id"]).join(nodes, ["doc_id", "node_id"]).join(parts, ["doc_id", "pos"], "left")
    in_head = F.coalesce(F.col("first.tag") == "thead", F.lit(False))
    place = F.when(in_head, F.col("first.body")).otherwise(F.coalesce("first.start", "close"))
    out.append(_edit(rows, "replace", place, place, F.when(in_head, row).otherwise(F.concat(F.lit("<thead>"), row, F.lit("</thead>"))), F.lit("b")))
    # children of lists that are no items, and typed lists whose members lie side by side in one element
    wraps = done.filter("op = 'wrap'").select("doc_id", "node_id", "new_id", "node_type").join(nodes, ["doc_id", "node_id"])
    strays = wraps.filter("node_type = 'list_item'")
    out += [_edit(strays, "replace", "start", "start", F.lit("<li>"), F.lit("b")), _edit(strays, "replace", "stop", "stop", F.lit("</li>"), F.lit("a"))]
    run = Window.partitionBy("doc_id", "new_id")
    kinds = done.filter("op = 'set' and field = 'ordered'").select("doc_id", F.col("node_id").alias("new_id"), F.when(F.col("value") == "true", "ol").otherwise("ul").alias("list"))
    members = wraps.filter("node_type = 'list' and tag = 'p'").withColumns({"n": F.count("*").over(run), "same": F.min("parent").over(run) == F.max("parent").over(run), "first": F.min("start").over(run), "last": F.max("stop").over(run)})
    members = members.filter("same and kids = 0 and n >= 2").join(kinds, ["doc_id", "new_id"]).join(texts, ["doc_id", "node_id"], "left")
    heads, tails = members.filter("start = first"), members.filter("stop = last")
    out += [*_renamed(members, F.lit("li")), _edit(members, "strip", "body", "close", F.coalesce("value", F.lit(""))),
            _edit(heads, "replace", "start", "start", F.concat(F.lit("<"), "list", F.lit(">")), F.lit("b")), _edit(tails, "replace", "stop", "stop", F.concat(F.lit("</"), "list", F.lit(">")), F.lit("b"))]
    # fields: labels that can be derived, purposes, places in the tab order
    asked = done.filter("action_code in ('FILL_FORM_FIELD_LABELS', 'SET_INPUT_AUTOCOMPLETE', 'FIX_POSITIVE_TABINDEX')").select("doc_id", "action_code").distinct()
    wanted = lambda code: elements.join(asked.filter(F.col("action_code") == code).select("doc_id"), "doc_id", "left_semi")
    unnamed = wanted("FILL_FORM_FIELD_LABELS")
    labels = names.labelled_fields(unnamed).filter("label is not null").select("doc_id", "pos", "label").join(at.select("doc_id", "pos", "start", "body"), ["doc_id", "pos"])
    purposes = wanted("SET_INPUT_AUTOCOMPLETE").filter(F.col("purpose").isNotNull() & ~names.given("autocomplete"))
    tabs = wanted("FIX_POSITIVE_TABINDEX").filter(names.attr("tabindex").rlike(r"^\s*\+?0*[1-9]\d*\s*$"))
    out += [_edit(labels, "attr", "start", "body", F.col("label"), F.lit("aria-label")), _edit(purposes, "attr", "start", "body", F.col("purpose"), F.lit("autocomplete")),
            _edit(tabs, "attr", "start", "body", F.lit("0"), F.lit("tabindex"))]
    return reduce(DataFrame.unionByName, out)
