"""Word and slide files to the node table: zip and XML are read in tasks, the tree is made by windows and joins.

``office_parts`` turns each file into flat rows of what it holds, in order: its core properties, paragraphs, links, images, table
cells and slide shapes. ``docx_nodes`` and ``pptx_nodes`` make the accessibility tree of them: lists from paragraphs that share a
numbering, headings from styles and title shapes, header cells from the first row, the marks that rules look for. A file that can't be read
yields its document node alone, with ``props['status'] = 'failed'``. Tables follow the paragraphs; text boxes and notes come between.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank
from ..operators import layout
from .tables import numbered

_FIELDS = {
    "kind": pa.string(), "seq": pa.int32(), "sub": pa.int32(), "slide": pa.int32(), "row": pa.int32(), "col": pa.int32(), "text": pa.string(), "style": pa.string(), "numbering": pa.string(), "target": pa.string(),
    "alt_text": pa.string(), "hidden": pa.bool_(), "bold": pa.bool_(), "head": pa.bool_(), "size_pt": pa.float64(), "color": pa.string(), "runs": pa.string(), "top": pa.float64(), "left": pa.float64(), "height": pa.float64(),
    "title": pa.string(), "language": pa.string(), "place": pa.string(),
}
_SPARK = {"string": "string", "int32": "int", "bool": "boolean", "double": "double"}

#: Namespaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DC = "{http://purl.org/dc/elements/1.1/}"


def _part(files: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(files.read(name)) if name in files.namelist() else None


def _targets(files: zipfile.ZipFile, name: str) -> dict[str, str]:
    """Relationships of a part: id to target."""
    folder, _, file = name.rpartition("/")
    rels = _part(files, f"{folder}/_rels/{file}.rels")
    return {} if rels is None else {r.get("Id"): r.get("Target", "") for r in rels}


def _core(files: zipfile.ZipFile) -> dict:
    core = _part(files, "docProps/core.xml")
    found = {n: core.findtext(f"{DC}{n}") for n in ("title", "language")} if core is not None else {}
    return {"kind": "document", "title": (found.get("title") or "").strip() or None, "language": (found.get("language") or "").strip() or None}


def _word_text(p: ElementTree.Element) -> str:
    return "".join(" " if e.tag in (f"{W}tab", f"{W}br") else e.text or "" for e in p.iter() if e.tag in (f"{W}t", f"{W}tab", f"{W}br")).strip()


def _word_paragraph(p: ElementTree.Element, seq: int, styles: dict[str, str], targets: dict[str, str], place: str) -> Iterator[dict]:
    """A paragraph, its links and its images."""
    style, number = p.find(f"{W}pPr/{W}pStyle"), p.find(f"{W}pPr/{W}numPr")
    size = lambda r: next((float(s.get(f"{W}val")) / 2 for s in r.iterfind(f"{W}rPr/{W}sz") if (s.get(f"{W}val") or "").isdigit()), None)
    bold = lambda r: (b := r.find(f"{W}rPr/{W}b")) is not None and b.get(f"{W}val") not in ("0", "false")
    runs = [r for r in p.iter(f"{W}r") if "".join(t.text or "" for t in r.iter(f"{W}t")).strip()]
    sizes = [float(s.get(f"{W}val")) / 2 for r in runs for s in r.iterfind(f"{W}rPr/{W}sz") if (s.get(f"{W}val") or "").isdigit()]
    colors = [c.get(f"{W}val") for r in runs for c in r.iterfind(f"{W}rPr/{W}color") if re.fullmatch("[0-9A-Fa-f]{6}", c.get(f"{W}val") or "")]
    dyed = [{"c": c.get(f"{W}val"), "sz": size(r), "b": bold(r)} for r in runs for c in r.iterfind(f"{W}rPr/{W}color") if re.fullmatch("[0-9A-Fa-f]{6}", c.get(f"{W}val") or "")]
    heavy = [bold(r) for r in runs]
    named = style.get(f"{W}val") if style is not None else None
    num = number.find(f"{W}numId") if number is not None else None
    marker = None if number is None else "bullet" if num is None else f"num-{num.get(f'{W}val')}"
    yield {"kind": "para", "seq": seq, "text": _word_text(p), "style": styles.get(named, named), "numbering": marker, "bold": bool(heavy) and all(heavy), "size_pt": max(sizes, default=None),
           "color": colors[0] if colors else None, "runs": json.dumps(dyed) if len({d["c"] for d in dyed}) > 1 else None, "place": place}
    for i, link in enumerate(p.iter(f"{W}hyperlink")):
        to = targets.get(link.get(f"{R}id") or "") or (f"#{link.get(f'{W}anchor')}" if link.get(f"{W}anchor") else "")
        yield {"kind": "link", "seq": seq, "sub": i, "text": _word_text(link) or "link", "target": to, "place": place}
    for i, drawing in enumerate(e for e in p.iter() if e.tag in (f"{WP}inline", f"{WP}anchor") and e.find(f".//{A}blip") is not None):
        doc = drawing.find(f"{WP}docPr")
        doc = {} if doc is None else doc.attrib
        yield {"kind": "image", "seq": seq, "sub": i, "alt_text": (doc.get("descr") or doc.get("title") or "").strip() or None, "hidden": (doc.get("hidden") or "").lower() in ("1", "true"), "place": place}


def docx_parts(files: zipfile.ZipFile) -> Iterator[dict]:
    styles_part = _part(files, "word/styles.xml")
    styles, core = {}, _core(files)
    if styles_part is not None:
        styles = {s.get(f"{W}styleId"): (s.find(f"{W}name").get(f"{W}val") if s.find(f"{W}name") is not None else s.get(f"{W}styleId")) for s in styles_part.iter(f"{W}style")}
        default = styles_part.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr/{W}lang")
        if core["language"] is None and default is not None:
            core["language"] = (default.get(f"{W}val") or "").strip() or None
    yield core
    body, targets, seq = _part(files, "word/document.xml").find(f"{W}body"), _targets(files, "word/document.xml"), 0
    for p in body.iterfind(f"{W}p"):
        seq += 1
        yield from _word_paragraph(p, seq, styles, targets, "body")
    for box in body.iter(f"{W}txbxContent"):
        for p in box.iterfind(f"{W}p"):
            seq += 1
            yield from _word_paragraph(p, seq, {}, targets, "text_box")
    for note in ("footnotes", "endnotes"):
        part = _part(files, f"word/{note}.xml")
        for n in part if part is not None else ():
            if n.get(f"{W}type") is None:
                for p in n.iterfind(f"{W}p"):
                    seq += 1
                    yield from _word_paragraph(p, seq, {}, _targets(files, f"word/{note}.xml"), "footnote")
    for t, table in enumerate(body.iterfind(f"{W}tbl"), 1):
        caption = table.find(f"{W}tblPr/{W}tblCaption")
        yield {"kind": "table", "seq": t, "text": caption.get(f"{W}val") if caption is not None else None}
        for r, row in enumerate(table.iterfind(f"{W}tr"), 1):
            marked = row.find(f"{W}trPr/{W}tblHeader") is not None
            for c, cell in enumerate(row.iterfind(f"{W}tc"), 1):
                runs = [x for x in cell.iter(f"{W}r") if _word_text(x)]
                yield {"kind": "cell", "seq": t, "row": r, "col": c, "text": " ".join(filter(None, map(_word_text, cell.iterfind(f"{W}p")))), "head": marked,
                       "bold": bool(runs) and all(x.find(f"{W}rPr/{W}b") is not None for x in runs)}


def _slide_text(shape: ElementTree.Element) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in shape.iter(f"{A}p")).strip()


def pptx_parts(files: zipfile.ZipFile) -> Iterator[dict]:
    yield _core(files)
    order, targets = _part(files, "ppt/presentation.xml"), _targets(files, "ppt/presentation.xml")
    seq = 0
    for slide, s in enumerate(order.iter(f"{P}sldId"), 1):
        name = f"ppt/{targets[s.get(f'{R}id')].removeprefix('/ppt/')}"
        yield {"kind": "slide", "slide": slide, "seq": seq}
        links = _targets(files, name)
        for shape in _part(files, name).iter():
            if shape.tag not in (f"{P}sp", f"{P}pic", f"{P}graphicFrame"):
                continue
            seq += 1
            at, size = shape.find(f".//{A}off"), shape.find(f".//{A}ext[@cy]")
            place = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            named = shape.find(f".//{P}cNvPr")
            row = {"slide": slide, "seq": seq, "top": float(at.get("y", 0)) if at is not None else 0.0, "left": float(at.get("x", 0)) if at is not None else 0.0, "height": float(size.get("cy", 0)) if size is not None else 0.0,
                   "place": None if place is None else place.get("type", "body")}
            if shape.tag == f"{P}pic":
                yield row | {"kind": "image", "alt_text": (named.get("descr") or "").strip() or None if named is not None else None, "hidden": False}
            elif (table := shape.find(f".//{A}tbl")) is not None:
                band = table.find(f"{A}tblPr")
                yield row | {"kind": "table"}
                for r, tr in enumerate(table.iterfind(f"{A}tr"), 1):
                    for c, cell in enumerate(tr.iterfind(f"{A}tc"), 1):
                        yield {"kind": "cell", "slide": slide, "seq": seq, "row": r, "col": c, "text": _slide_text(cell), "head": band is not None and band.get("firstRow") in ("1", "true"), "bold": False}
            elif shape.tag == f"{P}sp":
                yield row | {"kind": "shape", "text": _slide_text(shape)}
                for i, run in enumerate(x for x in shape.iter(f"{A}r") if x.find(f"{A}rPr/{A}hlinkClick") is not None):
                    yield {"kind": "link", "slide": slide, "seq": seq, "sub": i, "text": (run.findtext(f"{A}t") or "").strip() or "link", "target": links.get(run.find(f"{A}rPr/{A}hlinkClick").get(f"{R}id"), "")}


def office_parts(files: DataFrame) -> DataFrame:
    """(doc_id, format, and the fields of parts) of files (doc_id, format, content); formats other than docx and pptx are left out."""
    id_type = files.schema["doc_id"].dataType.simpleString()
    readers = {"docx": docx_parts, "pptx": pptx_parts}

    def rows_of(format_: str, content: bytes | None) -> list[dict]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                return list(readers[format_](z))
        except Exception as error:  # a file that fails must not fail the corpus
            return [{"kind": "document", "style": f"failed: {type(error).__name__}"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                found = rows_of(one.column(1)[0].as_py(), one.column(2)[0].as_py())
                yield pa.RecordBatch.from_arrays([one.column(0).take(pa.array([0] * len(found))), one.column(1).take(pa.array([0] * len(found))), *[pa.array([x.get(c) for x in found], k) for c, k in _FIELDS.items()]],
                                                 ["doc_id", "format", *_FIELDS])

    schema = f"doc_id {id_type}, format string, " + ", ".join(f"`{c}` {_SPARK[str(k)]}" for c, k in _FIELDS.items())
    return files.filter(F.col("format").isin(*readers)).select("doc_id", "format", "content").mapInArrow(run, schema)


def _map(**props: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())


_VALUES = {"text": "string", "level": "int", "ordered": "boolean", "marker": "string", "cell_type": "string", "header_scope": "string", "is_decorative": "boolean", "alt_text": "string", "target": "string", "page": "int",
           "language": "string", "props": "map<string,string>"}


def _nodes(rows: DataFrame, node_type: str | Column, path: list[Column], at: list[Column], **values: Column) -> DataFrame:
    """Nodes of one kind: the ids from the root down, the place in reading order as numbers, and what the kind has."""
    kind = {k: values.get(k, F.create_map().cast(t) if k == "props" else F.lit(None)).cast(t) for k, t in _VALUES.items()}
    return rows.select("doc_id", F.col("format").alias("source_format"), F.lit(node_type).alias("node_type"), F.array(*path).alias("path"), F.array(*[c.cast("int") for c in at]).alias("at"), *[c.alias(k) for k, c in kind.items()])


def _numbered(parts: list[DataFrame], rows: DataFrame | None = None) -> DataFrame:
    """The node table's columns from nodes with paths and places. With ``rows``, what they come from, nodes are numbered by the second number of their place first, for documents of any length."""
    x = reduce(DataFrame.unionByName, parts)
    dfs_pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    if rows is not None:
        x = numbered(x, rows, ["doc_id"], F.coalesce(F.get("at", F.lit(1)), F.lit(-(2**31))), ["at"], "dfs_pos")
        dfs_pos = F.col("dfs_pos")
    x = x.withColumns({"node_id": F.element_at("path", -1), "parent_id": F.get("path", F.size("path") - 2), "depth": F.size("path") - 1})
    doc, siblings = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "parent_id")
    return x.withColumns({"dfs_pos": dfs_pos, "bfs_pos": F.row_number().over(doc.orderBy("depth", "at")) - 1, "sibling_pos": F.row_number().over(siblings.orderBy("at")) - 1,
                          "content_kind": F.when(F.col("text").isNull(), "none").otherwise("text"), "row_span": F.when(F.col("node_type") == "table_cell", 1), "col_span": F.when(F.col("node_type") == "table_cell", 1)}).drop("at")


def _id(letter: str, *columns: str) -> Column:
    return F.concat_ws("-", F.lit(letter), *columns)


def _document(parts: DataFrame, **more: Column) -> DataFrame:
    d = parts.filter("kind = 'document'")
    props = {"title": F.col("title"), "status": F.when(F.col("style").isNull(), "ok").otherwise("failed"), "note": F.regexp_extract("style", "failed: (.*)", 1), **more}
    return _nodes(d, "document", [F.lit("doc")], [F.lit(0)], language=F.col("language"), props=_map(**props))


def _tables(parts: DataFrame, above: list[Column], at: list[Column], page: Column) -> list[DataFrame]:
    """Tables, rows and cells. The first row is a header if it is marked or bold, or the table is too small to tell."""
    cells = parts.filter("kind = 'cell'")
    table = Window.partitionBy("doc_id", "seq")
    first = cells.withColumns({"n_rows": F.max("row").over(table), "n_cols": F.max("col").over(table), "top": F.bool_and(F.when(F.col("row") == 1, F.col("head") | F.col("bold") | blank(F.col("text")))).over(table),
                               "some": F.bool_or(F.when(F.col("row") == 1, F.col("head") | F.col("bold"))).over(table)})
    header = (F.col("row") == 1) & ~blank(F.col("text")) & ((F.col("top") & F.col("some")) | ~((F.col("n_rows") >= 3) & (F.col("n_cols") >= 2)))
    t, r, c = _id("t", "seq"), _id("r", "seq", "row"), _id("c", "seq", "row", "col")
    text = F.when(blank(F.col("text")), " ").otherwise(F.col("text"))
    return [_nodes(parts.filter("kind = 'table'"), "table", [*above, t], at, page=page, props=_map(caption=F.col("text"))),
            _nodes(cells.dropDuplicates(["doc_id", "seq", "row"]), "table_row", [*above, t, r], [*at, F.col("row")], page=page),
            _nodes(first, "table_cell", [*above, t, r, c], [*at, F.col("row"), F.col("col")], text=text, page=page, cell_type=F.when(header, "header").otherwise("data"), header_scope=F.when(header, "column").otherwise("none"))]


def docx_nodes(parts: DataFrame) -> DataFrame:
    """The node table of Word files."""
    parts = parts.filter("format = 'docx'")
    body = F.lit("body")
    order = Window.partitionBy("doc_id").orderBy("seq")
    words = F.size(F.split(F.trim(F.col("text")), r"\s+"))
    level = F.when(F.lower("style").startswith("heading"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.regexp_extract("style", r"(?i)^heading\s+(\d+)$", 1).try_cast("int"), F.lit(1)))))
    new_list = F.col("numbering").isNotNull() & ~F.coalesce((F.lag("numbering").over(order) == F.col("numbering")), F.lit(False))
    near = F.max_by("text", F.when(words >= 3, F.col("seq"))).over(order.rowsBetween(-4, -1))
    caption = F.when(F.lower(F.lead("style").over(order)) == "caption", F.lead("text").over(order))
    links = parts.filter("kind = 'link'").select("doc_id", "seq", F.lit(True).alias("linked")).distinct()
    # one window over a document's paragraphs: lists, captions and the words before an image
    p = parts.filter("kind = 'para'").join(links, ["doc_id", "seq"], "left").withColumns({
        "level": F.when((F.col("place") == "body") & F.col("numbering").isNull(), level), "list_no": F.sum(new_list.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "near": F.coalesce(F.nullif(caption, F.lit("")), F.when(words >= 3, F.col("text")), near)})
    items = p.filter("numbering is not null")
    lists = items.groupBy("doc_id", "format", "list_no").agg(F.min("seq").alias("seq"), F.first("numbering").alias("numbering"))
    look = {"runs": F.col("runs"), "color": F.concat(F.lit("#"), "color"), "size_pt": F.col("size_pt"), "bold": F.col("bold")}
    fake_heading = layout.looks_like_heading(F.col("style"), F.col("text"), F.col("bold"), F.col("size_pt"))
    plain = p.filter("numbering is null and level is null and linked is null and text <> ''").withColumn("fake_heading", (F.col("place") == "body") & fake_heading)
    marked = p.join(plain.select("doc_id", "seq", F.col("fake_heading")), ["doc_id", "seq"], "left").filter("place = 'body'")
    # text that is no candidate parts the runs
    typed = layout.fake_list_runs(marked.select("doc_id", F.col("seq").alias("pos"), F.when(F.col("fake_heading") == F.lit(False), F.col("text")).otherwise("").alias("text"))).select(
        "doc_id", F.col("first_pos").alias("seq"), F.transform(F.sequence(F.lit(0), F.col("items") - 1), lambda i: F.concat(F.lit("p-"), (F.col("first_pos") + i).cast("string"))).alias("run"), F.col("kind").alias("run_kind"))
    plain = plain.join(typed, ["doc_id", "seq"], "left")
    at = [F.lit(2), F.col("seq")]
    in_place = {"in_text_box": F.when(F.col("place") == "text_box", True), "in_footnote": F.when(F.col("place") == "footnote", True)}
    images = parts.filter("kind = 'image'").join(p.select("doc_id", "seq", "near"), ["doc_id", "seq"])
    nodes = [
        _document(parts), _nodes(parts.filter("kind = 'document' and style is null"), "section", [F.lit("doc"), body], [F.lit(1)], text=F.lit("Document")),
        _nodes(lists, "list", [F.lit("doc"), body, _id("l", "list_no")], [*at, F.lit(-1)], ordered=F.col("numbering").startswith("num-"), marker=F.col("numbering")),
        _nodes(items, "list_item", [F.lit("doc"), body, _id("l", "list_no"), _id("i", "seq")], [*at, F.lit(0)], text=F.when(F.col("text") == "", "•").otherwise(F.col("text")), props=_map(**look)),
        _nodes(p.filter("level is not null"), "heading", [F.lit("doc"), body, _id("h", "seq")], [*at, F.lit(0)], level=F.col("level"), text=F.when(F.col("text") == "", "Heading").otherwise(F.col("text")), props=_map(**look)),
        _nodes(parts.filter("kind = 'link'").join(p.filter("numbering is null and level is null").select("doc_id", "seq"), ["doc_id", "seq"], "left_semi"), "link", [F.lit("doc"), body, _id("a", "seq", "sub")], [*at, F.lit(1), F.col("sub")],
               text=F.col("text"), target=F.col("target"), props=_map(**in_place)),
        _nodes(images, "image", [F.lit("doc"), body, _id("g", "seq", "sub")], [*at, F.lit(2), F.col("sub")], alt_text=F.col("alt_text"), is_decorative=F.coalesce("hidden", F.lit(False)), props=_map(caption=F.substring("near", 1, 200))),
        _nodes(plain, "paragraph", [F.lit("doc"), body, _id("p", "seq")], [*at, F.lit(3)], text=F.col("text"), props=_map(
            **look, **in_place, looks_like_heading=F.when(F.col("fake_heading"), True), fake_list_run_ids=F.array_join("run", " "), fake_list_kind=F.col("run_kind"))),
        *_tables(parts, [F.lit("doc"), body], [F.lit(3), F.col("seq")], F.lit(None)),
    ]
    return _numbered(nodes)


def pptx_nodes(parts: DataFrame) -> DataFrame:
    """The node table of slide files."""
    parts = parts.filter("format = 'pptx'")
    shapes = parts.filter("kind = 'shape' and text <> ''")
    titles = shapes.filter("place in ('title', 'ctrTitle')").groupBy("doc_id", "slide").agg(F.min_by(F.struct("text", F.col("seq").alias("title_seq")), "seq").alias("t")).select("doc_id", "slide", F.col("t.text").alias("heading"), "t.title_seq")
    other = shapes.join(titles, ["doc_id", "slide"], "left").filter("title_seq is null or seq <> title_seq")
    turned = layout.inverted_slides(other.select("doc_id", "slide", F.col("seq").alias("idx"), "top", "height", "text")).withColumn("inverted", F.lit(True))
    slides = parts.filter("kind = 'slide'").join(titles, ["doc_id", "slide"], "left").join(turned, ["doc_id", "slide"], "left")
    lines = other.filter("place is null").select("doc_id", "seq", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    # lines of a shape that are typed as a list: a run of two or more within the shape
    typed = layout.fake_list_runs(lines.select(F.struct("doc_id", "seq").alias("doc_id"), F.col("line").alias("pos"), "text")).groupBy("doc_id").agg(F.min_by("kind", "first_pos").alias("run_kind")).select("doc_id.doc_id", "doc_id.seq", "run_kind")
    other = other.join(typed, ["doc_id", "seq"], "left")
    doc, section = F.lit("doc"), _id("s", "slide")
    at, page = [F.lit(2), F.col("slide"), F.lit(1), F.col("seq")], F.col("slide")
    hint = {"order_top": F.col("top"), "order_left": F.col("left")}
    totals = slides.groupBy("doc_id").agg(F.count("*").alias("slides"), F.count_if(F.col("heading").isNull()).alias("untitled"))
    documents = parts.filter("kind = 'document'").join(totals, "doc_id", "left")
    nodes = [
        _document(documents, slides_total=F.col("slides"), slides_missing_titles=F.col("untitled")),
        _nodes(slides, "section", [doc, section], [F.lit(2), F.col("slide")], text=F.coalesce("heading", F.concat(F.lit("Slide "), "slide")), page=page,
               props=_map(slide_number=F.col("slide"), missing_title=F.when(F.col("heading").isNull(), True), reading_order_inverted=F.col("inverted"))),
        _nodes(slides.filter("heading is not null"), "heading", [doc, section, _id("h", "slide")], [F.lit(2), F.col("slide"), F.lit(0)], level=F.lit(1), text=F.col("heading"), page=page),
        _nodes(other, "paragraph", [doc, section, _id("p", "seq")], [*at, F.lit(-1)], text=F.col("text"), page=page, props=_map(
            **hint, fake_list_run_ids=F.when(F.col("run_kind").isNotNull(), _id("p", "seq")), fake_list_kind=F.col("run_kind"))),
        _nodes(parts.filter("kind = 'image'"), "image", [doc, section, _id("g", "seq")], at, alt_text=F.col("alt_text"), is_decorative=F.lit(False), page=page, props=_map(**hint)),
        _nodes(parts.filter("kind = 'link'"), "link", [doc, section, _id("a", "seq", "sub")], [*at, F.col("sub")], text=F.col("text"), target=F.col("target"), page=page),
        *_tables(parts, [doc, section], at, page),
    ]
    return _numbered(nodes)


def office_nodes(files: DataFrame) -> DataFrame:
    """The node table of all Word and slide files of (doc_id, format, content). The parts are read twice; write them first if files are many."""
    parts = office_parts(files)
    return docx_nodes(parts).unionByName(pptx_nodes(parts))
