"""Detection rules: each is a function from the node table to (doc_id, node_id, rule_id, evidence) rows, one per node at most.

``audit`` runs all of them, or a chosen subset, over one node table. Rules over single nodes are evaluated in one pass; rules with
an order use windows over a document's reading order, rules over tables and lists grouped aggregates of direct children. Every hit carries its
node's place along, so findings are never joined with all nodes again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, text
from ..plans import dims

KIDS = ("doc_id", "parent_id")
#: Columns of a node that its findings carry.
PLACE = ("node_type", "path", "bfs_pos", "dfs_pos")
Rule = Callable[..., DataFrame]
RULES: dict[str, Rule] = {}


#: Rules over single nodes: kinds of nodes, condition, evidence. ``audit`` evaluates them all in one pass.
NODE_RULES: dict[str, tuple[tuple[str, ...], Callable[[], tuple[Column, dict[str, Column]]]]] = {}


def _evidence(columns: dict[str, Column]) -> Column:
    pairs = [x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")


def rule(name: str) -> Callable[[Callable[[DataFrame], tuple]], Rule]:
    """Register a function from the node table to (nodes that are hit, evidence columns)."""

    def wrap(find: Callable[[DataFrame], tuple]) -> Rule:
        def run(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
            hit, evidence = find(nodes)
            return hit.select("doc_id", "node_id", *keep, F.lit(name).alias("rule_id"), _evidence(evidence).alias("evidence"))

        RULES[name] = run
        return run

    return wrap


def node_rule(name: str, *kinds: str) -> Callable[[Callable[[], tuple]], None]:
    """Register a function that gives (condition, evidence columns) over single nodes of the kinds named."""

    def wrap(find: Callable[[], tuple]) -> None:
        NODE_RULES[name] = (kinds, find)
        RULES[name] = lambda nodes, keep=(): single_node_findings(nodes, [name], keep)

    return wrap


def _hits(rows: DataFrame, keep: tuple[str, ...], cases: list[tuple[str, Column, dict[str, Column]]]) -> DataFrame:
    """Rows that meet conditions, once for each of them, with the evidence."""
    if len(cases) == 1:
        # a plain filter: the planner evaluates the condition of an exploded array twice
        [(name, hit, evidence)] = cases
        return rows.filter(hit).select("doc_id", "node_id", *keep, F.lit(name).alias("rule_id"), _evidence(evidence).alias("evidence"))
    found = F.array(*[F.when(hit, F.struct(F.lit(name).alias("rule_id"), _evidence(evidence).alias("evidence"))) for name, hit, evidence in cases])
    hits = rows.select("doc_id", "node_id", *keep, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return hits.select("doc_id", "node_id", *keep, "x.rule_id", "x.evidence")


def single_node_findings(nodes: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of several node rules in one pass over the table."""
    cases = []
    for n in names:
        kinds, find = NODE_RULES[n]
        hit, evidence = find()
        cases.append((n, F.col("node_type").isin(*kinds) & hit if kinds else hit, evidence))
    return _hits(nodes, keep, cases)


def of(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.filter(F.col("node_type").isin(*kinds))


def prop(name: str) -> Column:
    return F.try_element_at("props", F.lit(name))


def count_of(name: str) -> Column:
    return F.coalesce(prop(name).try_cast("int"), F.lit(0))


def is_true(name: str) -> Column:
    return F.coalesce(F.lower(prop(name)) == "true", F.lit(False))


@node_rule("MISSING_ALT_TEXT", "image")
def _():
    return ~F.coalesce("is_decorative", F.lit(False)) & text.blank(F.col("alt_text")), {}


@node_rule("DECORATIVE_IMAGE_WITH_ALT", "image")
def _():
    return F.col("is_decorative") & ~text.blank(F.col("alt_text")), {"alt": F.col("alt_text")}


@node_rule("ALT_TEXT_NOT_DESCRIPTIVE", "image")
def _():
    return ~F.coalesce("is_decorative", F.lit(False)) & text.alt_is_nondescriptive(F.col("alt_text")), {"alt": F.col("alt_text")}


@rule("HEADING_LEVEL_JUMP")
def _(nodes):
    order = Window.partitionBy("doc_id").orderBy("dfs_pos")
    h = of(nodes, "heading").withColumn("before", F.lag("level").over(order))
    return h.filter(F.col("level") > F.col("before") + 1), {"level": F.col("level"), "previous": F.col("before")}


@node_rule("TEXT_STYLED_AS_HEADING", "paragraph")
def _():
    return is_true("looks_like_heading"), {}


@node_rule("HEADING_TEXT_EMPTY", "heading")
def _():
    return (F.col("content_kind") != "text") | text.blank(F.col("text")), {"level": F.col("level")}


def table_shape(nodes: DataFrame) -> DataFrame:
    """Of every table, over its direct rows and their direct cells: rows, cells, width with and without spans, header and merged data cells."""
    cells = of(nodes, "table_cell").groupBy(*KIDS).agg(
        F.count("*").alias("cells"), F.sum(F.greatest(F.lit(1), F.coalesce("col_span", F.lit(1)))).alias("width"), F.count_if(F.col("cell_type") == "header").alias("headers"),
        F.count_if((F.col("cell_type") == "data") & ((F.col("row_span") > 1) | (F.col("col_span") > 1))).alias("merged")).withColumnRenamed("parent_id", "row_id")
    rows = of(nodes, "table_row").select("doc_id", F.col("node_id").alias("row_id"), F.col("parent_id").alias("table_id")).join(cells, ["doc_id", "row_id"], "left")
    shape = rows.groupBy("doc_id", "table_id").agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum("cells"), F.lit(0)).alias("n_cells"), F.coalesce(F.max("cells"), F.lit(0)).alias("most_cells"),
        F.coalesce(F.max("width"), F.lit(0)).alias("max_width"), F.coalesce(F.sum("headers"), F.lit(0)).alias("headers"), F.coalesce(F.sum("merged"), F.lit(0)).alias("merged"))
    none = [c for c in shape.columns if c not in ("doc_id", "table_id")]
    return of(nodes, "table").join(shape.withColumnRenamed("table_id", "node_id"), ["doc_id", "node_id"], "left").fillna(0, none)


#: Rules over a table's shape: condition and evidence over ``table_shape``. ``audit`` evaluates them all in one pass.
TABLE_RULES: dict[str, Callable[[], tuple[Column, dict[str, Column]]]] = {}


def table_rule(name: str) -> Callable[[Callable[[], tuple]], None]:
    def wrap(find: Callable[[], tuple]) -> None:
        TABLE_RULES[name] = find
        RULES[name] = lambda nodes, keep=(): table_findings(nodes, [name], keep)

    return wrap


def introduced_tables(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, introduced) of tables right behind a heading or a paragraph with text: only tables and such siblings are joined."""
    named = F.col("node_type").isin("heading", "paragraph") & ~text.blank(F.col("text"))
    before = nodes.filter(named).select(*KIDS, (F.col("sibling_pos") + 1).alias("sibling_pos"), F.lit(True).alias("introduced"))
    return of(nodes, "table").select("doc_id", "node_id", "parent_id", "sibling_pos").join(before, [*KIDS, "sibling_pos"], "left").select("doc_id", "node_id", F.coalesce("introduced", F.lit(False)).alias("introduced"))


def table_findings(nodes: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of several table rules from one shape of every table."""
    shapes = table_shape(nodes)
    shapes = shapes.join(introduced_tables(nodes), ["doc_id", "node_id"]) if "TABLE_CAPTION_MISSING" in names else shapes
    return _hits(shapes, keep, [(n, *TABLE_RULES[n]()) for n in names])


@table_rule("TABLE_MISSING_HEADERS")
def _():
    return F.col("headers") == 0, {"rows": F.col("n_rows")}


@table_rule("TABLE_CAPTION_MISSING")
def _():
    layout = F.lower(F.coalesce(prop("role"), F.lit(""))).isin("presentation", "none")
    return (~layout & text.blank(prop("caption")) & (F.col("n_rows") >= 3) & (F.col("most_cells") >= 3)
            & (F.coalesce(F.col("source_format") == "docx", F.lit(False)) | ~F.col("introduced"))), {"rows": F.col("n_rows"), "columns": F.col("most_cells")}


@table_rule("TABLE_COMPLEX_NEEDS_SUMMARY")
def _():
    merged = (F.col("merged") > 0) & (F.col("n_cells") >= 6)
    large = (F.col("max_width") >= 3) & ((F.col("n_rows") >= 20) | (F.col("n_cells") >= 120))
    return text.blank(prop("caption")) & (merged | large), {"rows": F.col("n_rows"), "cells": F.col("n_cells")}


@rule("TABLE_NESTED")
def _(nodes):
    inner = of(nodes, "table").withColumn("above", F.explode(F.expr("slice(path, 1, size(path) - 1)")))
    outer = of(nodes, "table").select("doc_id", F.col("node_id").alias("above"))
    return inner.join(outer, ["doc_id", "above"], "left_semi").dropDuplicates(["doc_id", "node_id"]), {}


@rule("LIST_STRUCTURE_INVALID")
def _(nodes):
    kids = nodes.filter("parent_id is not null").groupBy(*KIDS).agg(F.count_if(F.col("node_type") != "list_item").alias("strays")).withColumnRenamed("parent_id", "node_id")
    broken = of(nodes, "list").join(kids, ["doc_id", "node_id"], "left").filter(F.col("strays").isNull() | (F.col("strays") > 0))
    typed = nodes.filter((F.col("node_type") != "list") & prop("fake_list_run_ids").isNotNull()).withColumn("strays", F.lit(None).cast("long"))
    return broken.unionByName(typed), {"strays": F.col("strays")}


@node_rule("LINK_TEXT_NON_DESCRIPTIVE", "link")
def _():
    return (F.col("content_kind") == "text") & text.link_text_is_generic(F.col("text")), {"text": F.col("text"), "target": F.col("target")}


@node_rule("LINK_NAME_MISSING", "link")
def _():
    return is_true("link_nameless"), {"target": F.col("target")}


@node_rule("LINK_TARGET_BROKEN", "link")
def _():
    return text.target_is_broken(F.col("target")), {"target": F.col("target")}


def _of_page(name: str, counter: str) -> None:
    @node_rule(name, "document")
    def _():
        return count_of(counter) > 0, {"count": count_of(counter)}


for _name, _counter in (("IFRAME_TITLE_MISSING", "iframes_missing_title"), ("INPUT_AUTOCOMPLETE_MISSING", "inputs_missing_autocomplete"), ("POSITIVE_TABINDEX", "positive_tabindex_count"),
                        ("LABEL_IN_NAME_MISMATCH", "label_in_name_mismatches"), ("FORM_FIELD_UNLABELED", "form_fields_unlabeled")):
    _of_page(_name, _counter)


@node_rule("DOCUMENT_LANGUAGE_MISSING", "document")
def _():
    return text.blank(F.col("language")), {}


@node_rule("DOCUMENT_TITLE_MISSING", "document")
def _():
    return text.title_is_missing(prop("title"), prop("filename")), {"title": prop("title")}


@rule("DOCUMENT_NO_HEADINGS")
def _(nodes):
    full = (F.col("node_type") == "paragraph") & ~text.blank(F.col("text"))
    size = nodes.groupBy("doc_id").agg(F.count_if(F.col("node_type") == "heading").alias("h"), F.count_if(full).alias("p"), F.sum(F.when(full, F.length(text.trimmed(F.col("text")))).otherwise(0)).alias("c"))
    d = of(nodes, "document").filter("source_format = 'docx'").join(size.filter("h = 0 and p >= 12 and c >= 1200"), "doc_id")
    return d, {"paragraphs": F.col("p")}


@rule("READING_ORDER_AMBIGUOUS")
def _(nodes):
    root = of(nodes, "document").select("doc_id", F.col("node_id").alias("root"))
    sections = of(nodes, "section").filter(is_true("reading_order_inverted")).join(root, "doc_id").filter("parent_id = root").drop("root")
    whole = of(nodes, "document").filter(F.coalesce(prop("reading_order"), F.lit("")).isin("ambiguous", "unknown") | (F.coalesce(prop("reading_order_confidence").try_cast("double"), F.lit(1.0)) < 1))
    return sections.unionByName(whole), {}


@node_rule("LOW_CONTRAST_TEXT")
def _():
    fg, bg = color.css_hex(prop("color")), F.coalesce(color.css_hex(prop("background")), F.lit("FFFFFF"))
    low = F.when(prop("color").isNotNull() & prop("runs").isNull(), color.low_contrast(fg, bg, prop("size_pt").try_cast("double"), is_true("bold"))).otherwise(False)
    return low, {"fg": fg, "bg": bg, "ratio": F.round(color.contrast(fg, bg), 2)}


#: A text's colours where they differ within it: the property ``runs``.
RUNS = "array<struct<c:string,sz:double,b:boolean>>"


def run_findings(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts of several colours with a run below the contrast that its size asks for: the worst run is the evidence. Runs are rows."""
    some = nodes.filter(prop("runs").isNotNull())
    runs = some.select("doc_id", "node_id", F.coalesce(color.css_hex(prop("background")), F.lit("FFFFFF")).alias("bg"), F.explode(F.from_json(prop("runs"), RUNS)).alias("r"))
    rated = runs.select("doc_id", "node_id", "bg", F.upper("r.c").alias("fg"), color.required(F.col("r.sz"), F.coalesce("r.b", F.lit(False))).alias("required"), color.contrast(F.col("r.c"), F.col("bg")).alias("ratio"))
    worst = rated.filter("ratio + 0.05 < required").groupBy("doc_id", "node_id").agg(F.min(F.struct("ratio", "fg", "bg")).alias("w"))
    hit = some.join(worst, ["doc_id", "node_id"])
    return hit.select("doc_id", "node_id", *keep, F.lit("LOW_CONTRAST_TEXT").alias("rule_id"), _evidence({"fg": F.col("w.fg"), "bg": F.col("w.bg"), "ratio": F.round("w.ratio", 2)}).alias("evidence"))


RULES["LOW_CONTRAST_TEXT"] = lambda nodes, keep=(): single_node_findings(nodes, ["LOW_CONTRAST_TEXT"], keep).union(run_findings(nodes, keep))


@rule("SLIDE_TITLE_MISSING")
def _(nodes):
    slides = of(nodes, "section").filter(is_true("missing_title"))
    whole = of(nodes, "document").filter(is_true("missing_title")).join(slides.select("doc_id"), "doc_id", "left_anti")
    return slides.unionByName(whole), {}


def is_scanned() -> Column:
    pages = count_of("page_count")
    return (F.col("source_format") == "pdf") & (pages > 0) & (count_of("image_only_pages") >= 0.8 * pages) & (count_of("total_text_chars") / F.when(pages > 0, pages) < 50)


@node_rule("SCANNED_DOCUMENT_NO_TEXT", "document")
def _():
    return is_scanned(), {"pages": count_of("page_count")}


@node_rule("PDF_UNTAGGED", "document")
def _():
    text_enough = (count_of("page_count") > 0) & ~F.coalesce(is_scanned(), F.lit(False)) & (count_of("total_text_chars") >= 200)
    return (F.col("source_format") == "pdf") & ~is_true("pdf_tagged") & text_enough, {"pages": count_of("page_count")}


@node_rule("ANALYSIS_TRUNCATED", "document")
def _():
    return is_true("pages_truncated"), {"processed": prop("pages_processed")}


def audit(nodes: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Findings of all rules, or of those named: doc_id, node_id, rule_id, severity, evidence, violation_id, path, bfs_pos, dfs_pos."""
    names = list(RULES) if only is None else only
    single, tables = ([n for n in names if n in group] for group in (NODE_RULES, TABLE_RULES))
    parts = ([single_node_findings(nodes, single, PLACE)] if single else []) + ([table_findings(nodes, tables, PLACE)] if tables else [])
    parts += [RULES[n](nodes, PLACE) for n in names if n not in NODE_RULES and n not in TABLE_RULES]
    parts += [run_findings(nodes, PLACE)] if "LOW_CONTRAST_TEXT" in names else []
    hits = reduce(DataFrame.union, parts)
    severity = dims.rules(nodes.sparkSession).select("rule_id", "severity")
    vid = F.concat(F.lit("vio-"), F.col("node_id"), F.lit("-"), F.lower("rule_id"))
    return hits.join(F.broadcast(severity), "rule_id").select("doc_id", vid.alias("violation_id"), "node_id", "node_type", "rule_id", "severity", "evidence", "path", "bfs_pos", "dfs_pos")
