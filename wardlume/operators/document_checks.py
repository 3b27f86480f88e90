"""Checks of whole documents by their counters: what a PDF, Word or slide file has and lacks, without a node table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text

#: Counters of a document, and what holds where a source has none.
COUNTERS = ("images", "figures", "figures_missing_alt", "headings", "outline_entries", "form_fields", "unlabeled_fields", "hyperlinks", "generic_links", "invalid_links", "tables", "th", "td",
            "tables_missing_headers", "header_scope_flags", "heading_jumps", "empty_headings", "slides_missing_title", "backward_pages", "disordered_slides")


def link_counters(links: DataFrame) -> DataFrame:
    """Of (doc_id, text, target): hyperlinks, those with a generic label, those whose target is invalid; links without text only count."""
    label = F.lower(text.trimmed(F.coalesce("text", F.lit(""))))
    return links.groupBy("doc_id").agg(F.count("*").alias("hyperlinks"), F.count_if(label.isin(*fixed.GENERIC_LINK_LABELS)).alias("generic_links"),
                                       F.count_if((label != "") & (text.invalid_link_reason(F.col("target")) != "")).alias("invalid_links"))


def heading_counters(headings: DataFrame) -> DataFrame:
    """Of (doc_id, pos, level, text): headings, jumps over a level, empty ones."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    x = headings.withColumn("jump", F.col("level") > F.lag("level").over(order) + 1)
    return x.groupBy("doc_id").agg(F.count("*").alias("headings"), F.count_if("jump").alias("heading_jumps"), F.count_if(text.blank(F.col("text"))).alias("empty_headings"))


def table_counters(tables: DataFrame) -> DataFrame:
    """Of (doc_id, table_no, head: labels of the first row or null): tables, those without labels, those whose labels want a review.

    A review is due where several cells share one label, or a label says nothing.
    """
    labels = F.filter(F.transform(F.coalesce("head", F.array().cast("array<string>")), lambda c: F.lower(text.trimmed(F.coalesce(c, F.lit(""))))), lambda c: c != "")
    bare = F.size(labels) == 0
    same = (F.size("head") > 1) & (F.size(F.array_distinct(labels)) <= 1)
    empty = F.arrays_overlap(labels, F.array(*[F.lit(x) for x in fixed.GENERIC_HEADERS]))
    return tables.groupBy("doc_id").agg(F.count("*").alias("tables"), F.count_if(bare).alias("tables_missing_headers"), F.count_if(~bare & (same | empty)).alias("header_scope_flags"))


def document_counters(documents: DataFrame, *parts: DataFrame) -> DataFrame:
    """Documents (doc_id, format, title, language, tagged) with all COUNTERS: those of the parts, by doc_id, and 0 for the rest."""
    x = reduce(lambda a, b: a.join(b, "doc_id", "left"), parts, documents)
    return x.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in x.columns else F.lit(0).cast("long") for c in COUNTERS})


def _checks() -> list[tuple[str, str, Column]]:
    """(rule, severity, condition) in the order of the report."""
    pdf, docx, pptx = (F.col("format") == f for f in ("pdf", "docx", "pptx"))
    tagged, office = F.coalesce("tagged", F.lit(False)), docx | pptx
    n = {c: F.col(c) for c in COUNTERS}
    some = {c: v > 0 for c, v in n.items()}
    untitled = text.blank(F.col("title"))
    no_headers = (pdf & tagged & some["tables"] & (n["th"] == 0)) | (office & some["tables"] & some["tables_missing_headers"])
    sparse = tagged & some["tables"] & some["th"] & some["td"] & (n["th"] <= F.greatest(F.lit(1), F.floor(n["td"] / 20)))
    no_headings = n["headings"] == 0
    return [
        ("document_title_missing", "error", pdf & untitled), ("missing_document_title", "warning", office & untitled), ("missing_language", "warning", office & text.blank(F.col("language"))),
        ("missing_tag_structure", "error", pdf & ~tagged), ("images_not_tagged", "warning", pdf & ~tagged & some["images"]),
        ("missing_alt_text", "error", (pdf & tagged & some["figures"] & some["figures_missing_alt"]) | (pptx & some["figures_missing_alt"])), ("missing_alt_text", "warning", docx & some["images"]),
        ("missing_heading_structure", "warning", ((pdf & tagged) | office) & no_headings), ("missing_outline", "warning", pdf & ~tagged & (n["outline_entries"] == 0)),
        ("unlabeled_form_field", "info", pdf & some["unlabeled_fields"]), ("generic_link_text", "warning", some["hyperlinks"] & some["generic_links"]), ("invalid_link_target", "warning", some["hyperlinks"] & some["invalid_links"]),
        ("table_missing_headers", "warning", no_headers), ("table_header_scope_review", "warning", (pdf & sparse) | (docx & some["header_scope_flags"])),
        ("skipped_heading_level", "warning", (pdf | docx) & some["heading_jumps"]), ("empty_heading_text", "warning", docx & some["empty_headings"]),
        ("missing_slide_titles", "warning", pptx & ~no_headings & some["slides_missing_title"]), ("reading_order", "warning", (pdf & some["backward_pages"]) | (pptx & some["disordered_slides"])),
    ]


def document_issues(counted: DataFrame) -> DataFrame:
    """(doc_id, pos, rule_id, severity): the issues of documents with COUNTERS, one row each, in the order of the report."""
    cases = [F.when(hit, F.struct(F.lit(i).alias("pos"), F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for i, (r, s, hit) in enumerate(_checks())]
    return counted.select("doc_id", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*")


def scan_issues(findings: DataFrame) -> DataFrame:
    """Findings as the scan reports them: a missing title is an error there, decorative images with text a warning; with a sentence."""
    severity = F.when(F.col("rule_id") == "DOCUMENT_TITLE_MISSING", "error").when(F.col("rule_id") == "DECORATIVE_IMAGE_WITH_ALT", "warning").otherwise(F.col("severity"))
    said = F.when(F.col("rule_id") == "DOCUMENT_TITLE_MISSING", "Document title is missing.").when(F.col("rule_id") == "DECORATIVE_IMAGE_WITH_ALT", "Decorative image has alternative text.").otherwise(
        F.concat(F.initcap(F.replace("rule_id", F.lit("_"), F.lit(" "))), F.lit(".")))
    return findings.withColumns({"issue_id": F.concat_ws("-", F.lit("issue"), "node_id", F.lower("rule_id")), "severity": severity, "description": said})


def batch_stats(items: DataFrame) -> DataFrame:
    """One row of (status, remediate_status, score, issues, applied, extension) rows: done, failed, mean score to a tenth, issues, credits for what is still to be fixed."""
    done, todo = F.col("status") == "done", (F.col("status") == "done") & F.col("remediate_status").isin("idle", "error")
    mean = F.coalesce(F.floor(F.avg(F.when(done, F.coalesce("score", F.lit(0)))) * 10 + 0.5) / 10, F.lit(0.0))
    return items.agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(F.col("status") == "error").alias("errored"), mean.alias("average_score"),
                     F.coalesce(F.sum(F.when(done, F.coalesce("issues", F.lit(0)))), F.lit(0)).alias("issues"), F.count_if(todo).alias("to_fix"),
                     F.coalesce(F.sum(F.when(todo, text.credit_cost(F.col("extension")))), F.lit(0)).alias("credits"),
                     F.coalesce(F.sum(F.when(F.col("remediate_status") == "remediated", F.coalesce("applied", F.lit(0)))), F.lit(0)).alias("applied"))
