"""Fixes as transforms of the node table: each returns the changed values (doc_id, node_id, ...) of the nodes it fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, language, text

ORDER = ("doc_id", "dfs_pos")


def _order() -> Window:
    return Window.partitionBy("doc_id").orderBy("dfs_pos")


def normalized_heading_levels(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, old_level, level): no heading is more than one below the one before, as that one was fixed.

    The fixed level is the least, over the headings up to here, of a heading's level and the headings after it; one window.
    """
    up_to_here = _order().rowsBetween(Window.unboundedPreceding, 0)
    h = nodes.filter("node_type = 'heading'").withColumn("n", F.row_number().over(_order()))
    level = F.when(F.col("n") == 1, F.col("level")).otherwise(F.least(F.lit(6), F.col("n") + F.min(F.col("level") - F.col("n")).over(up_to_here)))
    return h.select("doc_id", "node_id", F.col("level").alias("old_level"), level.cast("int").alias("level")).filter("old_level <> level")


def promoted_headings(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, level) of paragraphs that look like headings: the level of the heading before, else one above the next, else 1."""
    level = F.when(F.col("node_type") == "heading", F.col("level"))
    before = F.last(level, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(level, ignorenulls=True).over(_order().rowsBetween(1, Window.unboundedFollowing))
    like = (F.col("node_type") == "paragraph") & F.coalesce(F.try_element_at("props", F.lit("looks_like_heading")) == "true", F.lit(False))
    # nothing else has a say
    x = nodes.filter(like | (F.col("node_type") == "heading")).select("doc_id", "node_id", "node_type", "dfs_pos", "level", like.alias("like")).withColumns({"b": before, "a": after}).filter("like")
    return x.select("doc_id", "node_id", F.coalesce("b", F.greatest(F.lit(1), F.col("a") - 1), F.lit(1)).alias("level"))


def without_decorative_alt(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("alt_text", F.when((F.col("node_type") == "image") & F.coalesce("is_decorative", F.lit(False)), F.lit(None)).otherwise(F.col("alt_text")))


def table_headers(nodes: DataFrame) -> DataFrame:
    """(doc_id, table_id, mode, width) of tables without header cells: promote the first row if it reads like labels, else add a row of the usual width."""
    cells = nodes.filter("node_type = 'table_cell'").select("doc_id", F.col("parent_id").alias("row_id"), "cell_type", "text")
    rows = nodes.filter("node_type = 'table_row'").select("doc_id", F.col("node_id").alias("row_id"), F.col("parent_id").alias("table_id"), "sibling_pos")
    t = text.trimmed(F.coalesce("text", F.lit("")))
    label = (t != "") & (F.size(F.split(t, r"\s+")) <= 8) & ~t.rlike("[.!?]")
    r = rows.join(cells, ["doc_id", "row_id"]).groupBy("doc_id", "table_id", "row_id", "sibling_pos").agg(F.count("*").alias("width"), F.bool_and(label).alias("labels"), F.bool_or(F.col("cell_type") == "header").alias("head"))
    x = r.groupBy("doc_id", "table_id").agg(F.bool_or("head").alias("head"), F.min_by("labels", "sibling_pos").alias("labels"), F.mode("width", True).alias("width"))
    return x.filter("not head").select("doc_id", "table_id", F.when(F.col("labels"), "promote_first_row").otherwise("add_row").alias("mode"), "width")


def header_scopes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("cell_type = 'header' and coalesce(header_scope, 'none') = 'none'").select("doc_id", "node_id", F.lit("column").alias("header_scope"))


def wrapped_list_children(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, list_id): children of lists that are no items, to be wrapped in one."""
    lists = nodes.filter("node_type = 'list'").select("doc_id", F.col("node_id").alias("list_id"))
    others = nodes.filter("node_type <> 'list_item'").select("doc_id", "node_id", F.col("parent_id").alias("list_id"))
    return others.join(lists, ["doc_id", "list_id"]).select("doc_id", "node_id", "list_id")


def link_texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, text, confidence, needs_review) for links whose text says nothing; suggestions that say nothing are dropped."""
    x = nodes.filter((F.col("node_type") == "link") & text.link_text_is_generic(F.col("text"))).withColumn("new", text.heuristic_link_text(F.col("target"), F.col("text")))
    sure = F.when(F.col("new").startswith("Open"), 0.2).when(text.blank(F.col("target")), 0.3).otherwise(0.45)
    return x.filter(~text.link_text_is_generic(F.col("new"))).select("doc_id", "node_id", F.col("new").alias("text"), sure.alias("confidence"), (sure < 0.6).alias("needs_review"))


def document_titles(nodes: DataFrame) -> DataFrame:
    """(doc_id, title) for documents without a real title: first level-one heading, first heading, the parser's candidate, the file name in words."""
    h = nodes.filter((F.col("node_type") == "heading") & ~text.blank(F.col("text"))).groupBy("doc_id").agg(
        F.min_by("text", F.when(F.col("level") == 1, F.col("dfs_pos"))).alias("h1"), F.min_by("text", "dfs_pos").alias("h"))
    prop = lambda n: F.try_element_at("props", F.lit(n))
    stem = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(prop("filename"), r"\.[^.]*$", ""), r"[-_\s]+", " ")))
    d = nodes.filter(F.col("node_type") == "document").filter(text.title_is_missing(prop("title"), prop("filename"))).join(h, "doc_id", "left")
    real = [F.when(~text.title_is_missing(c), c) for c in (F.col("h1"), F.col("h"), prop("title_candidate"), stem)]
    return d.select("doc_id", F.coalesce(*real).alias("title")).filter("title is not null")


def document_languages(nodes: DataFrame, chars: int = 1500, floor: float = 0.4) -> DataFrame:
    """(doc_id, language, confidence) for documents without one, from their first ``chars`` characters of text."""
    missing = nodes.filter((F.col("node_type") == "document") & text.blank(F.col("language"))).select("doc_id")
    t = nodes.filter("content_kind = 'text' and text <> ''").join(missing, "doc_id", "left_semi")
    before = F.coalesce(F.sum(F.length("text")).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = t.withColumn("before", before).filter(F.col("before") < chars).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dfs_pos", "text"))), lambda x: x["text"]), " ").alias("sample"))
    votes = language.language_votes(F.col("sample"))
    script = language.dominant_script(F.col("sample"))
    x = sample.select("doc_id", script.alias("script"), language.winner(votes).alias("code"), language.vote_confidence(F.greatest(*votes.values())).alias("sure"))
    return x.select("doc_id", F.coalesce("script.code", "code").alias("language"), F.coalesce(F.least(F.lit(0.9), F.col("script.share")), "sure").alias("confidence")).filter(F.col("confidence") >= floor)


def slide_titles(shapes: DataFrame) -> DataFrame:
    t = text.trimmed(F.col("text"))
    return shapes.filter((t != "") & (F.length(t) <= 120)).groupBy("doc_id", "slide").agg(F.min_by(t, F.struct("top", "idx")).alias("title"))


def counter_fixes(nodes: DataFrame) -> DataFrame:
    """(doc_id, action_code, n): fixes that succeed where the page's counter is above 0."""
    pairs = (("FILL_FORM_FIELD_LABELS", "form_fields_derivable"), ("SET_INPUT_AUTOCOMPLETE", "inputs_missing_autocomplete"), ("FIX_POSITIVE_TABINDEX", "positive_tabindex_count"))
    d = nodes.filter("node_type = 'document'")
    rows = F.array(*[F.struct(F.lit(a).alias("action_code"), F.coalesce(F.try_element_at("props", F.lit(c)).try_cast("int"), F.lit(0)).alias("n")) for a, c in pairs])
    return d.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*").filter("n > 0")


def contrast_fixes(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, fg, bg, new_fg) of texts below the contrast their size asks for, without tolerance."""
    prop = lambda n: F.try_element_at("props", F.lit(n))
    x = nodes.filter(prop("color").isNotNull()).select("doc_id", "node_id", color.css_hex(prop("color")).alias("fg"), F.coalesce(color.css_hex(prop("background")), F.lit("FFFFFF")).alias("bg"),
                                                       color.required(prop("size_pt").try_cast("double"), F.coalesce(prop("bold") == "true", F.lit(False))).alias("needed"))
    return x.filter(color.contrast(F.col("fg"), F.col("bg")) < F.col("needed")).withColumn("new_fg", color.nearest_passing(F.col("fg"), F.col("bg"), F.col("needed"))).drop("needed")


def needs_alt_text() -> Column:
    """Whether a node is an image that should have a description and has none that describes."""
    return (F.col("node_type") == "image") & ~F.coalesce("is_decorative", F.lit(False)) & (text.blank(F.col("alt_text")) | text.alt_is_nondescriptive(F.col("alt_text")))


def alt_texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, alt_text) for images without a description, from caption and nearest text; what describes nothing is dropped."""
    near = F.last(F.when(F.col("node_type").isin("heading", "paragraph") & ~text.blank(F.col("text")), F.col("text")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    says = F.col("node_type").isin("heading", "paragraph") & ~text.blank(F.col("text"))
    x = nodes.withColumn("bare", needs_alt_text()).filter(F.col("bare") | says).withColumn("near", near).filter("bare")
    prop = lambda n: F.try_element_at("props", F.lit(n))
    made = F.coalesce(prop("caption"), F.concat_ws(" — ", prop("title"), F.substring("near", 1, 80)))
    return x.select("doc_id", "node_id", F.substring(made, 1, 140).alias("alt_text")).filter(~text.blank(F.col("alt_text")) & ~text.alt_is_nondescriptive(F.col("alt_text")))


def table_captions(nodes: DataFrame, most: int = 6) -> DataFrame:
    """(doc_id, table_id, caption) from a table's header cells."""
    rows = nodes.filter("node_type = 'table_row'").select("doc_id", F.col("node_id").alias("row_id"), F.col("parent_id").alias("table_id"))
    cells = nodes.filter("cell_type = 'header'").filter(~text.blank(F.col("text"))).select("doc_id", F.col("parent_id").alias("row_id"), "dfs_pos", "text")
    x = rows.join(cells, ["doc_id", "row_id"]).groupBy("doc_id", "table_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("dfs_pos", "text"))), 1, most).alias("hs"))
    return x.select("doc_id", "table_id", F.substring(F.concat(F.lit("Table: "), F.array_join(F.transform("hs", lambda h: h["text"]), ", ")), 1, 80).alias("caption"))


def resolved_order(shapes: DataFrame) -> DataFrame:
    """(doc_id, parent_id, node_id, new_pos): siblings with an order hint first, then by the hint's index, top and left."""
    key = Window.partitionBy("doc_id", "parent_id").orderBy(F.col("hint").isNull(), "hint", "sibling_pos", "top", "left")
    return shapes.select("doc_id", "parent_id", "node_id", (F.row_number().over(key) - 1).alias("new_pos"))
