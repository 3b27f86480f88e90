"""Structure from positioned text: heading sizes, titles, running lines, columns, tables, reading order, typed lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import list_marker, trimmed
from .ledger import folded


def size_levels(blocks: DataFrame, factor: float = 1.15) -> DataFrame:
    """(doc_id, size, level): sizes over ``factor`` times the body size (most characters, the smaller of equals), the largest first."""
    by_size = blocks.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"))
    body = by_size.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body"))
    large = by_size.join(body, "doc_id").filter(F.col("size") > F.col("body") * factor)
    return large.withColumn("level", F.least(F.lit(6), F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))))).select("doc_id", "size", "level")


def heading_sizes(blocks: DataFrame, factor: float = 1.15) -> DataFrame:
    """Blocks with a heading level by font size, as ``size_levels`` has them."""
    return blocks.join(size_levels(blocks, factor), ["doc_id", "size"], "left")


def title_candidates(blocks: DataFrame) -> DataFrame:
    """(doc_id, title): the one block of the largest size, if that is 1.25 times the commonest or more, 120 characters at most and no page number."""
    x = blocks.groupBy("doc_id").agg(F.max("size").alias("top"), F.mode("size", True).alias("usual"))
    top = blocks.join(x, "doc_id").filter("size = top").groupBy("doc_id").agg(F.count("*").alias("n"), F.first("text").alias("title"), F.first("top").alias("top"), F.first("usual").alias("usual"))
    return top.filter((F.col("n") == 1) & (F.col("top") >= 1.25 * F.col("usual")) & (F.length("title") <= 120) & ~is_page_number(F.col("title"))).select("doc_id", trimmed(F.col("title")).alias("title"))


def is_page_number(c: Column) -> Column:
    return F.lower(trimmed(c)).rlike(r"^(page\s+)?[-–]?\s*(\d{1,4}|[ivxlc]{1,6})\s*[-–]?(\s*(of|/)\s*\d{1,4})?$")


def is_numeric_cell(c: Column) -> Column:
    return trimmed(c).rlike(r"^[($€£+\-]*\d[\d,.\s]*[%)]?$")


def is_list_item(c: Column) -> Column:
    """Whether ``list_marker`` finds one, asked at once."""
    return F.coalesce(c.rlike(r"^\s*([-*•‣◦–—·]|\d{1,3}[.)])\s+\S"), F.lit(False))


def running_key(c: Column) -> Column:
    """What a running line is known by: its text, or that it is a page number."""
    return F.when(is_page_number(c), "#").otherwise(F.lower(trimmed(c)))


def running_lines(blocks: DataFrame) -> DataFrame:
    """(doc_id, slot, text): headers and footers, the same text in the same slot on two pages or more, or page numbers there."""
    return blocks.filter(F.col("slot").isin("top", "bottom")).groupBy("doc_id", "slot", running_key(F.col("text")).alias("text")).agg(F.count_distinct("page").alias("pages")).filter("pages >= 2")


def two_columns(blocks: DataFrame, min_gap: float = 40.0) -> DataFrame:
    """(doc_id, page, gutter): pages with a gutter in the middle 40 % of their width, wordy on both sides, whose lines are not rows of a table."""
    order = Window.partitionBy("doc_id", "page").orderBy("x0").rowsBetween(Window.unboundedPreceding, -1)
    gaps = blocks.withColumns({"reach": F.max("x1").over(order), "width": F.max("page_width").over(Window.partitionBy("doc_id", "page"))})
    gaps = gaps.filter((F.col("x0") - F.col("reach") >= min_gap) & ((F.col("x0") + F.col("reach")) / 2).between(0.3 * F.col("width"), 0.7 * F.col("width")))
    g = gaps.groupBy("doc_id", "page").agg(F.max_by(F.struct("reach", "x0"), F.col("x0") - F.col("reach")).alias("g"))
    words = F.size(F.split(trimmed(F.col("text")), r"\s+"))
    sided = blocks.join(g, ["doc_id", "page"]).withColumns({"left": F.col("x1") <= F.col("g.reach"), "words": words, "band": F.floor(F.col("y") / 4)})
    paired = sided.groupBy("doc_id", "page", "band").agg(F.count_if("left").alias("l"), F.count_if(~F.col("left")).alias("r")).groupBy("doc_id", "page").agg(
        (F.count_if((F.col("l") == 1) & (F.col("r") == 1)) / F.count("*")).alias("paired"))
    sides = sided.groupBy("doc_id", "page").agg(F.median(F.when(F.col("left"), F.col("words"))).alias("lw"), F.median(F.when(~F.col("left"), F.col("words"))).alias("rw"), F.first("g").alias("g"))
    return sides.join(paired, ["doc_id", "page"]).filter("lw > 3 and rw > 3 and paired < 0.8").select("doc_id", "page", ((F.col("g.reach") + F.col("g.x0")) / 2).alias("gutter"))


def islands(rows: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """Rows numbered by island: a new one starts where ``at`` is more than ``gap`` above the value before."""
    order = Window.partitionBy(*keys).orderBy(at)
    start = F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", start).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def clusters(values: DataFrame, keys: list[str], at: str, tolerance: float) -> DataFrame:
    """Means of one-dimensional clusters: values chained by gaps of ``tolerance`` at most."""
    return islands(values, keys, at, tolerance).groupBy(*keys, "island").agg(F.avg(at).alias("center"), F.count("*").alias("n"))


def aligned_rows(rows: DataFrame, align: float = 10.0) -> DataFrame:
    """(doc_id, page, row, xs, table_no) of blocks with a row: rows of equally many aligned columns, one after the other, have one table_no."""
    shape = rows.groupBy("doc_id", "page", "row").agg(F.sort_array(F.collect_list("x0")).alias("xs"), F.min("y").alias("y"))
    order = Window.partitionBy("doc_id", "page").orderBy("row")
    before, far = F.lag("xs").over(order), F.col("y") - F.lag("y").over(order)
    usual = F.median("gap").over(Window.partitionBy("doc_id", "page"))
    like = (F.size("xs") >= 2) & (F.size("xs") == F.size("before")) & F.forall(F.zip_with("xs", "before", lambda a, b: F.abs(a - b) <= align), lambda x: x)
    x = shape.withColumns({"before": before, "gap": far}).withColumn("usual", usual).withColumn("joined", F.coalesce(like & (F.col("gap") <= 2.2 * F.col("usual")), F.lit(False)))
    return x.withColumn("table_no", F.sum((~F.col("joined")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def table_groups(blocks: DataFrame, tall: float = 4.0, align: float = 10.0) -> DataFrame:
    """(doc_id, page, table_no, rows, columns): three rows or more of equally many aligned columns, one after the other."""
    x = aligned_rows(islands(blocks, ["doc_id", "page"], "y", tall).withColumnRenamed("island", "row"), align)
    return x.groupBy("doc_id", "page", "table_no").agg(F.count("*").alias("rows"), F.first(F.size("xs")).alias("columns")).filter("rows >= 3 and columns >= 2")


def data_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per table: median words of a cell, share of long cells, numeric share below the first row, and whether it is data with a header row."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    first = F.col("row") == F.min("row").over(Window.partitionBy(*keys))
    x = cells.withColumns({"words": words, "first": first, "numeric": is_numeric_cell(F.col("text"))}).groupBy(*keys).agg(
        F.median("words").alias("median_words"), F.avg((F.col("words") > 12).cast("double")).alias("long_share"), F.avg(F.when(~F.col("first"), F.col("numeric").cast("double"))).alias("numeric_share"),
        F.coalesce(F.bool_or(F.when(F.col("first"), F.col("numeric"))), F.lit(False)).alias("numeric_head"))
    data = (F.col("median_words") <= 3) & (F.col("long_share") < 0.2)
    return x.withColumns({"is_data": data, "header_row": data & ~F.col("numeric_head") & (F.coalesce("numeric_share", F.lit(0.0)) > 0)})


def covered_length(intervals: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Length of the union of intervals, per key."""
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("_add", F.greatest(F.lit(0.0), F.col(hi) - F.greatest(F.col(lo), F.coalesce(reach, F.col(lo))))).groupBy(*keys).agg(F.sum("_add").alias("covered"))


def rules_present(intervals: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Whether drawn lines cover 60 % of each span (key, s0, s1); a span without length is always covered."""
    inside = intervals.join(spans, keys).filter("hi > s0 and lo < s1").select(*keys, F.greatest("lo", "s0").cast("double").alias("lo"), F.least("hi", "s1").cast("double").alias("hi"))
    return spans.join(covered_length(inside, keys, "lo", "hi"), keys, "left").withColumn("present", (F.col("s1") <= F.col("s0")) | (F.coalesce("covered", F.lit(0.0)) >= 0.6 * (F.col("s1") - F.col("s0"))))


def ruling_bands(lines: DataFrame, apart: float = 200.0) -> DataFrame:
    """(doc_id, page, band, top, bottom, verticals): bands of horizontal lines and the vertical lines that overlap each."""
    flat = islands(lines.filter("kind = 'h'"), ["doc_id", "page"], "y0", apart).groupBy("doc_id", "page", "island").agg(F.min("y0").alias("top"), F.max("y0").alias("bottom"), F.count("*").alias("horizontals")).withColumnRenamed("island", "band")
    up = lines.filter("kind = 'v'").select("doc_id", "page", F.col("y0").alias("v0"), F.col("y1").alias("v1"))
    hit = flat.join(up, ["doc_id", "page"]).filter("v0 < bottom and v1 > top").groupBy("doc_id", "page", "band").agg(F.count("*").alias("verticals"))
    return flat.join(hit, ["doc_id", "page", "band"], "left").fillna(0, ["verticals"])


def cell_spans(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (row, col, right_rule) merged to the right where the rule between is missing: the first cell of each run and its span."""
    order = Window.partitionBy(*keys, "row").orderBy("col")
    start = F.coalesce(F.lag("right_rule").over(order), F.lit(True)).cast("int")
    x = cells.withColumn("_s", start).withColumn("run", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "row", "run").agg(F.min("col").alias("col"), F.count("*").cast("int").alias("col_span")).drop("run")


def nested_levels(items: DataFrame, step: float = 12.0) -> DataFrame:
    """List items with a nesting level from their indents: deeper by more than ``step`` opens a level, shallower closes levels.

    A fold over one list's items in order that carries only the open levels, however long the list is.
    """

    def level(opened: list[float], r: tuple) -> tuple:
        while opened and r.x0 < opened[-1] - step:
            opened.pop()
        if not opened or r.x0 > opened[-1] + step:
            opened.append(r.x0)
        return r.doc_id, r.list_id, r.pos, len(opened) - 1

    rows = items.select(F.to_json(F.struct("doc_id", "list_id")).alias("key"), "pos", "doc_id", "list_id", "x0")
    return folded(rows, ["pos"], list, level, "doc_id long, list_id string, pos int, nesting int")


def backward_pages(tags: DataFrame) -> DataFrame:
    """(doc_id, node_id, page, before): the first tag in reading order whose page is before the one reached."""
    order = Window.partitionBy("doc_id").orderBy("dfs_pos")
    x = tags.filter("page is not null").withColumn("before", F.lag("page").over(order)).filter("page < before")
    return x.groupBy("doc_id").agg(F.min_by(F.struct("node_id", "page", "before"), "dfs_pos").alias("x")).select("doc_id", "x.*")


def first_skips(tags: DataFrame) -> DataFrame:
    """(doc_id, node_id, level, before): the first heading tag that skips a level."""
    order = Window.partitionBy("doc_id").orderBy("dfs_pos")
    x = tags.withColumn("level", F.regexp_extract("tag", "^H([1-6])$", 1).try_cast("int")).filter("level is not null").withColumn("before", F.lag("level").over(order)).filter("level > before + 1")
    return x.groupBy("doc_id").agg(F.min_by(F.struct("node_id", "level", "before"), "dfs_pos").alias("x")).select("doc_id", "x.*")


def tag_summary(tags: DataFrame) -> DataFrame:
    x = tags.groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.count_if((F.col("tag") == "Figure") & (trimmed(F.coalesce("alt", F.lit(""))) == "")).alias("bare"))
    return x.groupBy("doc_id").agg(F.sum("n").alias("nodes"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "n")))).alias("tag_counts"),
                                   F.coalesce(F.sum(F.when(F.col("tag") == "Figure", F.col("n"))), F.lit(0)).alias("figures"), F.sum("bare").alias("figures_missing_alt"))


def slide_disorder(shapes: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id", "slide").orderBy("idx")
    return shapes.withColumn("up", F.col("top") < F.lag("top").over(order)).groupBy("doc_id", "slide").agg(F.count_if("up").alias("disorder"))


def inverted_slides(shapes: DataFrame, margin: int = 182_880) -> DataFrame:
    """(doc_id, slide): an earlier shape lies wholly below a later one. The lowest end of later shapes settles it, without pairs."""
    real = shapes.filter((F.length(trimmed(F.col("text"))) >= 12) & (F.col("height") > 0))
    later = Window.partitionBy("doc_id", "slide").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    return real.withColumn("least", F.min(F.col("top") + F.col("height")).over(later)).filter(F.col("top") > F.col("least") + margin).select("doc_id", "slide").distinct()


def fake_list_runs(paragraphs: DataFrame, gaps: bool = True) -> DataFrame:
    """(doc_id, run, kind, items): two or more paragraphs in a row that are typed like items of one list; numbers go on from 1.

    Without ``gaps``, only those whose pos follow one another are in a row, so paragraphs that belong to no list may be left out.
    """
    m = list_marker(F.col("text"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    x = paragraphs.select("doc_id", "pos", m.alias("m")).withColumns({"kind": F.col("m.kind"), "mark": F.col("m.mark"), "ordinal": F.col("m.ordinal")})
    same = (F.col("kind") == F.lag("kind").over(order)) & (F.col("mark") == F.lag("mark").over(order)) & (F.col("ordinal").isNull() | (F.col("ordinal") == F.lag("ordinal").over(order) + 1))
    if not gaps:
        same = same & (F.col("pos") == F.lag("pos").over(order) + 1)
    x = x.withColumn("run", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("kind is not null")
    return x.groupBy("doc_id", "run").agg(F.first("kind").alias("kind"), F.count("*").alias("items"), F.min("pos").alias("first_pos"), F.min("ordinal").alias("first_ordinal")).filter("items >= 2 and coalesce(first_ordinal, 1) = 1").drop("first_ordinal")


def looks_like_heading(style: Column, text: Column, all_bold: Column, size_pt: Column) -> Column:
    """A paragraph set like a heading: by style, or short, without a full stop, all bold and 14 points or more."""
    t = trimmed(F.coalesce(text, F.lit("")))
    words = F.size(F.split(t, r"\s+"))
    return F.lower(F.coalesce(style, F.lit(""))).isin("title", "subtitle") | ((t != "") & (F.length(t) <= 60) & (words <= 8) & ~t.rlike(r"[.!?;,:]$") & F.coalesce(all_bold, F.lit(False)) & (F.coalesce(size_pt, F.lit(0.0)) >= 14))


def merged_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (row, col, right_rule, bottom_rule) merged where the rules between them are missing: first row and column of each merged cell, its row_span and col_span.

    A run to the right goes on downwards where no cell of it has a rule below and the next row has a run of the same columns; so merged cells are always rectangles.
    An unknown rule counts as drawn: a merge is only claimed on evidence.
    """
    drawn = cells.withColumns({c: F.coalesce(c, F.lit(True)) for c in ("right_rule", "bottom_rule")})
    order = Window.partitionBy(*keys, "row").orderBy("col")
    start = F.coalesce(F.lag("right_rule").over(order) | (F.lag("col").over(order) + 1 != F.col("col")), F.lit(True)).cast("int")
    x = drawn.withColumn("_start", start).withColumn("run", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy(*keys, "row", "run").agg(F.min("col").alias("col"), F.count("*").cast("int").alias("col_span"), F.bool_or("bottom_rule").alias("closed"))
    down = Window.partitionBy(*keys, "col", "col_span").orderBy("row")
    top = F.coalesce(F.lag("closed").over(down) | (F.lag("row").over(down) + 1 != F.col("row")), F.lit(True)).cast("int")
    stacks = runs.withColumn("_top", top).withColumn("stack", F.sum("_top").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return stacks.groupBy(*keys, "col", "col_span", "stack").agg(F.min("row").alias("row"), F.count("*").cast("int").alias("row_span")).select(*keys, "row", "col", "row_span", "col_span")


def header_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header_row): the row of each table of cells (row, col, col_span, text) that may be called its header, else null.

    The first row, if it has text and no number and a row follows. A first row that is one cell over the whole table is a title: then the second, on the same
    terms, and only if it isn't such a band too and a number stands further below.
    """
    blank, number = trimmed(F.coalesce("text", F.lit(""))) == "", F.coalesce(is_numeric_cell(F.col("text")), F.lit(False))
    rows = cells.groupBy(*keys, "row").agg(F.bool_or(~blank).alias("said"), F.bool_or(number).alias("numeric"), F.min_by("col_span", "col").alias("lead"), F.max(F.col("col") + F.col("col_span")).alias("right"), F.min("col").alias("left"))
    table, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("row")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    x = rows.withColumns({"no": F.row_number().over(order), "n_rows": F.count("*").over(table), "full": F.col("lead") >= F.max("right").over(table) - F.min("left").over(table), "evidence": F.coalesce(F.bool_or("numeric").over(after), F.lit(False))})
    x = x.withColumns({"title": F.bool_or((F.col("no") == 1) & F.col("full")).over(table), "labels": F.col("said") & ~F.col("numeric") & (F.col("no") < F.col("n_rows"))})
    fits = F.col("labels") & ~F.col("full") & F.when(F.col("title"), (F.col("no") == 2) & (F.col("n_rows") >= 3) & F.col("evidence")).otherwise(F.col("no") == 1)
    return x.groupBy(*keys).agg(F.min(F.when(fits, F.col("row"))).alias("header_row"))
