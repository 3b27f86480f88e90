"""Positioned blocks of pages to the node table: running lines out, tables found, columns cut, headings and typed lists told apart.

A block is a row (doc_id, page, block_id, text, size, x0, x1, y, y1, page_height): a piece of text on a page, y counted from the top. Readers of
fixed-layout files yield such rows. Pages are small and documents are not, so the geometry works by windows over (doc_id, page) and parts of it: one shuffle
serves them all.

Null or blank texts are dropped, blocks at one place are read by block_id, a block whose ends are swapped is turned, and one without a place is read last on its page,
and one without a page is on page 0.
Documents all of whose blocks are dropped keep their document and section nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import blank, heading_level_of_trimmed, strip_list_marker, trimmed
from ..operators import layout
from .office import _id, _map, _nodes, _numbered
from .staging import staged
from .tables import dealt

PAGE = ["doc_id", "page"]


def prepared(blocks: DataFrame) -> DataFrame:
    """Blocks with texts, their ends in order; nulls of places become one place below everything."""
    far = F.lit(1e9)
    x = blocks.filter(~blank(F.col("text"))).withColumns({c: F.coalesce(F.col(c).cast("double"), far) for c in ("x0", "x1", "y", "y1")})
    return x.withColumns({"x0": F.least("x0", "x1"), "x1": F.greatest("x0", "x1"), "y": F.least("y", "y1"), "y1": F.greatest("y", "y1")})


def without_running_lines(blocks: DataFrame, band: float = 0.08) -> DataFrame:
    """Blocks but those in the top or bottom ``band`` of a page whose text, or a page number, stands in that band of two pages or more."""
    height = F.col("page_height")
    slot = F.when(F.col("y") < band * height, "top").when((F.col("y") > (1 - band) * height) & (F.col("y") < 1e9), "bottom").otherwise("body")
    x = blocks.withColumn("slot", slot)
    ends = x.filter("slot <> 'body'").withColumn("_key", layout.running_key(F.col("text")))
    lines = layout.running_lines(ends).select("doc_id", "slot", F.col("text").alias("_key"))
    return x.filter("slot = 'body'").unionByName(ends.join(lines, ["doc_id", "slot", "_key"], "left_anti").drop("_key")).drop("slot")


def table_blocks(blocks: DataFrame, tall: float = 4.0, align: float = 10.0) -> DataFrame:
    """(doc_id, page, block_id, text, table_no, row, col) of blocks that are cells of a table: three aligned rows or more of two columns or more with short texts."""
    # pages with less than three lines of two blocks or more have none
    x, down = _downwards(blocks, PAGE)
    starts, ends = F.coalesce(F.col("y") - F.lag("y").over(down) > tall, F.lit(True)), F.coalesce(F.lead("y").over(down) - F.col("y") > tall, F.lit(True))
    x = x.withColumns({"_starts": starts, "_ends": ends}).withColumn("_lines", F.count_if(F.col("_starts") & ~F.col("_ends")).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = layout.islands(x.filter("_lines >= 3").select(*blocks.columns), PAGE, "y", tall).withColumnRenamed("island", "row")
    lines = layout.aligned_rows(rows, align)
    wide = lines.groupBy(*PAGE, "table_no").agg(F.count("*").alias("n"), F.min(F.size("xs")).alias("k")).filter("n >= 3 and k >= 2")
    cells = rows.join(lines.join(wide, [*PAGE, "table_no"], "left_semi").select(*PAGE, "row", "table_no"), [*PAGE, "row"])
    data = layout.data_cells(cells, [*PAGE, "table_no"]).filter("is_data")
    order = Window.partitionBy(*PAGE, "row").orderBy("x0", "block_id")
    return cells.join(data, [*PAGE, "table_no"], "left_semi").withColumn("col", F.row_number().over(order)).select(*PAGE, "block_id", "text", "table_no", "row", "col")


def _fewer_words(words: Column, side: Column, whole: WindowSpec) -> Column:
    """Whether the median of words on a side is 3 at most, told by counts: a median of two middle values lies between them."""
    few, n = F.count_if(side & (words <= 3)).over(whole), F.count_if(side).over(whole)
    middle = F.max(F.when(side & (words <= 3), words)).over(whole) + F.min(F.when(side & (words > 3), words)).over(whole)
    return (2 * few > n) | ((2 * few == n) & ~F.coalesce(middle > 6, F.lit(False)))


def _downwards(x: DataFrame, keys: list[str]) -> tuple[DataFrame, WindowSpec]:
    """Rows with ``_key``, by which parts of pages are told apart fast, and ``line``; and each part from top to bottom, by y, x0 and block_id."""
    x = x.withColumns({"_key": F.xxhash64(*keys), "line": F.floor(F.col("y") / 4)})
    return x, Window.partitionBy("_key", *keys).orderBy("line", "y", "x0", "block_id")


def _cut(x: DataFrame, keys: list[str], gutter: float, fewest: int, share: float, wide: float) -> DataFrame:
    """One cut of every region (by keys) at its widest gutter: ``split`` says where there is one, ``part`` is (band, side) within the region.

    ``goes`` marks sides of a cut region that may be cut again: enough blocks, and one that begins a gutter's width behind the end of another.
    """
    x, down = _downwards(x, keys)
    right = Window.partitionBy("_key", *keys).orderBy("x0", "block_id")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    # the whole region, in an order that the rows are in anyway
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lo, hi = F.min("x0").over(whole), F.max("x1").over(whole)
    # what stands alone at its height, or is wide, has no column beside it and is no witness of a gutter
    alone = F.coalesce(F.col("y") >= F.max("y1").over(before(down)), F.lit(True)) & F.coalesce(F.lead("y").over(down) >= F.max("y1").over(so_far), F.lit(True))
    x = x.withColumns({"lo": lo, "width": hi - lo, "alone": alone, "words": F.size(F.split(trimmed(F.col("text")), r"\s+"))})
    x = x.withColumn("beside", ~F.col("alone") & (F.col("x1") - F.col("x0") <= wide * F.col("width")))
    reach = F.max(F.when(F.col("beside"), F.col("x1"))).over(before(right))
    x = x.withColumn("reach", reach).withColumn("middle", (F.col("reach") + F.col("x0")) / 2 - F.col("lo"))
    fits = F.col("beside") & (F.col("x0") - F.col("reach") >= gutter) & F.col("middle").between(0.3 * F.col("width"), 0.7 * F.col("width"))
    found = F.struct((F.col("x0") - F.col("reach")).alias("gap"), (-F.abs(F.col("middle") - F.col("width") / 2)).alias("off"), F.col("reach").alias("from"), F.col("x0").alias("to"))
    x = x.withColumn("g", F.max(F.when(fits, found)).over(right.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    x = x.withColumns({"cross": (F.col("x0") < F.col("g.to")) & (F.col("x1") > F.col("g.from")), "side": (F.col("x0") >= F.col("g.to")).cast("int")})
    left, here = F.col("side") == 0, ~F.col("cross")
    line = Window.partitionBy("_key", *keys).orderBy("line").rangeBetween(Window.currentRow, Window.currentRow)
    words = F.col("words")
    again = lambda side: (F.max(F.when(here & side, F.col("x0"))).over(whole) - F.min(F.when(here & side, F.col("x1"))).over(whole) >= gutter) | F.isnan(F.max(F.when(here & side, F.greatest("x0", "x1"))).over(whole))
    x = x.withColumns({"crossed": F.sum(F.col("cross").cast("int")).over(so_far), "l": F.count_if(here & left).over(line), "r": F.count_if(here & ~left).over(line), "nl": F.count_if(here & left).over(whole), "nr": F.count_if(here & ~left).over(whole),
                       "fl": _fewer_words(words, here & left, whole), "fr": _fewer_words(words, here & ~left, whole), "al": again(left), "ar": again(~left)})
    # lines are counted by equal parts of their blocks
    paired = F.sum(F.when(here & (F.col("l") == 1) & (F.col("r") == 1), 0.5)).over(whole) / F.sum(F.when(here, 1 / (F.col("l") + F.col("r")))).over(whole)
    both = F.col("nl") + F.col("nr")
    split = F.col("g").isNotNull() & (both >= fewest) & (F.least("nl", "nr") >= share * both) & ~F.col("fl") & ~F.col("fr") & (F.coalesce(F.col("paired"), F.lit(0.0)) < 0.8)
    x = x.withColumn("paired", paired).withColumn("split", F.coalesce(split, F.lit(False)))
    band = F.when(F.col("cross"), 2 * F.col("crossed") - 1).otherwise(2 * F.col("crossed"))
    goes = F.col("split") & here & F.when(left, F.col("al") & (F.col("nl") >= fewest)).otherwise(F.col("ar") & (F.col("nr") >= fewest))
    return x.withColumns({"part": F.array(band.cast("int"), F.when(F.col("cross"), 0).otherwise(F.col("side"))), "goes": F.coalesce(goes, F.lit(False))})


def reading_order(units: DataFrame, gutter: float = 40.0, fewest: int = 8, share: float = 0.3, wide: float = 0.6) -> DataFrame:
    """``units`` (doc_id, page, block_id, text, x0, x1, y, y1) with ``region`` and ``turn``, from 0 on each page: recursive cuts into columns.

    A region is cut at its widest gutter in the middle 40 % of its width, if both sides have enough blocks with sentences and aren't rows of a table. Blocks across the
    gutter, such as headings, part it into bands; a band is read left side first. Every side of every band is then cut in turn, until none can be.
    Units dealt by (doc_id, page) stay where they are for the first cut of all pages, and pages that it settles are done.
    """
    columns = units.columns
    region = F.when(F.col("split"), F.concat("region", "part")).otherwise(F.col("region"))
    order = Window.partitionBy(*PAGE).orderBy("region", "y", "x0", "block_id")
    first = _cut(units, PAGE, gutter, fewest, share, wide).withColumns({"region": F.array().cast("array<int>")}).withColumn("region", region)
    keyed = Window.partitionBy("_key", *PAGE).orderBy("region", "y", "x0", "block_id")
    opened = F.max("goes").over(keyed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = staged(first.select(*columns, "region", "goes", opened.alias("open"), (F.row_number().over(keyed) - 1).alias("turn")), "regions")
    done, cut = first.filter("not open").select(*columns, "region", "turn"), first.filter("open")
    settled = []
    while True:
        settled.append(cut.filter("not goes").select(*columns, "region"))
        rest = cut.filter("goes").select(*columns, "region")
        if rest.isEmpty():
            break
        cut = staged(_cut(rest, [*PAGE, "region"], gutter, fewest, share, wide).withColumn("region", region).select(*columns, "region", "goes"), "regions")
    if len(settled) == 1:  # no page is open
        return done
    return done.unionByName(staged(reduce(DataFrame.unionByName, settled).withColumn("turn", F.row_number().over(order) - 1), "regions"))


def _header_cells(cells: DataFrame) -> DataFrame:
    """Cells of found tables with ``header``: those of the row that may be called the table's header."""
    head = layout.header_rows(cells.withColumn("col_span", F.lit(1)), [*PAGE, "table_no"])
    return cells.join(head, [*PAGE, "table_no"], "left").withColumn("header", F.coalesce(F.col("row") == F.col("header_row"), F.lit(False)))


def positioned_nodes(blocks: DataFrame, band: float = 0.08, **cuts: float) -> DataFrame:
    """The node table of documents given as blocks: a section for each page; headings, paragraphs, typed lists and tables in reading order.

    A heading is a block that reads like one, or is set in a larger size than the body. A table is read where its first cell stands and has a row of headers only
    on evidence. Two blocks or more in a row that are typed like items of one list become a list, under the page where it begins. ``cuts`` go to ``reading_order``.
    """
    paged = blocks.withColumn("page", F.coalesce(F.col("page").cast("int"), F.lit(0)))
    known = staged(paged.select(*PAGE, "block_id", "text", "size", "x0", "x1", "y", "y1", "page_height"), "blocks")
    body = staged(without_running_lines(prepared(known), band), "blocks")
    in_table = staged(table_blocks(dealt(body, known, *PAGE)), "cells")
    units = body.select(*PAGE, "block_id", "text", "size", "x0", "x1", "y", "y1", F.lit(None).cast("long").alias("table_no"))
    if not in_table.isEmpty():
        # a table is one unit of the reading order
        pages_of = in_table.select(*PAGE).distinct()
        x = units.drop("table_no").join(pages_of, PAGE, "left_semi").join(in_table.drop("text"), [*PAGE, "block_id"], "left")
        boxes = x.filter("table_no is not null").groupBy(*PAGE, "table_no").agg(
            F.min("block_id").alias("block_id"), F.lit("").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y"), F.max("y1").alias("y1"))
        single = x.filter("table_no is null").select(*units.columns)
        units = units.join(pages_of, PAGE, "left_anti").unionByName(single).unionByName(boxes, allowMissingColumns=True)
    turns = reading_order(dealt(units, known, *PAGE), **cuts).select(*PAGE, "block_id", "table_no", "turn", "text", "size")
    levels = staged(layout.size_levels(body), "sizes")
    large = F.lit(None).cast("int")
    if not levels.isEmpty():
        turns, large = turns.join(levels.select("doc_id", "size", F.col("level").cast("int").alias("size_level")), ["doc_id", "size"], "left"), F.col("size_level")
    marked = layout.is_list_item(F.col("text"))
    short = F.length("_t") <= 120
    flow = turns.withColumn("_t", trimmed(F.col("text"))).withColumns({"item": marked, "level": F.when(F.col("table_no").isNull() & short & (~marked | large.isNotNull()), F.coalesce(large, heading_level_of_trimmed(F.col("_t"))))})
    flow = staged(flow.select(*PAGE, "block_id", "table_no", "turn", "text", "size", "level", (F.col("item") & F.col("level").isNull() & F.col("table_no").isNull()).alias("item")), "flow")
    # typed lists: runs in the reading order of the whole document; whatever is no plain text parts them. An item alone on its page but for its ends is in none
    sizes = flow.groupBy(*PAGE).agg(F.count("*").alias("units"))
    base = F.coalesce(F.sum("units").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = Window.partitionBy(*PAGE).orderBy("turn")
    beside = F.coalesce(F.lag("turn").over(near) == F.col("turn") - 1, F.lit(False)) | F.coalesce(F.lead("turn").over(near) == F.col("turn") + 1, F.lit(False))
    items = flow.filter("item").drop("item", "table_no", "level").join(sizes.select(*PAGE, "units", base.alias("base")), PAGE)
    items = staged(items.withColumns({"pos": (F.col("base") + F.col("turn") + 1).cast("int"), "near": beside | (F.col("turn") == 0) | (F.col("turn") == F.col("units") - 1)}).drop("base", "units"), "items")
    runs = layout.fake_list_runs(items.filter("near").select("doc_id", "pos", "text"), gaps=False)
    span = runs.select("doc_id", "kind", F.col("first_pos").alias("list_no"), F.explode(F.sequence("first_pos", F.col("first_pos") + F.col("items").cast("int") - 1)).alias("pos"))
    in_list = staged(items.filter("near").drop("near").join(span, ["doc_id", "pos"]).withColumn("list_page", F.min("page").over(Window.partitionBy("doc_id", "list_no"))), "items")
    plain = flow.filter("table_no is null and not item").select(*PAGE, "block_id", "turn", "text", "size", "level").unionByName(
        items.join(in_list, ["doc_id", "pos"], "left_anti").select(*PAGE, "block_id", "turn", "text", "size", F.lit(None).cast("int").alias("level")))
    pdf = F.lit("pdf").alias("format")
    plain, items = plain.withColumn("format", pdf), in_list.withColumn("format", pdf)
    lists = items.groupBy("doc_id", "format", "list_page", "list_no").agg(F.first("kind").alias("kind"), F.min_by(F.struct("page", "turn"), "pos").alias("t"))
    pages = known.select(*PAGE).distinct().withColumn("format", pdf)
    # a title is 1.25 times as large as something
    first = staged(body.groupBy("doc_id").agg(F.min("page").alias("page"), F.min("size").alias("least"), F.max("size").alias("most")).filter("most >= 1.25 * least").select(*PAGE), "titles")
    documents = pages.groupBy("doc_id", "format").agg(F.count("*").alias("pages"))
    documents = documents.withColumn("title", F.lit(None).cast("string")) if first.isEmpty() else documents.join(layout.title_candidates(body.join(first, PAGE)), "doc_id", "left")
    tables = flow.filter("table_no is not null").select(*PAGE, "table_no", "turn")
    cells = _header_cells(in_table).join(tables, [*PAGE, "table_no"]).withColumn("format", F.lit("pdf"))
    doc, page = F.lit("doc"), F.col("page")
    section = F.concat(F.lit("s-"), page)
    at = [F.lit(1), page, F.lit(1), F.col("turn")]
    t, r = _id("t", "page", "table_no"), _id("r", "page", "table_no", "row")
    header = F.col("header") & ~blank(F.col("text"))
    size = _map(size_pt=F.col("size"))
    list_section, list_id = F.concat(F.lit("s-"), F.col("list_page")), F.concat(F.lit("l-"), F.col("list_no"))
    # an item is placed behind its list by the list's own turn, so a list that goes on over a page stays whole
    items = items.drop("format").join(lists.select("doc_id", "list_no", "format", F.col("t.page").alias("t_page"), F.col("t.turn").alias("t_turn")), ["doc_id", "list_no"])
    return _numbered([
        _nodes(documents, "document", [doc], [F.lit(0)], props=_map(page_count=F.col("pages"), title_candidate=F.col("title"))),
        _nodes(pages, "section", [doc, section], [F.lit(1), page, F.lit(0)], text=F.concat(F.lit("Page "), page), page=page),
        _nodes(plain, F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph"), [doc, section, F.when(F.col("level").isNotNull(), _id("h", "page", "block_id")).otherwise(_id("p", "page", "block_id"))], at,
               text=trimmed(F.col("text")), level=F.col("level"), page=page, props=size),
        _nodes(lists, "list", [doc, list_section, list_id], [F.lit(1), F.col("t.page"), F.lit(1), F.col("t.turn")], ordered=F.col("kind") == "decimal", marker=F.col("kind"), page=F.col("t.page")),
        _nodes(items, "list_item", [doc, list_section, list_id, _id("i", "page", "block_id")], [F.lit(1), F.col("t_page"), F.lit(1), F.col("t_turn"), F.col("pos")], text=strip_list_marker(F.col("text")), page=page),
        _nodes(tables.withColumn("format", F.lit("pdf")), "table", [doc, section, t], at, page=page),
        _nodes(cells.dropDuplicates([*PAGE, "table_no", "row"]), "table_row", [doc, section, t, r], [*at, F.col("row")], page=page),
        _nodes(cells, "table_cell", [doc, section, t, r, _id("c", "page", "table_no", "row", "col")], [*at, F.col("row"), F.col("col")], text=trimmed(F.col("text")), page=page,
               cell_type=F.when(header, "header").otherwise("data"), header_scope=F.when(header, "column").otherwise("none")),
    ], known)
