"""Registered queries of positioned pages: blocks and grids derived from whole shipped tables, placed so that SQL knows how they are to be read."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import layout
from .registry import Derived, query
from .sources import positioned
from .sources.tables import dealt, numbered, table

# a grid of four orders by their lines; a rule is drawn by the number of the supplier
GRID = Derived("lineitem", {
    "doc_id": "CAST(floor(l_orderkey / 4) AS BIGINT)", "row": "CAST(l_linenumber AS INT)", "col": "CAST(l_orderkey % 4 AS INT)",
    "right_rule": "l_suppkey % 3 > 0", "bottom_rule": "l_suppkey % 2 > 0",
    "text": "CASE l_partkey % 5 WHEN 0 THEN '12,5' WHEN 1 THEN '(3 %)' WHEN 2 THEN 'Name' WHEN 3 THEN ' ' ELSE concat('Part ', l_partkey) END"})
_MERGED = f"""c AS (SELECT doc_id, row, col, bool_or(right_rule) AS right_rule, bool_or(bottom_rule) AS bottom_rule, min(text) AS text FROM {GRID.sql} GROUP BY ALL),
s AS (SELECT *, CASE WHEN coalesce(lag(right_rule) OVER w OR lag(col) OVER w + 1 <> col, true) THEN 1 ELSE 0 END AS f FROM c WINDOW w AS (PARTITION BY doc_id, row ORDER BY col)),
n AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, row ORDER BY col ROWS UNBOUNDED PRECEDING) AS run FROM s),
r AS (SELECT doc_id, row, run, min(col) AS col, count(*)::INT AS col_span, bool_or(bottom_rule) AS closed FROM n GROUP BY 1, 2, 3),
d AS (SELECT *, CASE WHEN coalesce(lag(closed) OVER w OR lag(row) OVER w + 1 <> row, true) THEN 1 ELSE 0 END AS f FROM r WINDOW w AS (PARTITION BY doc_id, col, col_span ORDER BY row)),
k AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, col, col_span ORDER BY row ROWS UNBOUNDED PRECEDING) AS stack FROM d),
m AS (SELECT doc_id, min(row) AS row, col, count(*)::INT AS row_span, col_span FROM k GROUP BY doc_id, col, col_span, stack)"""


def _grid(spark, sf):
    return GRID.df(spark, sf).groupBy("doc_id", "row", "col").agg(F.bool_or("right_rule").alias("right_rule"), F.bool_or("bottom_rule").alias("bottom_rule"), F.min("text").alias("text"))


@query(f"WITH {_MERGED} SELECT doc_id, row, col, row_span, col_span FROM m")
def merged_cells(spark, sf):
    return layout.merged_cells(_grid(spark, sf), ["doc_id"])


@query(rf"""WITH {_MERGED}, t AS (SELECT m.*, c.text, regexp_matches(trim(c.text), '^[($€£+\-]*[0-9][0-9,.\s]*[%)]?$') AS num FROM m JOIN c USING (doc_id, row, col)),
w AS (SELECT doc_id, row, bool_or(trim(text) <> '') AS said, bool_or(num) AS num, arg_min(col_span, col) AS lead, max(col + col_span) AS hi, min(col) AS lo FROM t GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row) AS no, count(*) OVER (PARTITION BY doc_id) AS total, lead >= max(hi) OVER (PARTITION BY doc_id) - min(lo) OVER (PARTITION BY doc_id) AS whole FROM w),
y AS (SELECT doc_id, max(total) AS total, bool_or(whole) FILTER (no = 1) AS title, bool_or(whole) FILTER (no = 2) AS band, bool_or(said AND NOT num) FILTER (no = 1) AS one, bool_or(said AND NOT num) FILTER (no = 2) AS two,
 min(row) FILTER (no = 1) AS r1, min(row) FILTER (no = 2) AS r2, coalesce(bool_or(num) FILTER (no > 2), false) AS evidence FROM x GROUP BY 1)
SELECT doc_id, CASE WHEN NOT title THEN CASE WHEN total >= 2 AND one THEN r1 END WHEN total >= 3 AND NOT band AND two AND evidence THEN r2 END AS header_row FROM y""")
def grid_headers(spark, sf):
    grid = _grid(spark, sf)
    merged = layout.merged_cells(grid, ["doc_id"]).join(grid.select("doc_id", "row", "col", "text"), ["doc_id", "row", "col"])
    return layout.header_rows(merged, ["doc_id"])


# pages of 21 lines: a heading over two columns, ten lines on the left, ten on the right, some of them typed like list items
_NTH = "(row_number() OVER (PARTITION BY l_orderkey % 150 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1)"
_PLACE = "(n % 21)"
PLACED = Derived("lineitem", {"doc_id": "l_orderkey % 150", "n": f"CAST({_NTH} AS INT)", "word": "concat('clause ', l_partkey, ' of the ', l_suppkey, ' th part')"})
_LEFT = f"({_PLACE} BETWEEN 1 AND 10)"
_BLOCK = {
    "doc_id": "doc_id", "page": "CAST(floor(n / 21) AS INT) + 1", "block_id": "CAST(n * 7919 % 100003 AS BIGINT)", "n": "n",
    "text": f"CASE WHEN {_PLACE} = 0 THEN 'ANNUAL REPORT' WHEN {_PLACE} IN (4, 5, 15) THEN concat(CASE WHEN {_PLACE} = 5 THEN '2. ' ELSE '1. ' END, word) ELSE word END",
    "size": "CAST(10 AS DOUBLE)", "page_height": "CAST(800 AS DOUBLE)",
    "x0": f"CAST(CASE WHEN {_PLACE} = 0 THEN 200 WHEN {_LEFT} THEN 50 ELSE 330 END AS DOUBLE)",
    "x1": f"CAST(CASE WHEN {_PLACE} = 0 THEN 420 WHEN {_LEFT} THEN 280 ELSE 560 END AS DOUBLE)",
    "y": f"CAST(CASE WHEN {_PLACE} = 0 THEN 100 WHEN {_LEFT} THEN 110 + 20 * {_PLACE} ELSE 120 + 20 * ({_PLACE} - 10) END AS DOUBLE)",
    "y1": f"CAST(CASE WHEN {_PLACE} = 0 THEN 112 WHEN {_LEFT} THEN 122 + 20 * {_PLACE} ELSE 132 + 20 * ({_PLACE} - 10) END AS DOUBLE)"}
_BLOCK_SQL = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in _BLOCK.items())} FROM {PLACED.sql})"
# a page is cut if it has eight lines beside each other, of them three tenths on the right; else it is read downwards
_READ = f"""b AS {_BLOCK_SQL}, k AS (SELECT *, count_if(x0 = 50) OVER p AS l, count_if(x0 = 330) OVER p AS r FROM b WINDOW p AS (PARTITION BY doc_id, page)),
o AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN l + r >= 8 AND 10 * r >= 3 * (l + r) THEN n ELSE y END, x0) - 1)::INT AS turn FROM k)"""


def _blocks(spark, sf):
    """The blocks of PLACED. Its documents are few and grow with the table, so their lines are numbered within stretches of orders."""
    lines = table(spark, sf, "lineitem")
    x = lines.selectExpr(f"{PLACED.columns['doc_id']} AS doc_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{PLACED.columns['word']} AS word")
    x = numbered(x, lines, ["doc_id"], F.expr("floor(l_orderkey / 150000)"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "n")
    # a document's number of lines times 7919 is no int from 271,180 lines on
    return x.select("doc_id", F.col("n").cast("long").alias("n"), "word").selectExpr(*[f"{e} AS {c}" for c, e in _BLOCK.items()])


@query(f"WITH {_READ} SELECT doc_id, page, block_id, turn FROM o")
def reading_orders(spark, sf):
    units = positioned.prepared(_blocks(spark, sf)).select(*positioned.PAGE, "block_id", "text", "x0", "x1", "y", "y1")
    units = dealt(units, table(spark, sf, "lineitem"), *positioned.PAGE)
    return positioned.reading_order(units).select(*positioned.PAGE, "block_id", "turn")


@query(rf"""WITH {_READ},
f AS (SELECT *, regexp_extract(text, '^(\d)\. ', 1) AS num, row_number() OVER (PARTITION BY doc_id ORDER BY page, turn) AS pos FROM o),
g AS (SELECT *, lead(num) OVER w AS after, lag(num) OVER w AS before FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT *, num = '1' AND coalesce(after, '') = '2' AS opens, num = '2' AND coalesce(before, '') = '1' AS goes FROM g),
u AS (SELECT doc_id, page, 0 AS turn, -2 AS sub, 'section' AS node_type, concat('Page ', page) AS text FROM (SELECT DISTINCT doc_id, page FROM o) UNION ALL
 SELECT DISTINCT doc_id, 0, 0, -3, 'document', NULL FROM o UNION ALL SELECT doc_id, page, turn, -1, 'list', NULL FROM h WHERE opens UNION ALL
 SELECT doc_id, page, turn, 0, CASE WHEN opens OR goes THEN 'list_item' WHEN text = 'ANNUAL REPORT' THEN 'heading' ELSE 'paragraph' END, CASE WHEN opens OR goes THEN regexp_replace(text, '^\d\. ', '') ELSE text END FROM h)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, turn, sub) - 1)::INT AS dfs_pos, node_type, text FROM u""")
def positioned_trees(spark, sf):
    return positioned.positioned_nodes(_blocks(spark, sf)).select("doc_id", "dfs_pos", "node_type", "text")
