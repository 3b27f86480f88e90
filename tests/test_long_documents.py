from pyspark.sql import functions as F

from wardlume.operators import layout
from wardlume.sources import positioned
from wardlume.sources.tables import numbered


def test_numbers_within_keys_are_counted_by_parts(spark):
    rows = spark.range(1000).selectExpr("id % 3 AS k", "id * 7919 % 1000 AS v")
    got = numbered(rows, rows, ["k"], F.expr("floor(v / 10)"), ["v"], "n")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.v):
        want[r.k, r.v] = sum(k == r.k for k, _ in want)
    assert {(r.k, r.v): r.n for r in got.collect()} == want


def test_items_in_a_row_without_the_rest(spark):
    rows = [(1, 3, "1. a"), (1, 4, "2. b"), (1, 9, "1. c"), (1, 11, "2. d"), (1, 20, "- x"), (1, 21, "- y")]
    p = spark.createDataFrame(rows, "doc_id long, pos int, text string")
    assert sorted((r.first_pos, r["items"]) for r in layout.fake_list_runs(p, gaps=False).collect()) == [(3, 2), (20, 2)]


def test_a_list_goes_on_over_pages(spark):
    """Items are looked at alone, so a list over two page ends must stay one."""
    rows = [(1, p, 10 * p + i, text, 10.0, 50.0, 400.0, 100.0 + 20 * i, 110.0 + 20 * i, 800.0) for p, page in enumerate([["Some words of a page", "1. a"], ["2. b"], ["3. c", "Words behind it", "1. d", "and so on it goes", "- e"], ["2. f"]], 1) for i, text in enumerate(page)]
    nodes = positioned.positioned_nodes(spark.createDataFrame(rows, "doc_id long, page int, block_id long, text string, size double, x0 double, x1 double, y double, y1 double, page_height double"))
    got = [(r.node_type, r.text) for r in nodes.orderBy("dfs_pos").collect()]
    assert got == [("document", None), ("section", "Page 1"), ("paragraph", "Some words of a page"), ("list", None), ("list_item", "a"), ("list_item", "b"), ("list_item", "c"), ("section", "Page 2"),
                   ("section", "Page 3"), ("paragraph", "Words behind it"), ("paragraph", "1. d"), ("paragraph", "and so on it goes"), ("paragraph", "- e"), ("section", "Page 4"), ("paragraph", "2. f")]
