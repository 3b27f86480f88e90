import random
from statistics import median

from pyspark.sql import functions as F

from wardlume.operators import layout, rules
from wardlume.sources import positioned
from wardlume.sources.staging import staged

COLUMNS = "doc_id long, page int, block_id long, text string, size double, x0 double, x1 double, y double, y1 double, page_height double"


def _cut_by_hand(region):
    """The reading order of (id, x0, x1, y, y1, words), read straight from the rules."""
    plain = sorted(region, key=lambda b: (b[3], b[1], b[0]))
    lo, hi = min(b[1] for b in region), max(b[2] for b in region)
    strips, reach = [], None
    for b in plain:
        if reach is None or b[3] >= reach:
            strips.append([])
        strips[-1].append(b)
        reach = b[4] if reach is None else max(reach, b[4])
    beside = sorted((b for s in strips if len(s) > 1 for b in s if b[2] - b[1] <= 0.6 * (hi - lo)), key=lambda b: (b[1], b[0]))
    gutters = []
    for i, b in enumerate(beside[1:], 1):
        edge = max(a[2] for a in beside[:i])
        mid = (edge + b[1]) / 2 - lo
        if b[1] - edge >= 40 and 0.3 * (hi - lo) <= mid <= 0.7 * (hi - lo):
            gutters.append((b[1] - edge, -abs(mid - (hi - lo) / 2), edge, b[1]))
    if not gutters:
        return [b[0] for b in plain]
    _, _, a, z = max(gutters)
    cross = {b[0] for b in region if b[1] < z and b[2] > a}
    left = [b for b in plain if b[0] not in cross and b[1] < z]
    right = [b for b in plain if b[0] not in cross and b[1] >= z]
    n = len(left) + len(right)
    lines = {}
    for b in left + right:
        lines.setdefault(b[3] // 4, [0, 0])[b[1] >= z] += 1
    paired = sum(c == [1, 1] for c in lines.values()) / len(lines) if lines else 0
    if n < 8 or min(len(left), len(right)) < 0.3 * n or median(b[5] for b in left) <= 3 or median(b[5] for b in right) <= 3 or paired >= 0.8:
        return [b[0] for b in plain]
    out, band = [], []

    def flush():
        for side in (False, True):
            part = [b for b in band if (b[1] >= z) == side]
            if part:
                out.extend(_cut_by_hand(part))
        band.clear()

    for b in plain:
        if b[0] in cross:
            flush()
            out.append(b[0])
        else:
            band.append(b)
    flush()
    return out


def test_reading_order_equals_recursion(spark):
    rng, rows, want = random.Random(5), [], {}
    for doc in range(60):
        page, y = [], 50.0
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.7:  # across all columns
                page.append([60.0, 540.0, y, y + 12, 6])
                y += 20
            starts = rng.choice([[60, 330], [60, 230, 420], [60], [60, 180, 330, 450]])
            for k, x in enumerate(starts):
                for i in range(rng.randint(3, 9)):
                    top = y + i * 15 + (5 * k if rng.random() < 0.8 else 0)
                    page.append([float(x), x + (rng.uniform(60, 110) if len(starts) > 2 else rng.uniform(120, 210)), top, top + 11, rng.choice([1, 5, 6, 7, 8])])
            y += 9 * 15 + 30
        rng.shuffle(page)
        blocks = [(i, *b) for i, b in enumerate(page)]
        want[doc] = _cut_by_hand(blocks)
        rows += [(doc, 1, i, " ".join(["word"] * w), 10.0, x0, x1, y, y1, 900.0) for i, x0, x1, y, y1, w in blocks]
    units = positioned.prepared(spark.createDataFrame(rows, COLUMNS)).select("doc_id", "page", "block_id", "text", "x0", "x1", "y", "y1")
    got = {}
    regions = set()
    for r in positioned.reading_order(units).orderBy("doc_id", "turn").collect():
        got.setdefault(r.doc_id, []).append(r.block_id)
        regions.add(len(r.region))
    assert got == want
    assert max(regions) >= 4  # some sides were cut again


def _line(doc, page, i, text, x0, y, size=10.0, width=200.0):
    return (doc, page, i, text, size, x0, x0 + width, y, y + 10, 800.0)


def test_tables_lists_headings_and_running_lines(spark):
    rows = [_line(1, p, 100 + p, f"Page {p}", 50.0, 780.0) for p in (1, 2)] + [_line(1, p, 110 + p, "Draft of the law", 50.0, 10.0) for p in (1, 2)]
    rows += [_line(1, 1, 1, "A law on roads", 50.0, 80.0, 18.0), _line(1, 1, 2, "The text of it begins with these words.", 50.0, 120.0)]
    for r, cells in enumerate([("Road", "Length"), ("North", "12"), ("South", "7,5")]):
        rows += [_line(1, 1, 10 + 2 * r + c, t, 50.0 + 150 * c, 160.0 + 15 * r, width=60.0) for c, t in enumerate(cells)]
    rows += [_line(1, 1, 30, "1. the first of the items", 50.0, 300.0), _line(1, 2, 31, "2. the second of the items", 50.0, 60.0 + 10), _line(1, 2, 32, "After the list there are words.", 50.0, 100.0)]
    rows += [_line(2, 1, 1, None, 50.0, 80.0), _line(2, 1, 2, "  ", 50.0, 90.0), (3, None, 7, "No place at all here", None, None, None, None, None, None), (3, None, 8, "Known place", 9.0, 300.0, 100.0, 60.0, 50.0, 500.0)]
    nodes = positioned.positioned_nodes(spark.createDataFrame(rows, COLUMNS).withColumn("turn", F.lit("clash")))
    got = {}
    for n in nodes.orderBy("doc_id", "dfs_pos").collect():
        assert n.path[-1] == n.node_id and len(n.path) == n.depth + 1 and (n.parent_id is None or n.path[-2] == n.parent_id)
        got.setdefault(n.doc_id, []).append((n.depth, n.node_type, n.cell_type or n.text))
    assert got[1] == [
        (0, "document", None), (1, "section", "Page 1"), (2, "heading", "A law on roads"), (2, "paragraph", "The text of it begins with these words."),
        (2, "table", None), (3, "table_row", None), (4, "table_cell", "header"), (4, "table_cell", "header"), (3, "table_row", None), (4, "table_cell", "data"), (4, "table_cell", "data"),
        (3, "table_row", None), (4, "table_cell", "data"), (4, "table_cell", "data"),
        (2, "list", None), (3, "list_item", "the first of the items"), (3, "list_item", "the second of the items"), (1, "section", "Page 2"), (2, "paragraph", "After the list there are words.")]
    assert got[2] == [(0, "document", None), (1, "section", "Page 1")]
    assert got[3] == [(0, "document", None), (1, "section", "Page 0"), (2, "paragraph", "Known place"), (2, "paragraph", "No place at all here")]
    assert nodes.filter("node_type = 'document' and doc_id = 1").first().props["title_candidate"] == "A law on roads"
    assert positioned.positioned_nodes(spark.createDataFrame([], COLUMNS)).count() == 0
    # the rules run over it as over any node table
    found = {(r.doc_id, r.rule_id) for r in rules.audit(staged(nodes)).collect()}
    assert {(1, "DOCUMENT_LANGUAGE_MISSING"), (2, "DOCUMENT_LANGUAGE_MISSING")} <= found and (1, "TABLE_MISSING_HEADERS") not in found


def test_merged_cells_and_header_rows(spark):
    # a title over both columns, labels, a cell over two rows, a rule unknown
    grid = [(1, 0, 0, False, True, "Roads"), (1, 0, 1, True, True, None), (1, 1, 0, True, True, "Name"), (1, 1, 1, True, True, "Length"), (1, 2, 0, True, False, "North"), (1, 2, 1, True, True, "12"),
            (1, 3, 0, True, True, None), (1, 3, 1, None, None, "13"), (2, 0, 0, False, False, "a"), (2, 0, 1, True, False, "b"), (2, 1, 0, True, True, "c"), (2, 1, 1, True, True, "9")]
    cells = spark.createDataFrame(grid, "doc_id long, row int, col int, right_rule boolean, bottom_rule boolean, text string")
    merged = layout.merged_cells(cells, ["doc_id"])
    # the rows of the second have different columns, so nothing goes downwards
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 0, 0, 1, 2), (1, 1, 0, 1, 1), (1, 1, 1, 1, 1), (1, 2, 0, 2, 1), (1, 2, 1, 1, 1), (1, 3, 1, 1, 1), (2, 0, 0, 1, 2), (2, 1, 0, 1, 1), (2, 1, 1, 1, 1)]
    heads = layout.header_rows(merged.join(cells.drop("right_rule", "bottom_rule"), ["doc_id", "row", "col"]), ["doc_id"])
    assert dict(heads.collect()) == {1: 1, 2: None}
