"""Nearest marks, inherited styles, runs, and colours that can't be told."""

import random

from pyspark.sql import functions as F

from wardlume.operators import rules, styles
from wardlume.sources.html import element_nodes, parse_elements
from wardlume.sources.staging import staged

B = "background:#fff;"
#: Pages and the colours, sizes and weights of their text nodes in order; None where they can't be told.
PAGES = [
    (f'<p style="{B}color:#999">a</p>', [("#999999", "#FFFFFF", None, None)]), ('<p style="color:#999">a</p>', []), (f'<div style="{B}color:red"><p>a<p style="color:blue">b</div><p>c', [("#FF0000", "#FFFFFF", None, None), ("#0000FF", "#FFFFFF", None, None)]),
    (f'<div style="{B}color:red"><p style="color:nonsense">a</p></div>', [("#FF0000", "#FFFFFF", None, None)]), (f'<div style="{B}"><p style="color:red">a <b style="color:blue">b</b></p><p style="color:red">a <b style="color:#f00">b</b></p></div>', [("#FF0000", "#FFFFFF", None, None)]),
    (f'<p style="{B}color:red">a <i style="color:nonsense">b</i></p>', []), ('<div style="background: url(x.svg#a0f0c0) no-repeat navy; COLOR: RGB(1, 2, 3) !important; font-size: 20PX; font-weight: 700"><h2>a</h2></div>', [("#010203", "#000080", "15.0", "true")]),
    (f'<div style="{B}color:red;color:blue;font-weight:bold"><p style="font-weight:normal;font-size:2em">a</p></div>', [("#0000FF", "#FFFFFF", None, "false")]),
    (f'<div style="{B}"><p><span style="color:red">a</span></p><p style="color:red"><span style="font-size:9pt">x</span></p></div>', [("#FF0000", "#FFFFFF", None, None)]),
    (f'<ul style="{B}color:#777"><li>a<ul><li style="color:#000">b</ul><li>c</ul>', [("#000000", "#FFFFFF", None, None), ("#777777", "#FFFFFF", None, None)])]


def test_innermost_marks_by_brute_force(spark):
    rng = random.Random(6)
    marks, points, expect = [], [], {}
    for doc in range(40):
        spans = []

        def nest(a, b, spans=spans):
            while a <= b and rng.random() < 0.9:
                s = rng.randrange(a, b + 1)
                e = rng.randrange(s, b + 1)
                spans.append((s, e))
                nest(s + 1, e)
                a = e + 1

        nest(0, 40)
        marks += [(doc, s, e, f"{s}") for s, e in spans]
        for p in range(-1, 43):
            points.append((doc, p))
            inside = [s for s, e in spans if s <= p <= e]
            expect[doc, p] = f"{max(inside)}" if inside else None
    found = styles.innermost(spark.createDataFrame(marks, "doc_id int, pos int, last int, mark string"), spark.createDataFrame(points, "doc_id int, pos int"))
    assert {(r["doc_id"], r["pos"]): r["mark"] for r in found.collect()} == expect


def test_inherited_styles(spark):
    nodes = element_nodes(staged(parse_elements(spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "page_id long, html string"))))
    got = {}
    for r in nodes.orderBy("doc_id", "dfs_pos").collect():
        if "color" in r["props"]:
            got.setdefault(r["doc_id"], []).append(tuple(r["props"].get(k) for k in ("color", "background", "size_pt", "bold")))
    assert [(p, got.get(i, [])) for i, (p, _) in enumerate(PAGES)] == PAGES


def test_runs_of_a_paragraph(spark):
    page = f'<p style="{B}color:#000">dark <span style="color:#777">grey <b style="font-size:24px">large</b></span> <i style="color:#eee">pale</i></p><p>plain</p>'
    e = staged(parse_elements(spark.createDataFrame([(1, page)], "page_id long, html string")))
    runs = staged(styles.text_runs(e))
    assert [(r["said"].strip(), r["color"], r["size_pt"]) for r in runs.orderBy("pos").collect()] == [("dark", "000000", None), ("grey", "777777", None), ("large", "777777", 18.0), ("pale", "EEEEEE", None)]
    (worst,) = styles.worst_runs(runs).collect()
    assert (worst["runs"], worst["low"], worst["fg"], worst["ratio"], worst["required"]) == (4, 1, "EEEEEE", 1.16, 4.5) and worst["suggested"] == "757575" or worst["suggested"] is not None
    # what differs within a node is not judged by one colour
    assert "LOW_CONTRAST_TEXT" not in {r["rule_id"] for r in rules.audit(staged(element_nodes(e))).collect()}


def test_the_worst_run_is_the_evidence(spark):
    rows = [("a", '[{"c":"000000","sz":12,"b":false},{"c":"999999","sz":12,"b":false},{"c":"AAAAAA","sz":24,"b":false}]'), ("b", '[{"c":"000000"},{"c":"949494","sz":18}]'), ("c", None)]
    nodes = spark.createDataFrame(rows, "node_id string, runs string").select(F.lit(1).cast("long").alias("doc_id"), "node_id", F.lit("paragraph").alias("node_type"), F.map_filter(F.create_map(F.lit("runs"), "runs"), lambda _, v: v.isNotNull()).alias("props"))
    (found,) = rules.RULES["LOW_CONTRAST_TEXT"](nodes).collect()
    assert found["node_id"] == "a" and found["evidence"] == {"fg": "AAAAAA", "bg": "FFFFFF", "ratio": "2.32"}
