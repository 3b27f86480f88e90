from math import isclose

from pyspark.sql import functions as F

from wardlume.functions import color


def _luminance(h):
    parts = [int(h[i:i + 2], 16) / 255 for i in (0, 2, 4)]
    return sum((x / 12.92 if x <= 0.03928 else ((x + 0.055) / 1.055) ** 2.4) * w for x, w in zip(parts, (0.2126, 0.7152, 0.0722), strict=True))


def _ratio(a, b):
    a, b = sorted((_luminance(a), _luminance(b)))
    return (b + 0.05) / (a + 0.05)


def _nearest(fg, bg, need, steps=64):
    """Every step tried in turn."""
    if _ratio(fg, bg) >= need:
        return None
    base, found = [int(fg[i:i + 2], 16) for i in (0, 2, 4)], []
    for goal in (0, 255):
        for i in range(1, steps + 1):
            hex_ = "".join(f"{round(c + (goal - c) * (i / steps)):02X}" for c in base)
            if _ratio(hex_, bg) >= need:
                found.append((sum(((goal - c) * i / steps) ** 2 for c in base), goal, hex_))
                break
    return min(found)[2] if found else None


def test_nearest_passing_is_that_of_all_steps(spark):
    rows = [(f"{i * 7919 * 31 % 16777216:06X}", f"{i * 104729 * 17 % 16777216:06X}", (3.0, 4.5, 7.0)[i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "fg string, bg string, need double")
    got = df.select("*", color.nearest_passing(F.col("fg"), F.col("bg"), F.col("need")).alias("new"), color.contrast(F.col("fg"), F.col("bg")).alias("ratio")).collect()
    for r in got:
        assert r.new == _nearest(r.fg, r.bg, r.need), r
        assert isclose(r.ratio, _ratio(r.fg, r.bg), rel_tol=1e-12)


def test_nearest_passing_tries_few_steps(spark):
    """A search over all 64 steps takes a minute and more for these rows."""
    import time

    x = spark.range(40_000).selectExpr("lpad(hex((id * 7919) % 16777216), 6, '0') as fg", "lpad(hex((id * 104729 + 777) % 16777216), 6, '0') as bg").repartition(4)
    began = time.time()
    x.select(F.sum(F.length(color.nearest_passing(F.col("fg"), F.col("bg"), F.lit(7.0))))).collect()
    assert time.time() - began < 30


def test_css_colours_by_what_they_begin_with(spark):
    want = {"#777": "777777", "#123456ff": "123456", "#12345678": None, "#abcf": "AABBCC", "#abce": None, "rgb(1,2,3)": "010203", "rgba(1,2,3,0.5)": None, "rgb(1,2)": None, " Navy ": "000080", "nonsense": None, "#": None, "": None, "777": None, None: None}
    df = spark.createDataFrame([(k,) for k in want], "c string")
    assert {r.c: r.h for r in df.select("c", color.css_hex(F.col("c")).alias("h")).collect()} == want
