"""Unified diffs: shortest by the whole table of common subsequences, laid out as the usual tools do, and undone."""

import difflib
import random
import time

import pytest

from wardlume.operators import findings, text_diff


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def rebuilt(a, hunks):
    out, at = [], 0
    for start, n, _, _, lines in hunks:
        start -= n > 0
        out += a[at:start] + [x[1:] for x in lines if x[0] != "-"]
        assert [x[1:] for x in lines if x[0] != "+"] == a[start : start + n]
        at = start + n
    return out + a[at:]


@pytest.mark.parametrize("greedy", [0, 3, 200])
def test_shortest_and_reversible(greedy, monkeypatch):
    monkeypatch.setattr(text_diff, "GREEDY", greedy)
    rng = random.Random(greedy)
    for _ in range(400):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(14))]
        b = [rng.choice("abcdefg") for _ in range(rng.randrange(14))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        found = text_diff.matches(a, b, greedy)
        assert all(a[i] == b[j] for i, j in found) and len(found) == lcs(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))
        for context in (0, 1, 3):
            assert rebuilt(a, text_diff.hunks_of(a, b, context)) == b


def test_layout_of_hunks():
    rng = random.Random(8)
    for _ in range(200):
        a = [f"l{i}" for i in range(rng.randrange(40))]
        b = [x if rng.random() < 0.9 else f"n{rng.randrange(10**6)}" for x in a if rng.random() < 0.95]
        heads = [x for x in difflib.unified_diff(a, b, lineterm="") if x.startswith("@@")]
        # all lines are different, so the shortest edit is the only one
        side = lambda s, n: f"{s}" if n == 1 else f"{s},{n}"
        assert heads == [f"@@ -{side(s, n)} +{side(t, m)} @@" for s, n, t, m, _ in text_diff.hunks_of(a, b)]


def test_long_texts_end_soon():
    rng = random.Random(3)
    base = [f"line {rng.randrange(3000)}" for _ in range(60_000)]
    close = [x for i, x in enumerate(base) if i % 1999] + ["end"]
    mixed = base[:8000]
    rng.shuffle(mixed)
    for a, b in ((base, close), (base[:8000], mixed), (base[:8000], base[7999::-1])):
        began = time.time()
        hunks = text_diff.hunks_of(a, b)
        assert time.time() - began < 20 and rebuilt(a, hunks) == b


def test_hunks_and_patches_in_spark(spark):
    rng = random.Random(5)
    rows = [(1, "a\nb\nc", "a\nc"), (2, None, "x\ny"), (3, "x\n", None), (4, "", ""), (5, "same", "same"), (6, None, None), (7, "", "a"), (8, "a\nb\n", "\na\nb\n"), (9, "- a\n+ b\n  c", "+ b\n- a\n@@"),
            (10, "", None), (11, None, "")]
    for i in range(12, 60):
        a = [rng.choice("abcde ") * rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        rows.append((i, "\n".join(a), "\n".join(x if rng.random() < 0.8 else rng.choice("xyz") for x in a)))
    df = spark.createDataFrame(rows, "k long, before string, after string").selectExpr("*", "1 as lines", "2 as hunk").repartition(4)
    hunks = text_diff.unified_hunks(df, "k")
    back = {r["k"]: r["after"] for r in text_diff.patched(df, hunks, "k").collect()}
    assert back == {k: b for k, _, b in rows}
    assert hunks.filter("k in (4, 5, 6)").count() == 0
    texts = {r["k"]: r.asDict() for r in text_diff.unified_texts(hunks, "k").collect()}
    assert texts[1] == {"k": 1, "diff": "--- before\n+++ after\n@@ -1,3 +1,2 @@\n a\n-b\n c", "removed": 1, "added": 0}
    assert texts[2]["diff"] == "--- before\n+++ after\n@@ -0,0 +1,2 @@\n+x\n+y"
    assert text_diff.unified_hunks(df.limit(0), "k").count() == 0


def test_line_changes_take_whole_texts(spark):
    long = "\n".join(f"row {i}" for i in range(9000))
    before = spark.createDataFrame([(1, long), (2, None)], "k long, text string")
    after = spark.createDataFrame([(1, long + "\nlast"), (3, "x")], "k long, text string")
    got = {tuple(r) for r in findings.line_changes(before, after, "k", "text").collect()}
    assert got == {(1, "+", "last", 1), (2, "-", "", 1), (3, "+", "x", 1)}


def test_hunks_are_applied_beside_their_text_without_a_shuffle(spark):
    texts = [(1, "a\nb\nc", "a\nc\nd"), (2, None, "x"), (3, "x", None), (4, None, None), (5, "", ""), (6, "\n".join(map(str, range(60))), "\n".join(str(i) for i in range(60) if i % 20)), (7, "-a\n+b", "+b\n+c\n"), (8, "p", "")]
    rows = text_diff.hunked(spark.createDataFrame(texts, "k long, before string, after string"), "k").withColumn("net", text_diff.marked_lines("+") - text_diff.marked_lines("-"))
    done = text_diff.patched_texts(rows)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    lines = lambda s: 0 if s is None else s.count("\n") + 1
    assert {(r.k, r.after, r.net) for r in done.collect()} == {(k, b, lines(b) - lines(a)) for k, a, b in texts}
