"""MinHash near-dedup: components by brute force, crowded regions, odd tables."""

import random
import re

import numpy as np
import pytest
from conftest import SF

from wardlume.llm import minhash_forest, queries

SEP = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def shingles(s, width=3):
    w = [x for x in SEP.split(re.sub("[A-Z]", lambda m: m[0].lower(), s or "")) if x]
    return frozenset(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, percent=85):
    """{doc_id: (n_shingles, component_id)} of rows (doc_id, text) with ids of their own."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    having = {}
    for i in ids:
        for x in sets[i]:
            having.setdefault(x, []).append(i)
    for i in ids:
        met = {}
        for x in sets[i]:
            for j in having[x]:
                if j < i:
                    met[j] = met.get(j, 0) + 1
        for j, common in met.items():
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def found(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(queries.op13_minhash_forest(spark, SF)) == brute(docs)


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("crowd", "weight"), [(2048, 4_000_000), (20, 4_000_000), (1000, 2000)])
def test_families_of_near_copies(spark, crowd, weight):
    """Copies with up to 5 changed words of 100 are around the threshold: many are linked with the text they come from alone."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for size in (200, 30, 3, 2):
        texts += family(rng, [rng.choice(words) for _ in range(100)], size, 6)
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(50)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]  # share much, linked with nothing
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    out = minhash_forest.near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), crowd=crowd, weight=weight)
    assert found(out) == brute(rows)


def test_copies_that_agree_in_every_level(spark):
    """One word of 4000 changed: all minhashes agree for most, so the last cut is by key and the leader holds them together."""
    rng = random.Random(2)
    base = [f"v{rng.randrange(10**6)}" for _ in range(4000)]
    rows = list(enumerate(family(rng, base, 40, 2)))
    assert found(minhash_forest.near_dedup(spark.createDataFrame(rows, SCHEMA), trees=4, levels=4, crowd=5)) == brute(rows)


def test_threshold_is_exact(spark):
    """Pairs of exactly 85 and just under 85 of 100."""
    rng = random.Random(4)
    rows, expect = [], {}
    for i in range(40):
        a = [f"t{i}x{j}" for j in range(102)]  # 100 shingles
        common = 92 if i % 2 else 91  # 92 / 108 = 0.852, 91 / 109 = 0.835
        b = a[: common + 2] + [f"u{i}x{j}" for j in range(100 - common)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        expect |= {2 * i: (100, 2 * i), 2 * i + 1: (100, 2 * i + (0 if i % 2 else 1))}
    rng.shuffle(rows)
    assert found(minhash_forest.near_dedup(spark.createDataFrame(rows, SCHEMA))) == expect == brute(rows)


def test_odd_table(spark):
    body = " ".join(f"b{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, body), (5, body.upper()), (6, body + " tail"), (6, body + " tail"), (7, "solo"), (8, " Solo\n"), (9, "two words"), (10, "x " * 30000)]
    df = spark.createDataFrame([*rows, (None, body)], SCHEMA).selectExpr("*", "1 as key", "2 as n", "'s' as sig", "3 as region", "4 as token", "5 as tokens").repartition(3)
    out = minhash_forest.near_dedup(df).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == sorted((i or 0) for i, _ in [*rows, (None, "")])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert got.pop(None)[1] is None
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (48, 4), 5: (48, 4), 6: (49, 4), 7: (1, 7), 8: (1, 7), 9: (1, 9), 10: (1, 10)}
    assert minhash_forest.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_minhashes_estimate_similarity():
    a, b = [f"a{i}" for i in range(400)], [f"b{i}" for i in range(400)]
    texts = [" ".join(a + b[:k]) for k in (0, 100, 400)]
    e = minhash_forest.elements(texts, lines=False, width=3)
    token = minhash_forest.mix(e.tokens & minhash_forest.TOKEN_MASK)
    sig = np.array([np.minimum.reduceat(token * m, e.starts) for m in minhash_forest._multipliers(512)])
    for x, y in ((0, 1), (0, 2), (1, 2)):
        sx, sy = shingles(texts[x]), shingles(texts[y])
        assert abs((sig[:, x] == sig[:, y]).mean() - len(sx & sy) / len(sx | sy)) < 0.1


def test_regions_inside_another_go(spark):
    """What is dropped lies whole in a region that stays, also by way of one that goes; regions of the same members leave one."""
    from wardlume.llm.minhash_forest import without_inner

    regions = {1: {1, 2}, 2: {1, 2, 3}, 3: {1, 2, 3, 4}, 4: {4, 5}, 5: {6, 7}, 6: {6, 7}, 7: {2, 5}}
    leaves = spark.createDataFrame([(r, k) for r, ks in regions.items() for k in ks], "region long, key long")
    left = {}
    for r in without_inner(leaves).collect():
        left.setdefault(r.region, set()).add(r.key)
    assert all(ks == regions[r] for r, ks in left.items())
    assert {3, 4, 7} <= set(left) and not {1, 2} & set(left) and len({5, 6} & set(left)) == 1
    assert all(any(ks <= other for other in left.values()) for ks in regions.values())
