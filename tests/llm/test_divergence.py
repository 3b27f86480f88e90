"""Source divergence: brute force in plain Python, and odd tables."""

import re
from collections import Counter, defaultdict

import pytest
from conftest import SF
from oracle import same

from wardlume.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least, most=50):
    """rows of (text, lang, source)."""
    rows = [(terms(t), lang or "", source or "") for t, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        docs = Counter(t for r in own for t in set(r[0]))
        kept = sorted(t for t, n in docs.items() if n >= least)
        counts = defaultdict(Counter)
        for ts, _, source in own:
            counts[source].update(t for t in ts if t in docs and docs[t] >= least)
        sources = sorted({r[2] for r in own})

        def share(count, kept=kept):
            return {t: 1 + 10**9 * (count[t] + 5) // (sum(count.values()) + 5 * len(kept)) for t in kept}

        q, p = share(sum(counts.values(), Counter())), {s: share(counts[s]) for s in sources}
        for s in sources:
            pairs = [(b, sum(abs(p[s][t] - p[b][t]) for t in kept)) for b in sources if b != s]
            top = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, len(pairs)), ("term", top, most)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked[:limit])}
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("least", [1, 3, 30])
def test_whole_table_by_brute_force(spark, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = rows_of(divergence.divergence(docs, least_docs=least).select("lang", "source", "part", "item", "value", "rank"))
    assert len(found) == len(set(found))
    assert set(found) == brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()], least)


def test_odd_table(spark):
    text = "Alpha beta BETA naïve Ünder 中文字 x-y z9z  \x00 alpha"
    rows = [(1, text, "en", "a", 0), (1, text, "en", "a", 0), (2, None, "en", "b", 1), (3, "", "en", None, None), (None, "beta " * 3000 + "été", "en", "b", 2), (4, "solo", None, "only", 3),
            (5, "123 !?", "xx", "p", 0), (6, None, "xx", "q", 0), (7, "É é É", "en", "c", 0), (8, " \U0001f600 ￿ z", "en", "c", 0), (9, " \U0001f600 ￿ z", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long").selectExpr("*", "1 as term", "2 as value", "3 as rank", "4 as total", "5 as groups").repartition(3)
    for least in (1, 2):
        found = rows_of(divergence.divergence(df, least_docs=least))
        assert len(found) == len(set(found))
        assert set(found) == brute([r[1:4] for r in rows], least)
    assert {r for r in found if r[0] == "xx"} == {("xx", "p", "pair", "q", 0, 1), ("xx", "q", "pair", "p", 0, 1)}


def test_merges_when_little_is_held(spark):
    rows = [(" ".join(f"w{(i * j) % 97}" for j in range(40)), "en" if i % 3 else "de", f"s{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    found = divergence.divergence(df, least_docs=4, most_terms=5, limits=divergence.Limits(chunk=2000, held=50, cells=20, groups=3))
    assert set(rows_of(found)) == brute(rows, 4, 5)


def test_matches_sql_on_empty_sources(spark, tmp_path):
    rows = [(i, "one two three" if i % 2 else None, None if i % 3 else "en", None if i % 5 else "s", 1) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/parts")
    part = next(p for p in (tmp_path / "parts").iterdir() if p.suffix == ".parquet")
    part.rename(tmp_path / "documents.parquet")
    same(spark, str(tmp_path), queries.QUERIES["op12_source_divergence"], queries.ORACLES["op12_source_divergence"])
