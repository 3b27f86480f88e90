"""Close sets of different components meet at the first tokens that they can share, not at each of them."""

from pyspark.sql import functions as F

from wardlume.llm import ngram_join


def _entries(spark, groups):
    """Two components that share 81 of 100 prefix tokens at most, and a set that shares enough with those of the first."""
    rows = [(t, (key, 120, 70, 1.0)) for key, tokens in groups.items() for t in tokens]
    return spark.createDataFrame(rows, "token long, id struct<key:long,n:long,m:long,central:double>")


def test_close_sets_meet_once_and_only_if_they_can_match(spark, monkeypatch):
    groups = {1: range(100), 2: range(1, 101), 3: range(20, 120), 4: range(21, 121), 5: [*range(98), 900, 901]}
    kept = {}
    real = ngram_join.written

    def seen(df, name):
        kept[name] = real(df, name)
        return kept[name]

    monkeypatch.setattr(ngram_join, "written", seen)
    roots = spark.createDataFrame([(2, 1), (4, 3)], "node long, root long")
    got = ngram_join.cross_pairs(_entries(spark, groups), roots, 75).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).collect()
    # 83 of the tokens must be shared: 2 and 3 share 81
    expected = {(a, b) for a in groups for b in groups if a < b and len(set(groups[a]) & set(groups[b])) >= 83 and {a, b} not in ({1, 2}, {3, 4})}
    assert {tuple(r) for r in got} == expected == {(1, 5), (2, 5)}
    assert kept["met-pairs"].count() <= 4
