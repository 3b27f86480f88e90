"""Embedding whitening: exact numbers by brute force, and odd vectors."""

import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from wardlume.llm import queries, whitening

NAN, INF = float("nan"), float("inf")


def brute(rows, scale=256, most=4):
    """{row number: (n, deviation, |whitened| by component, explained by component)} of sound rows of one length."""
    x = [[math.floor(scale * float(c)) for c in v] for v in rows]
    fit = sorted(set(map(tuple, x)))
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array([t / n for t in total])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    z = (np.array(x, float) - np.array([t / n for t in total])) @ (vectors[:, order] / np.sqrt(values[order]))
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, total, strict=True)) for v in x]
    return n, deviation, z, values[order] / np.trace(cov)


def against(found, ids, rows, most=4):
    n, deviation, z, explained = brute(rows, most=most)
    assert len(found) == len(ids) * most
    at = {(r["vec_id"], r["component"]): r for r in found}
    for c in range(most):
        got = np.array([at[i, c + 1]["whitened"] for i in ids])
        assert min(np.abs(got - z[:, c]).max(), np.abs(got + z[:, c]).max()) < 1e-8
    for r, i in ((r, ids.index(r["vec_id"])) for r in found):
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in found}) == 1


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    against(queries.op11_embedding_whitening(spark, SF).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


@pytest.mark.parametrize(("tile", "block"), [(1, 3), (2, 7), (3, 1000), (64, 5)])
def test_tiles_and_row_blocks_of_any_size(spark, tile, block):
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(60, 7)) * [5, 4, 3, 2, 1, 0.5, 0.2]).tolist()
    rows += rows[:20]  # copies are in the fit list once
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)
    found = whitening.whiten(df, tile=tile, block_rows=block).collect()
    against(found, list(range(80)), rows)
    assert found[0]["n"] == len({tuple(math.floor(256 * c) for c in v) for v in rows})


def test_odd_vectors(spark):
    good = [[float(i % 5), float(i * i % 7), -float(i)] for i in range(20)]
    odd = [None, [], [1.0, None, 2.0], [1.0, NAN, 2.0], [1.0, INF, 2.0], [-INF, 0.0, 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [(i, v, "x", 1) for i, v in enumerate(good)] + [(100 + i, v, None, None) for i, v in enumerate(odd)] + [(None, good[0], None, 1), (3, good[3], "again", 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, n int")
    found = whitening.whiten(df, most=3).collect()
    assert len(found) == 3 * 22
    assert {r["vec_id"] for r in found} == {*range(20), None}
    kept = [r for r in found if r["vec_id"] is not None]
    by = {(r["vec_id"], r["component"]): r["deviation"] for r in kept}
    assert by == {(i, c): d for i, d in enumerate(brute(good)[1]) for c in (1, 2, 3)}
    assert sum(r["vec_id"] == 3 for r in found) == 6


def test_no_variance_and_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0])] * 3, schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, None, None)] * 6
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0])], schema)).collect()
    assert {(r["vec_id"], r["component"]): r["deviation"] for r in two} == {(i, c): 512 * 512 for i in (1, 2) for c in (1, 2)}
    assert {(r["component"], r["whitened"] is None) for r in two} == {(1, False), (2, True)}
    assert {round(abs(r["whitened"]), 9) for r in two if r["component"] == 1} == {1.0}


def test_entries_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    found = whitening.whiten(df).collect()
    assert len(found) == 6 and all(r["deviation"] is None for r in found if r["vec_id"] < 3)


def test_fit_list_reaches_the_multiplication_in_parts(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select(whitening.quantised(F.col("embedding"), 256).alias("x")).distinct()
    fit = whitening.written(df.repartition(5), "fit")
    n, totals = whitening.sums(fit, 64)
    x = np.array([r["x"] for r in fit.collect()])
    assert (n, totals) == (len(x), x.sum(0).tolist())
    assert np.allclose(whitening.covariance(fit, n, totals, 16, 40), np.cov(x.T, bias=True), rtol=1e-12, atol=1e-9)
