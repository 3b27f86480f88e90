"""Embedding whitening by a tiled covariance.

Entries become whole numbers x = floor(scale * c). The covariance is taken over the distinct x vectors (the fit list). Its dimensions
are cut into tiles of ``TILE``; every block of rows sends its centred column blocks to the tile pairs (i, j), i <= j, that need
them, keyed by (tile pair, row block). There the two column blocks of a row block meet and are multiplied; the products are summed
per tile, and the tiles (one matrix of dimensions x dimensions, whatever the number of rows) are assembled and decomposed.

Defined results: rows whose vector is null or holds a null, a NaN or an infinity have no output. Vectors can be compared only where they
have one length: the commonest length counts (of ties the longest), rows of other lengths and empty vectors have no output. Entries that
leave the range of a long are clipped to it. Repeated rows each have their output; their x vector is in the fit list once. A component whose
eigenvalue is nothing but rounding (fewer distinct vectors than dimensions, constant entries) has a null ``whitened`` and the
``explained`` that belongs to it; with no variance at all ``explained`` is null too. ``deviation`` is null where it leaves the range of a long.
An empty table gives an empty result; other columns are not read, or carried if asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, written

#: Dimensions of a tile's side, and rows of a row block.
TILE, BLOCK_ROWS = 32, 4096
_MOST = (1 << 63) - 1


def quantised(embedding: Column, scale: int) -> Column:
    """floor(scale * entry) of every entry, as longs."""
    return F.transform(embedding, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-9.2e18)), F.lit(9.2e18))).cast("long"))


def _sound(embedding: Column) -> Column:
    """Neither null nor holding nulls or entries that are not finite."""
    entry_ok = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    return embedding.isNotNull() & F.forall(embedding, lambda c: entry_ok(c.cast("double")))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows of the fit list and the exact sum of each dimension: one row a task and dimension, added up by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b in batches:
            x = _matrix(b.column(0), width)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = fit.mapInArrow(run, "dim int, n long, high long, low long").groupBy("dim").agg(F.sum("n").alias("n"), wide("high").alias("high"), wide("low").alias("low"))
    by = {r["dim"]: r for r in found.collect()}  # a row a dimension
    return (by[0]["n"] if by else 0), [(int(by[d]["high"]) << 32) + int(by[d]["low"]) for d in range(width)] if by else []


def covariance(fit: DataFrame, n: int, totals: list[int], tile: int = TILE, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """The covariance of the fit list (x array<long>, a table that reads alike each time), divisor n."""
    width, spark = len(totals), fit.sparkSession
    mean = np.array([t / n for t in totals])  # of whole numbers: rounded once
    cuts = list(range(0, width, tile)) + [width]
    sides = range(len(cuts) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(tile pair, row block, side, centred column block). A pair of one block with itself gets it once."""
        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for s in range(0, b.num_rows, block_rows):
                x = _matrix(b.column(0).slice(s, block_rows), width) - mean
                columns = [np.ascontiguousarray(x[:, cuts[i] : cuts[i + 1]]).tobytes() for i in sides]
                rows = [(i * len(sides) + j, side, columns[k]) for i in sides for j in sides[i:] for side, k in ((0, i), (1, j)) if side == 0 or i != j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([(task << 32) + at] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                    ["tile", "block", "side", "data"])
                at += 1

    def shape(t: int, data: bytes, side: int) -> np.ndarray:
        k = t // len(sides) if side == 0 else t % len(sides)
        return np.frombuffer(data, np.float64).reshape(-1, cuts[k + 1] - cuts[k])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each tile's sum over the row blocks of this task."""
        total: dict[int, np.ndarray] = {}
        left: tuple = (None, None, None)
        for b in batches:
            for t, block, side, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                part = shape(t, data, side)
                if t // len(sides) == t % len(sides):
                    product = part.T @ part
                elif side == 0:
                    left = (t, block, part)
                    continue
                else:
                    assert left[:2] == (t, block), "the two column blocks of a row block lie side by side"
                    product = left[2].T @ part
                total[t] = total[t] + product if t in total else product
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["tile", "data"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        found = sum(np.frombuffer(x.as_py(), np.float64) for x in table["data"])
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([found.tobytes()], pa.binary())})

    dealt = fit.mapInArrow(deal, "tile long, block long, side int, data binary").repartition(partitions(spark), "tile", "block").sortWithinPartitions("tile", "block", "side")
    parts = dealt.mapInArrow(multiply, "tile long, data binary")
    # as many parts of a tile as tasks: a first sum by a third of the key's bits, then one by tile
    near = parts.withColumn("salt", F.spark_partition_id() % 16).groupBy("tile", "salt").applyInArrow(add, "tile long, data binary")
    out = np.zeros((width, width))
    for r in near.groupBy("tile").applyInArrow(add, "tile long, data binary").collect():  # width * width numbers in all
        i, j = divmod(r["tile"], len(sides))
        part = np.frombuffer(bytes(r["data"]), np.float64).reshape(cuts[i + 1] - cuts[i], cuts[j + 1] - cuts[j])
        out[cuts[i] : cuts[i + 1], cuts[j] : cuts[j + 1]] = part
        out[cuts[j] : cuts[j + 1], cuts[i] : cuts[i + 1]] = part.T
    return out / n


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, unit eigenvectors as columns, and which of them are more than rounding; the first ``most``."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    # either sign is right: the largest entry is positive, so that runs agree
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1, 1)
    nil = len(cov) * np.finfo(float).eps * max(float(np.trace(cov)), 0.0)
    return np.maximum(values, 0), vectors, values > nil


def identity_error(fit: DataFrame, mean: np.ndarray, project: np.ndarray) -> float | None:
    """The largest entry, in size, of the whitened fit list's covariance minus the identity, measured over all of its rows."""
    width, k = project.shape
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            z = (_matrix(b.column(0), width) - mean) @ project
            n, first, second = n + len(z), first + z.sum(0), second + z.T @ z
        cells = np.concatenate([[n], first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells)], ["cell", "value"])

    found = dict(fit.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value")).collect())
    n, first = found[0], np.array([found[1 + i] for i in range(k)])
    second = np.array([found[1 + k + i] for i in range(k * k)]).reshape(k, k)
    return float(np.abs(second / n - np.outer(first / n, first / n) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, totals: list[int]) -> list[int | None]:
    """Exact sums of (n * x - total)^2: in 64 bits where none can leave them, else in whole numbers of any size."""
    most = int(n) * max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0) + max((abs(t) for t in totals), default=0)
    if most * most * max(1, x.shape[1]) <= _MOST:
        return ((n * x - np.array(totals, np.int64)) ** 2).sum(1).tolist()
    exact = (sum((n * v - t) ** 2 for v, t in zip(row, totals, strict=True)) for row in x.tolist())
    return [d if d <= _MOST else None for d in exact]


def whiten(vectors: DataFrame, scale: int = 256, most: int = 4, vec_id: str = "vec_id", embedding: str = "embedding", tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row with a sound vector and component up to ``most``: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    sound = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("_e")).filter(_sound(F.col("_e")))
    rows = sound.select("vec_id", quantised(F.col("_e"), scale).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = lengths["width"] if lengths else 0
    kind = vectors.select(vec_id).schema[0].dataType.simpleString()
    if not width:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {schema}")
    rows = rows.filter(F.size("x") == width)
    fit = written(rows.select("x").distinct(), "fit-list")
    n, totals = sums(fit, width)
    cov = covariance(fit, n, totals, tile, block_rows)
    values, axes, real = components(cov, most)
    mean, trace = np.array([t / n for t in totals]), float(np.trace(cov))
    project = axes[:, real] / np.sqrt(values[real])
    error = identity_error(fit, mean, project)
    k, shares = len(values), [float(v) / trace if trace > 0 else None for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), width)
            z = np.full((len(x), k), math.nan)
            z[:, real] = (x - mean) @ project
            repeat = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array([n] * len(repeat), pa.int64()),
                 pa.array(_deviations(x, n, totals), pa.int64()).take(pa.array(repeat)), pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel())),
                 pa.array(shares * len(x), pa.float64()), pa.array([error] * len(repeat), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {kind}, {schema}")
