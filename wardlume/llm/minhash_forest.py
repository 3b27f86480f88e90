"""MinHash near-dedup by an LSH forest, and the components of its links.

Sets are the distinct three-word shingles of whole texts; equal sets are one class throughout. A class has ``trees`` x ``levels``
minhashes of 16 bits. Each tree is another order of them: its own levels first, then those of the next trees. Classes that have the longest
common prefixes in an order are each other's candidates: a region holds the classes that agree in the first ``start`` levels, and where
more than ``crowd`` of them (or more than ``weight`` shingles) do, the region is cut by further levels until its parts are small enough. So the depth
is a matter of the region, and a region's work is bounded however many copies there are.

A region's sets are compared in one task, all with all, by products of its shingle matrix; only a spanning forest of the links that hold
on the full sets leaves the task. Regions of the same members in several trees are compared once, and those that lie in another not at all. In a crowded region every member is compared
with the region's leader too, the member that stays in company to the greatest depth: in a group of near copies that is the text they come from.

Two sets of similarity s miss each other in all regions that are not crowded with a chance of (1 - s^start)^trees: at the threshold of
0.85 that is 3 in 10 million, at 0.9 7 in 10^10. Where a region is crowded its depth d stands for ``start``; of such links most lie within a group that its
leader holds together.

Defined results: a null text counts as empty; a text without words has no shingles and is linked with nothing; a text of one or two words is one
shingle; rows with a null doc_id are returned with a null component and link nothing; rows that share a doc_id are one node; an empty
table gives an empty result; other columns are not read. Links are exact but for collisions of 58-bit shingle and 64-bit set hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import mix
from .ngram_join import compared, grouped, set_table
from .shared import partitions, release, written
from .text_sets import TOKEN_MASK, U, chunks, elements

#: Bytes of a minhash, and columns of the shingle matrix worked on at once (cells).
LEVEL_BYTES, CELLS = 2, 4_000_000


def _multipliers(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=U) * U(0xA0761D6478BD642F)) | U(1)


def signatures(rows: DataFrame, width: int, count: int) -> DataFrame:
    """Written (doc, key, key2, n, sig): each text's set by two digests, its size, and its minhashes."""
    many = _multipliers(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            e = elements(texts, lines=False, width=width)
            token, sig = mix(e.tokens & TOKEN_MASK), np.zeros((len(ids), count), np.uint16)
            if len(token):
                for i, m in enumerate(many):
                    sig[e.row, i] = mix(np.minimum.reduceat(token * m, e.starts)) >> U(64 - 8 * LEVEL_BYTES)
            key, key2, n = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            key[e.row], key2[e.row], n[e.row] = e.keys().view(np.int64), e.keys(1).view(np.int64), e.sizes
            data = sig.astype(">u2").tobytes()
            step = count * LEVEL_BYTES
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(key), pa.array(key2), pa.array(n), pa.array([data[s : s + step] for s in range(0, len(data), step)], pa.binary())], ["doc", "key", "key2", "n", "sig"])

    return written(rows.mapInArrow(run, "doc long, key long, key2 long, n long, sig binary"), "signatures")


def _prefix(tree: Column, levels: int, start: int, stop: int) -> Column:
    """The levels start to stop of a tree's order, which goes round through all trees."""
    return F.substring(F.concat("sig", "sig"), (tree * levels + start) * LEVEL_BYTES + 1, F.lit((stop - start) * LEVEL_BYTES))


def _depths(start: int, count: int) -> list[int]:
    """start, then about a quarter more each time, to all levels."""
    out = [start]
    while out[-1] < count:
        out.append(min(count, out[-1] + max(1, out[-1] // 4)))
    return out


def regions(classes: DataFrame, trees: int, levels: int, start: int, crowd: int, weight: int) -> tuple[DataFrame, DataFrame]:
    """Written (region, key) of the small regions of two members or more, and pairs (key, leader) of the crowded ones."""
    spark = classes.sparkSession
    steps = _depths(start, trees * levels)
    first = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("sig", 1 + t * levels * LEVEL_BYTES, start * LEVEL_BYTES)).alias("region")) for t in range(trees)])
    entries = classes.select("key", "n", F.explode(first).alias("x")).select("key", "n", "x.tree", "x.region")
    leaves, passed = None, None
    for i, depth in enumerate(steps):
        sizes = entries.groupBy("region").agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("key")).alias("who"))
        sizes = written(sizes.filter("members > 1"), "regions")
        full = f"members > 2 and (members > {crowd} or total > {weight})"
        small = sizes.filter(f"not ({full})").groupBy("who", "members").agg(F.min("region").alias("region")).select("region")
        crowded = sizes.filter(full).select("region", "members", "total")
        here = entries.join(small, "region").select("region", "key")
        if crowded.isEmpty():
            leaves = here if leaves is None else leaves.union(written(here, "leaves"))
            break
        inside = written(entries.join(crowded, "region"), "crowded")
        mark = inside.select("region", "key", F.lit(depth).alias("depth"))
        passed = mark if passed is None else passed.union(mark)
        here = written(here, "leaves")
        leaves = here if leaves is None else leaves.union(here)
        if i + 1 < len(steps):
            more = inside.join(classes.select("key", "sig"), "key")
            entries = more.select("key", "n", "tree", F.xxhash64("region", _prefix(F.col("tree"), levels, depth, steps[i + 1])).alias("region"))
        else:
            # they agree in every level: runs of them, held together by the leader
            runs = F.ceil(F.greatest(F.col("members") / crowd, F.col("total") / weight)).cast("long")
            last = inside.select(F.xxhash64("region", F.pmod(F.xxhash64("key", F.lit(1)), runs)).alias("region"), "key")
            leaves = leaves.union(last)
    if passed is None:
        led = spark.createDataFrame([], "key long, leader long")
    else:
        # the deepest region that a class was in, over all trees, says how central it is
        deepest = passed.groupBy("key").agg(F.max("depth").alias("depth"), F.count("*").alias("times"))
        inner = passed.select("region", "key").join(deepest, "key")
        leader = inner.groupBy("region").agg(F.max(F.struct("depth", "times", "key")).alias("x")).select("region", F.col("x.key").alias("leader"))
        led = inner.select("region", "key").join(leader, "region").filter("key <> leader").select("key", "leader").distinct()
    return written(leaves, "leaves"), written(led, "leaders")


def without_inner(leaves: DataFrame) -> DataFrame:
    """Written (region, key) but regions whose members all lie in one other region: there they are compared anyway.

    A region goes if the largest region (by members, then number) of each of its members is the same and another one; so those that hold it stay or lie in one that does.
    """
    sizes = leaves.groupBy("region").agg(F.count("*").alias("members"))
    x = leaves.join(sizes, "region").withColumn("at", F.struct("members", "region"))
    most = x.groupBy("key").agg(F.max("at").alias("most"))
    outer = x.join(most, "key").groupBy("region").agg(F.max("at").alias("at"), F.min("most").alias("least"), F.max("most").alias("most")).filter("least < most or most = at").select("region")
    return written(leaves.join(outer, "region", "left_semi"), "leaves")


def _common(tokens: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of some sets share: products of the matrix of sets and tokens that two sets or more have."""
    m = len(tokens)
    sizes = np.array([len(t) for t in tokens])
    every, owner = np.concatenate(tokens), np.repeat(np.arange(m), sizes)
    order = np.argsort(every)
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    twice = np.bincount(column)[column] > 1
    column, owner = column[twice], owner[twice]
    out = np.zeros((m, m), np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64)
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        step = max(64, CELLS // m)
        for s in range(0, int(column[-1]) + 1, step):
            a, b = np.searchsorted(column, [s, s + step])
            cells = np.zeros((m, min(step, int(column[-1]) + 1 - s)), out.dtype)
            cells[owner[a:b], column[a:b] - s] = 1
            out += cells @ cells.T
    np.fill_diagonal(out, sizes)
    return out.astype(np.int64)


def _forest(keys: list[int], tokens: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets."""
    n = np.array([len(t) for t in tokens], np.int64)
    if len(keys) == 2:
        common = len(np.intersect1d(tokens[0], tokens[1], assume_unique=True))
        return [(keys[0], keys[1])] if 100 * common >= percent * (n[0] + n[1] - common) else []
    common = _common(tokens)
    linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    out, new = [], np.ones(len(keys), bool)
    for i in range(len(keys)):
        if new[i]:
            new[i], todo = False, [i]
            while todo:
                at = todo.pop()
                found = np.flatnonzero(linked[at] & new).tolist()
                new[found] = False
                out += [(keys[at], keys[f]) for f in found]
                todo += found
    return out


def region_links(leaves: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written (a, b): keys of linked sets, a spanning forest of each region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, tokens, out = None, [], [], []

        def batch() -> pa.RecordBatch:
            a, b = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for part in batches:
            lists = part.column(2)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, (region, key) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                if region != at:
                    if len(keys) > 1:
                        out += _forest(keys, tokens, percent)
                    at, keys, tokens = region, [], []
                    if len(out) > 50_000:
                        yield batch()
                keys.append(key)
                tokens.append(values[ends[i] : ends[i + 1]].copy())
        if len(keys) > 1:
            out += _forest(keys, tokens, percent)
        if out:
            yield batch()

    met = leaves.join(sets.select("key", "tokens"), "key").select("region", "key", "tokens")
    met = met.repartition(partitions(leaves.sparkSession), "region").sortWithinPartitions("region", "key")
    return written(met.mapInArrow(run, "a long, b long").distinct(), "links")


def leader_links(led: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written (a, b): members of crowded regions that are linked with their leader."""
    sized = sets.select("key", "n")
    ends = led.join(sized, "key").join(sized.select(F.col("key").alias("leader"), F.col("n").alias("n_leader")), "leader")
    pairs = ends.select(F.struct("key", "n").alias("a"), F.struct(F.col("leader").alias("key"), F.col("n_leader").alias("n")).alias("b"))
    linked = compared(pairs, sets).filter(F.col("common") * 100 >= (F.col("a.n") + F.col("b.n") - F.col("common")) * percent)
    return written(linked.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")), "links")


def near_dedup(docs: DataFrame, percent: int = 85, width: int = 3, trees: int = 16, levels: int = 8, start: int = 3, crowd: int = 2048, weight: int = 4_000_000,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, class_id (first document of the same set), copies."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    signed = signatures(rows, width, trees * levels)
    some = signed.filter("n > 0 and doc is not null")
    classes = written(some.groupBy("key", "key2", "n").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "classes")
    release(spark)
    leaves, led = regions(classes, trees, levels, start, crowd, weight)
    leaves = without_inner(leaves)
    release(spark)
    keys = leaves.select("key").union(led.select("key")).union(led.select("leader")).distinct()
    sets = set_table(rows, classes.join(keys, "key", "left_semi").select("doc", "key", "key2", "n"), width)
    release(spark)
    links = region_links(leaves, sets, percent).union(leader_links(led, sets, percent))
    release(spark)
    found = grouped(signed.drop("sig"), classes.drop("sig"), links)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id", "copies")
