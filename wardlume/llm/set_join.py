"""The stages that both exact set-similarity joins of this subpackage share.

1. ``survey``: every element's set digest, and a fixed-size sketch of how common tokens are, over all rows.
2. ``shared_prefixes``: each element's rarest tokens (its prefix) meet by token; tokens of one element alone go. An
   element that asks for m matches keeps all but the m - 1 commonest of its shared tokens: a partner that asks for as
   many or more shares m tokens of the prefix with it, so one of the kept ones.
3. ``star_pairs``: each element is paired with the smallest element of its token lists that it shares most with.
4. ``set_table`` and ``similar``: sets of the elements in the pairs that are left, and their exact verification.

Prefixes leave the tasks as packed arrays, one row per token range, so shuffles hold about 19 bytes an entry. Tokens
that the sketch knows to be very common bypass the ranges and are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, release, written
from .text_sets import (
    SKETCH, TOKEN_MASK, Elements, U, chunks, elements, id_filter, level_weights, members, merged, parts_of, rarity_levels,
)

#: Entries held by a task before they are dealt out; a level from which tokens count as very common.
FLUSH, HOT_LEVEL = 400_000, 40
_POS_CAP = 65_535
#: Sets in a token's list from which it is worked through by blocks of doc ids; shorter ones lie in one task each.
LONG_LIST = 5_000


class Spec(NamedTuple):
    """What is joined: lines or whole texts; Jaccard similarity in percent; whether elements ask for several matches."""

    lines: bool
    percent: int = 75
    adaptive: bool = False


def needed(n, percent: int):
    """Tokens that a partner must share with a set of n."""
    return (n * percent + 99) // 100


def joinable(e: Elements, spec: Spec) -> np.ndarray:
    """Elements that sets other than their own can match. Above 50 percent a line of one token has only its copies, which are its class."""
    return np.full(len(e.sizes), True) if not spec.lines or spec.percent <= 50 else e.sizes > 1


def corpus(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))


def survey(rows: DataFrame, spec: Spec) -> DataFrame:
    """Written rows: the sketch's parts (kind 0), an element's digest and size (1), a text without elements (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        task = TaskContext.get().partitionId()
        names = ["kind", "block", "salt", "data", "key", "key2", "doc", "line", "n"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def batch(rows_: int, **values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values[c], k) if c in values else pa.nulls(rows_, k) for c, k in zip(names, kinds, strict=True)], names)

        held: list[np.ndarray] = []

        def count() -> None:
            if held:
                counts[:] += np.bincount(np.concatenate(held), minlength=SKETCH).astype(np.uint32)
                held.clear()

        for ids, texts in chunks(batches):
            e = elements(texts, spec.lines)
            held.append((e.tokens[joinable(e, spec)[e.owner]] & U(SKETCH - 1)).astype(np.int32))
            if sum(map(len, held)) >= SKETCH:
                count()
            n = len(e.row)
            yield batch(n, kind=np.ones(n, np.int32), key=e.keys().view(np.int64), key2=e.keys(1).view(np.int64), doc=[ids[i] for i in e.row.tolist()], line=e.line, n=e.sizes)
            if not spec.lines:
                none = np.setdiff1d(np.arange(len(ids)), e.row)
                yield batch(len(none), kind=np.full(len(none), 2, np.int32), doc=[ids[i] for i in none.tolist()], line=np.zeros(len(none), np.int64), n=np.zeros(len(none), np.int64))
        count()
        b = parts_of(counts, task)
        yield batch(b.num_rows, kind=np.zeros(b.num_rows, np.int32), **{c: b.column(c).to_pylist() for c in ("block", "salt", "data")})

    return written(rows.mapInArrow(run, "kind int, block int, salt int, data binary, key long, key2 long, doc long, line long, n long"), "survey")


def levels_of(surveyed: DataFrame) -> np.ndarray:
    return rarity_levels(merged(surveyed.filter("kind = 0"), np.uint32, np.add))


def classes_of(surveyed: DataFrame) -> DataFrame:
    """Equal sets as one: key, key2, n, id (the first element: doc, line, n), copies."""
    return surveyed.filter("kind = 1 and doc is not null").groupBy("key", "key2", "n").agg(
        F.min(F.struct("doc", "line", "n")).alias("id"), F.count("*").alias("copies"))


def prefixes(e: Elements, spec: Spec, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of the tokens in every element's prefix, their places, and how many matches the element asks for.

    A set of n shares needed(n) tokens with any partner, so prefixes of n - needed(n) + m tokens share m at least.
    If adaptive, m - 1 is 4 % of n, and 1 % more for each doubling of the partners that the sketch expects for the
    prefix, 12 % at most; else m is 1.
    """
    if not len(e.starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.arange(len(e.tokens)) - e.starts[e.owner]
    need = needed(e.sizes, spec.percent)
    base = e.sizes - need + 1
    matches = np.ones(len(e.starts), np.int64)
    if spec.adaptive:
        cost = np.where(place < base[e.owner], weights[(e.tokens >> U(58)).astype(np.int64)], 0.0)
        partners = np.add.reduceat(cost, e.starts)
        share = np.minimum(4 + np.log2(1 + partners).astype(np.int64), 12)
        matches = 1 + np.minimum(np.minimum(e.sizes * share // 100, need - 1), 254)
    inside = np.flatnonzero(place < (base + matches - 1)[e.owner])
    return inside, place[inside], matches


def shared_prefixes(rows: DataFrame, spec: Spec, levels: np.ndarray, classes: DataFrame) -> DataFrame:
    """Written rows token, pos, id, kept, lead (the element's first place), many (a list of more than LONG_LIST sets): prefix tokens that two different sets have at least."""
    spark = rows.sparkSession
    ranges = partitions(spark)
    common = spark.sparkContext.broadcast(levels)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, weights = TaskContext.get().partitionId(), level_weights()
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            token, key, pos, matches = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            slot = (token * U(0x9E3779B97F4A7C15) >> U(40)) % U(ranges)
            slot = np.where(token >> U(58) >= HOT_LEVEL, U(ranges + task % ranges), slot).astype(np.uint32)
            order = np.argsort(slot, kind="stable")
            token, key, pos, matches, slot = token[order], key[order], pos[order], matches[order], slot[order]
            cut = np.flatnonzero(np.diff(slot)) + 1
            data = [b"".join(x.tobytes() for x in part) for part in zip(*(np.split(x, cut) for x in (token, key, pos, matches)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slot[np.append(0, cut)].astype(np.int32)), pa.array(data, pa.binary())], ["slot", "data"])

        size = 0
        for _, texts in chunks(batches):
            e = elements(texts, spec.lines, common.value)
            inside, place, matches = prefixes(e, spec, weights)
            key = e.keys()
            # copies within the task are one set
            fresh = np.array([on and k not in seen and not seen.add(k) for k, on in zip(key.tolist(), joinable(e, spec).tolist(), strict=True)], bool) if len(key) else np.empty(0, bool)
            if len(seen) > 2_000_000:
                seen.clear()
            inside, place = (x[fresh[e.owner[inside]]] for x in (inside, place)) if len(key) else (inside, place)
            owner = e.owner[inside]
            held.append((e.tokens[inside], key[owner], np.minimum(place, _POS_CAP).astype(np.uint16), matches[owner].astype(np.uint8)))
            size += len(inside)
            if size >= FLUSH:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(token, key, pos, matches, common_to) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(token), 50_000):
                part = slice(s, s + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[part].astype(k)) for x, k in ((token.view(np.int64), np.int64), (key.view(np.int64), np.int64), (pos, np.int32), (matches, np.int32), (common_to, np.int32))],
                    ["token", "key", "pos", "matches", "common_to"])

        held = []
        for b in batches:
            for slot, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(data) // 19
                entry = (np.frombuffer(data, U, n), np.frombuffer(data, U, n, 8 * n), np.frombuffer(data, np.uint16, n, 16 * n), np.frombuffer(data, np.uint8, n, 18 * n))
                if slot >= ranges:
                    yield from rows_of(*entry, np.full(n, 1 << 30))
                else:
                    held.append(entry)
        if held:
            token, key, pos, matches = (np.concatenate(x) for x in zip(*held, strict=True))
            del held
            order = np.lexsort((key, token))
            token, key, pos, matches = token[order], key[order], pos[order], matches[order]
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])
            token, key, pos, matches = token[new], key[new], pos[new], matches[new]
            like = np.concatenate([[False], token[1:] == token[:-1], [False]])
            keep = like[1:] | like[:-1]
            token, key, pos, matches = token[keep], key[keep], pos[keep], matches[keep]
            _, of, sizes = np.unique(token, return_inverse=True, return_counts=True)
            yield from rows_of(token, key, pos, matches, sizes[of] if len(token) else sizes)

    met = rows.filter("doc is not null").mapInArrow(deal, "slot int, data binary").repartition(ranges, "slot").mapInArrow(
        meet, "token long, key long, pos int, matches int, common_to int")
    by = Window.partitionBy("key")
    kept = F.lit(True)
    if spec.adaptive:
        # entries that arrive twice (very common tokens, from several tasks) can only make an element keep more
        kept = F.row_number().over(by.orderBy(F.desc("common_to"), "token")) >= F.col("matches")
    met = met.withColumn("kept", kept).withColumn("lead", F.min("pos").over(by))
    entries = met.join(classes.select("key", "id"), "key").select("token", "pos", "id", "kept", "lead", (F.col("common_to") > LONG_LIST).alias("many"))
    found = written(entries, "prefixes")
    release(spark)
    return found


def comparable(x: Column, y: Column, percent: int) -> Column:
    """The length filter."""
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent)


def reachable(nx: Column, i: Column, x_lead: Column, ny: Column, j: Column, y_lead: Column, percent: int) -> Column:
    """The positional filter: with a shared token at places i and j, and none before the leads, the overlap can still be large enough."""
    bound = F.least(i - x_lead, j - y_lead) + F.least(nx - i, ny - j)
    return (i >= _POS_CAP) | (j >= _POS_CAP) | (bound * (100 + percent) >= (nx + ny) * percent)


def attainable(nx: Column, x_lead: Column, ny: Column, y_lead: Column, percent: int) -> Column:
    """The positional filter by elements: no common token lies before either one's first shared token."""
    return F.least(nx - x_lead, ny - y_lead) * (100 + percent) >= (nx + ny) * percent


#: Partners that an element is verified against before pairs are enumerated.
STARS = 4


def _best_of_lists(met: DataFrame, percent: int) -> DataFrame:
    """For each a the STARS bs that it meets in most lists, of (a, a_lead, b, b_lead) rows that pass the filters."""
    ok = met.filter((F.col("a") != F.col("b")) & comparable(F.col("a.n"), F.col("b.n"), percent) & attainable(F.col("a.n"), F.col("a_lead"), F.col("b.n"), F.col("b_lead"), percent))
    hits = ok.groupBy("a", "b").agg(F.count("*").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("hits"), "b"))
    return hits.withColumn("_n", rank).filter(F.col("_n") <= STARS).select("a", "b")


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Written (a, b): for each element a the smallest sets b of its kept tokens' lists that it meets in most of them.

    Linear in the entries: a list of any length yields one pair an entry, and its minimum is a map-side aggregate.
    """
    first = entries.groupBy("token").agg(F.min(F.struct("id.n", "id", "lead")).alias("f"), F.count("*").alias("size")).filter("size > 1").select(
        "token", F.col("f.id").alias("b"), F.col("f.lead").alias("b_lead"))
    met = entries.filter("kept").select("token", F.col("id").alias("a"), F.col("lead").alias("a_lead")).join(first, "token")
    return written(_best_of_lists(met, percent), "star-pairs")


#: Ranges of doc ids that a token's list is worked through by.
BLOCKS_OF_IDS = 64


def _block(cuts: list, column: Column, low: int = 0) -> Column:
    """How many of the ascending cuts lie below the column, by halving."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(column <= F.lit(cuts[mid]), _block(cuts[:mid], column, low)).otherwise(_block(cuts[mid + 1 :], column, low + mid + 1))


def _before_by_lists(entries: DataFrame) -> DataFrame:
    """(a, a_lead, head, small): of every entry the first element and the smallest set before it in its token's list, lists being short."""
    order = Window.partitionBy("token").orderBy("id")
    x = entries.select("token", "id", "lead").withColumns({
        "head": F.first(F.struct("id", "lead")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "small": F.min(F.struct("id.n", "id", "lead")).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    return x.filter("small is not null").select(F.col("id").alias("a"), F.col("lead").alias("a_lead"), "head", "small")


def _before_by_blocks(entries: DataFrame) -> DataFrame:
    """The same for lists of any length: running minima go by blocks of doc ids within a list, then over the blocks, so no list is in one task."""
    cuts = entries.agg(F.percentile_approx("id.doc", [i / BLOCKS_OF_IDS for i in range(1, BLOCKS_OF_IDS)], 1000)).first()[0] or []
    x = entries.select("token", "id", "lead", _block(sorted(set(cuts)), F.col("id.doc")).alias("block"))
    one = F.struct("id.n", "id", "lead")
    inside = F.min(one).over(Window.partitionBy("token", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    blocks = x.groupBy("token", "block").agg(F.min(one).alias("least"), F.min(F.struct("id", "lead")).alias("head"))
    lists = Window.partitionBy("token").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("token", "block", F.min("least").over(lists).alias("before"), F.min("head").over(Window.partitionBy("token")).alias("head"))
    met = x.withColumn("inside", inside).join(blocks, ["token", "block"]).select(F.col("id").alias("a"), F.col("lead").alias("a_lead"), "head", F.least("inside", "before").alias("small"))
    return met.filter("small is not null")


def earlier_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Written (a, b): for each element a the first elements and smallest sets b before it that it meets in most of its tokens' lists."""
    met = _before_by_lists(entries.filter("not many")).unionByName(_before_by_blocks(entries.filter("many")))
    two = F.array(F.struct(F.col("head.id").alias("b"), F.col("head.lead").alias("b_lead")), F.struct(F.col("small.id").alias("b"), F.col("small.lead").alias("b_lead")))
    met = met.select("a", "a_lead", F.explode(F.array_distinct(two)).alias("x")).select("a", "a_lead", "x.b", "x.b_lead")
    return written(_best_of_lists(met, percent), "star-pairs")


def set_table(rows: DataFrame, spec: Spec, pairs: DataFrame) -> DataFrame:
    """Written rows doc, line, tokens of (at least) every element in the pairs (a, b)."""
    rows, has = id_filter(rows, pairs.select("a.doc", "a.line").union(pairs.select("b.doc", "b.line")).distinct(), spec.lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            on = np.flatnonzero(has(members(ids)))
            if not len(on):
                continue
            ids, e = [ids[i] for i in on], elements([texts[i] for i in on], spec.lines)
            if spec.lines and len(e.row):
                keep = has(members([ids[i] for i in e.row.tolist()], e.line))
            else:
                keep = np.ones(len(e.row), bool)
            sizes, pick = e.sizes[keep], keep[e.owner] if len(e.owner) else np.empty(0, bool)
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array((e.tokens[pick] & TOKEN_MASK).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in e.row[keep].tolist()], pa.int64()), pa.array(e.line[keep], pa.int64()), tokens], ["doc", "line", "tokens"])

    return written(rows.filter("doc is not null").mapInArrow(run, "doc long, line long, tokens array<long>"), "sets")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity asked for, exactly; more than once where rows share a doc_id."""
    left = sets.select(F.col("doc").alias("_ad"), F.col("line").alias("_al"), F.col("tokens").alias("_at"))
    right = sets.select(F.col("doc").alias("_bd"), F.col("line").alias("_bl"), F.col("tokens").alias("_bt"))
    both = pairs.join(left, (F.col("a.doc") == F.col("_ad")) & (F.col("a.line") == F.col("_al"))).join(
        right, (F.col("b.doc") == F.col("_bd")) & (F.col("b.line") == F.col("_bl")))
    hits = F.size(F.array_intersect("_at", "_bt"))
    return both.withColumn("_hits", hits).filter(
        F.col("_hits") * 100 >= (F.size("_at") + F.size("_bt") - F.col("_hits")) * percent).select("a", "b")
