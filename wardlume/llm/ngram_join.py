"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Sets are the distinct five-word shingles of whole texts; equal sets are one class throughout. Only classes that share
enough of their tokens with any other go on (``shared_tokens``). Their tokens are ordered by how many of them have each,
exactly, then by hash. A set of n shares needed(n) tokens with any partner, so prefixes of n - needed(n) + m tokens have m
in common at least: m is 1, and 1 % of n more for each doubling of the partners that the prefix lists hold, 12 % at most. Two
sets are verified only if they share the smaller m of prefix tokens, and what follows the prefixes can make up the rest.

Groups of near copies shrink first: each set is verified against the most central sets of its lists, and sets linked
so far are one component. Then pairs of different components are listed, in a list with its largest component only those that
lead out of it. A join row is made only at the first tokens that a pair can share, and if the 512-bit maps of the two prefixes allow the shared tokens asked for: bits that
differ stand for tokens that one prefix has alone.

Defined results: a null text counts as empty; a text without words has no shingles and is linked with nothing; rows with
a null doc_id are returned with a null component and link nothing; rows that share a doc_id are one node; an empty
table gives an empty result; other columns are not read. Links are exact but for collisions of 58-bit shingle and 64-bit set hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import release, written
from .shared_tokens import shared_counts
from .text_sets import SHINGLE_WORDS, TOKEN_MASK, chunks, elements, id_filter, members

#: Central sets that a set is verified against before pairs are listed.
STARS = 2


def _needed(n: Column, percent: int) -> Column:
    """Tokens that a partner must share with a set of n."""
    return F.floor((n * percent + 99) / 100)


def digests(rows: DataFrame) -> DataFrame:
    """Written (doc, key, key2, n): each text's set by two digests and its size, 0 without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            e = elements(texts, lines=False)
            key, key2, n = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            key[e.row], key2[e.row], n[e.row] = e.keys().view(np.int64), e.keys(1).view(np.int64), e.sizes
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(key), pa.array(key2), pa.array(n)], ["doc", "key", "key2", "n"])

    return written(rows.mapInArrow(run, "doc long, key long, key2 long, n long"), "digests")


def set_table(rows: DataFrame, wanted: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """Written (key, n, tokens) of the wanted classes (doc, key, key2, n), one row each."""
    rows, has = id_filter(rows, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            on = np.flatnonzero(has(members(ids)))
            if len(on):
                e = elements([texts[i] for i in on], lines=False, width=width)
                tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(e.sizes)).astype(np.int32)), pa.array((e.tokens & TOKEN_MASK).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[on[i]] for i in e.row.tolist()], pa.int64()), pa.array(e.keys().view(np.int64)), pa.array(e.keys(1).view(np.int64)), pa.array(e.sizes.astype(np.int64)), tokens],
                    ["doc", "key", "key2", "n", "tokens"])

    sets = rows.filter("doc is not null").mapInArrow(run, "doc long, key long, key2 long, n long, tokens array<long>")
    return written(sets.join(wanted, ["doc", "key", "key2", "n"], "left_semi").dropDuplicates(["key"]).select("key", "n", "tokens"), "sets")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Written (token, id): the tokens of each set's prefix that another prefix may have; id has key, n, m and central.

    central is the average frequency of the set's tokens: in a group of near copies the text they come from has the highest.
    """
    tokens = sets.select("key", "n", F.explode("tokens").alias("token"))
    shared = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "token")
    of, ordered = Window.partitionBy("key"), Window.partitionBy("key").orderBy("df", "token")
    need = _needed(F.col("n"), percent)
    # tokens of this set alone come first in its order: base is what they leave of the prefix with one match
    x = shared.withColumn("place", F.row_number().over(ordered)).withColumn("base", F.count("*").over(of) - need + 1)
    x = x.withColumn("partners", F.sum(F.when(F.col("place") <= F.col("base"), F.col("df") - 1).otherwise(0)).over(of))
    x = x.withColumn("central", F.sum("df").over(of) / F.col("n"))
    more = F.least(F.floor(F.col("n") * F.least(F.floor(F.log2(F.col("partners") + 1)), F.lit(12)) / 100), need - 1)
    x = x.filter("partners > 0").withColumn("m", more + 1).filter(F.col("place") < F.col("base") + F.col("m"))
    return written(x.select("token", F.struct("key", "n", "m", "central").alias("id")), "prefixes")


def _may_match(hits: Column, percent: int) -> Column:
    """For ids a and b with at most so many shared prefix tokens: the length filter, and enough of them for both.

    They share the smaller m at least, and what they have in common behind the prefixes lies in the longer rest of the two.
    """
    na, nb, ma, mb = (F.col(f"{s}.{c}") for c in ("n", "m") for s in "ab")
    rest = F.greatest(_needed(na, percent) - ma, _needed(nb, percent) - mb)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (hits >= F.least(ma, mb)) & ((hits + rest) * (100 + percent) >= (na + nb) * percent)


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each set the STARS most central sets of its lists that it may match and meets in most of them.

    Linear in the entries: a list of any length yields one pair an entry, and its maximum is a map-side aggregate.
    """
    first = entries.groupBy("token").agg(F.max(F.struct("id.central", "id")).alias("f"), F.count("*").alias("size")).filter("size > 1").select("token", F.col("f.id").alias("b"))
    met = entries.join(first, "token").filter("id.key <> b.key").groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("hits"))
    # a centre's own lists are not all led by it, so only the length filter holds for these hits
    near = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    rank = F.row_number().over(Window.partitionBy("a.key").orderBy(F.desc("hits"), F.desc("b.central"), "b.key"))
    return met.filter(near).withColumn("rank", rank).filter(F.col("rank") <= STARS).select("a", "b")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids with ``common``, the tokens that both sets have."""
    left, right = (sets.select(F.col("key").alias(f"_{s}"), F.col("tokens").alias(f"_{s}_tokens")) for s in "ab")
    both = pairs.join(left, F.col("a.key") == F.col("_a")).join(right, F.col("b.key") == F.col("_b"))
    return both.withColumn("common", F.size(F.array_intersect("_a_tokens", "_b_tokens")).cast("long")).drop("_a", "_b", "_a_tokens", "_b_tokens")


def _linked(percent: int) -> Column:
    return F.col("common") * 100 >= (F.col("a.n") + F.col("b.n") - F.col("common")) * percent


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written (a, b): keys of the pairs that are linked."""
    return written(compared(pairs, sets).filter(_linked(percent)).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")), "links")


#: Longs of a prefix's bit map.
MAP_LONGS = 8


def _bit_map(token: Column) -> list[Column]:
    """The map of a group's tokens: MAP_LONGS longs, map0 and so on."""
    bit, word = F.expr("shiftleft(1L, cast(token & 63 as int))"), token.bitwiseAND(64 * MAP_LONGS - 64)
    return [F.bit_or(F.when(word == 64 * i, bit).otherwise(0)).alias(f"map{i}") for i in range(MAP_LONGS)]


def cross_pairs(entries: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Written (a, b) of different components that share enough prefix tokens to be linked.

    Tokens have one order for all sets, short lists first. A pair that must share k tokens has the first of them among all but the
    last k - 1 of either set, so it meets only there: once or a few times, not once for each token that close sets share.
    """
    x = entries.join(roots.select(F.col("node").alias("_n"), "root"), F.col("id.key") == F.col("_n"), "left").select(
        "token", "id", F.coalesce("root", "id.key").alias("root"))
    # lists of several components, with the component that most of their sets are in
    lists = x.groupBy("token", "root").agg(F.count("*").alias("size")).groupBy("token").agg(F.max(F.struct("size", "root")).alias("most"), F.count("*").alias("roots"), F.sum("size").alias("length"))
    x = x.join(lists.filter("roots > 1").select("token", F.col("most.root").alias("main"), "length"), "token")
    of = Window.partitionBy("id.key")
    x = x.withColumns({"size": F.count("*").over(of), "behind": F.count("*").over(of) - F.row_number().over(of.orderBy("length", "token"))})
    x = written(x.select("token", "id", "root", "size", "behind", (F.col("root") != F.col("main")).alias("apart")), "open-lists")
    maps = x.groupBy(F.col("id.key").alias("_k")).agg(*_bit_map(F.col("token")))
    x = x.join(maps, F.col("id.key") == F.col("_k")).drop("_k")
    columns = ["id", "root", "apart", "size", "behind", *[f"map{i}" for i in range(MAP_LONGS)]]
    x, y = (x.select("token", *[F.col(c).alias(f"{s}_{c}" if c != "id" else s) for c in columns]) for s in "ab")
    differ = sum((F.bit_count(F.col(f"a_map{i}").bitwiseXOR(F.col(f"b_map{i}"))) for i in range(MAP_LONGS)), F.lit(0))
    at_most = F.shiftright(F.col("a_size") + F.col("b_size") - differ, 1)
    # had they not met before, they share this token and what is behind it at most
    early = F.least("a_behind", "b_behind") + 1
    met = x.filter("a_apart").join(y, "token").filter(
        (F.col("a_root") != F.col("b_root")) & (~F.col("b_apart") | (F.col("a.key") < F.col("b.key"))) & (early >= F.least("a.m", "b.m")) & _may_match(F.least(early, at_most), percent))
    # which of the two is apart can differ from list to list
    pairs = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met-pairs")
    some = pairs.select("a.key").union(pairs.select("b.key")).distinct()
    tokens = entries.select("id.key", "token").join(some, "key", "left_semi").groupBy("key").agg(F.collect_list("token").alias("tokens"))
    return written(compared(pairs, tokens).filter(_may_match(F.col("common"), percent)).select("a", "b"), "cross-pairs")


def ngram_join(docs: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_id (first document of the same set), copies."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    all_ = digests(rows)
    some = all_.filter("n > 0 and doc is not null")
    classes = written(some.groupBy("key", "key2", "n").agg(F.min("doc").alias("doc"), F.count("*").alias("copies")), "classes")
    release(spark)
    tokens = some.agg(F.sum("n")).first()[0] or 0
    may = written(classes.join(shared_counts(rows, False, tokens), "key").filter(F.col("hits") >= _needed(F.col("n"), percent)).select("doc", "key", "key2", "n"), "candidates")
    release(spark)
    sets = set_table(rows, may)
    release(spark)
    entries = prefixes(sets, percent)
    release(spark)
    near = _links(star_pairs(entries, percent), sets, percent)
    release(spark)
    cross = cross_pairs(entries, components(near), percent)
    release(spark)
    far = _links(cross, sets, percent)
    return grouped(all_, classes, near.union(far))


def grouped(all_: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Each row of (doc, key, key2, n) with its component, from classes (key, key2, n, doc, copies) and links (a, b) of their keys."""
    some = all_.filter("n > 0 and doc is not null")
    # sets of rows that share a doc_id are one node
    twice = some.groupBy("doc").agg(F.min("key").alias("a"), F.max("key").alias("most")).filter("a <> most").select("doc", "a")
    same = some.join(twice, "doc").select("a", F.col("key").alias("b"))
    roots = components(links.union(same))
    release(all_.sparkSession)
    named = classes.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    named = named.join(named.groupBy("root").agg(F.min("doc").alias("component_id")), "root").select("key", "key2", "n", F.col("doc").alias("class_id"), "component_id", "copies")
    found = some.join(named, ["key", "key2", "n"]).select("doc", "n", "component_id", "class_id", "copies")
    none = all_.filter("n = 0 or doc is null").select("doc", "n", F.col("doc").alias("component_id"), F.col("doc").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    return found.union(none).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "class_id", "copies")
