"""Line dedup by an exact set-similarity join: rarity-ordered tokens, prefix, length and positional filters.

A line's tokens are its distinct five-word shingles; a line of one to four words is one token, its whole word sequence, so
it matches its copies. Lines without a word are left alone. Tokens are ordered by rarity (a
sketch over all lines), a line's prefix is the rarest n - ceil(0.75 n) + 1 of them, and lines whose prefixes meet and
that pass the length and positional filters are verified exactly. A line is removed when an earlier line, by (doc_id, line
number), has a Jaccard similarity of 0.75 or more with it, removed or not. Equal sets are one class throughout; a line
already matched by one of the first lines or smallest earlier sets of its token lists needs no further pairs.

Defined results: a null text has no lines and stays null; rows with a null doc_id are left alone; rows that share a
doc_id are told apart by nothing, so lines equal within one such document are removed from each; an empty table gives an
empty result; other columns are carried along. Exact but for collisions of 58-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .set_join import Spec, attainable, classes_of, comparable, corpus, earlier_pairs, levels_of, reachable, set_table, shared_prefixes, similar, survey
from .shared import release, unused, written


def _open_pairs(entries: DataFrame, matched: DataFrame, percent: int) -> DataFrame:
    """(a, b) of lines a without a match so far and earlier lines b that the filters leave."""
    x = entries.join(matched.select(F.col("a").alias("id")), "id", "left_anti")
    y = entries.select("token", F.col("pos").alias("pos2"), F.col("id").alias("id2"), F.col("lead").alias("lead2"))
    met = x.join(y, "token").filter(
        (F.col("id2") < F.col("id")) & comparable(F.col("id.n"), F.col("id2.n"), percent)
        & attainable(F.col("id.n"), F.col("lead"), F.col("id2.n"), F.col("lead2"), percent)
        & reachable(F.col("id.n"), F.col("pos"), F.col("lead"), F.col("id2.n"), F.col("pos2"), F.col("lead2"), percent))
    # beyond the shared prefix tokens, only what follows the prefix that ends first can still be common
    rest = F.floor((F.greatest("a.n", "b.n") * percent + 99) / 100) - 1
    return met.groupBy(F.col("id").alias("a"), F.col("id2").alias("b")).agg(F.count("*").alias("hits")).filter(
        (F.col("hits") + rest) * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent).select("a", "b")


def later_matches(docs: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line): the lines to remove, lines counted from 0."""
    spec = Spec(lines=True, percent=percent)
    rows = corpus(docs, doc_id, text)
    surveyed = survey(rows, spec)
    classes = written(classes_of(surveyed), "classes")
    release(docs.sparkSession)
    entries = shared_prefixes(rows, spec, levels_of(surveyed), classes)
    stars = earlier_pairs(entries, percent)
    near = written(similar(stars, set_table(rows, spec, stars), percent).select("a").distinct(), "matches")
    release(docs.sparkSession)
    still = written(_open_pairs(entries, near, percent), "open-pairs")
    release(docs.sparkSession)
    far = similar(still, set_table(rows, spec, still), percent)
    matched = near.select("a").union(far.select("a")).select("a.doc", "a.line")
    copies = surveyed.filter("kind = 1 and doc is not null").join(
        classes.filter("copies > 1").select("key", "key2", "n", "id"), ["key", "key2", "n"]).filter("doc <> id.doc or line <> id.line").select("doc", "line")
    lines = written(matched.union(copies).distinct(), "later-lines")
    release(docs.sparkSession)
    return lines


def line_dedup(docs: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text", removed: str = "removed_lines") -> DataFrame:
    """The input with later matches cut out of ``text``, and ``removed`` (array of line numbers, ascending), in place of a column of that name."""
    docs = docs.drop(removed)
    owner, gone = unused(docs, "owner"), unused(docs, "gone")
    drop = later_matches(docs, percent, doc_id, text).groupBy(F.col("doc").alias(owner)).agg(F.sort_array(F.collect_set("line")).alias(gone))
    lines = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(gone), i.cast("long")))
    return docs.join(drop, F.col(doc_id).cast("long") == F.col(owner), "left").withColumns({
        text: F.when(F.col(gone).isNotNull(), F.array_join(lines, "\n")).otherwise(F.col(text)),
        removed: F.coalesce(F.col(gone), F.array().cast("array<bigint>"))}).drop(owner, gone)
