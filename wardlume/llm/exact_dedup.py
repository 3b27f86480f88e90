"""Exact dedup: a tree merge of digest runs, in DataFrame operations only.

Every document becomes a 256-bit digest of its text without separators, with a second check (length and 64-bit
hash of the same text). A run is one partition's digests in order. Runs are merged in rounds: in each round the runs
whose numbers agree but for their lowest bits go to one task, are put in one order and merged by digest as neighbours, and keep for
each digest the verified smallest identifier (most code points first, then smallest doc_id) and the group's size. Digests are dealt into
as many ranges as the shuffle has partitions, each with a merge tree of its own, so no root ever holds all digests.
On the way down every run hears its parent's answer, so a group that holds a third of all rows stays spread over
its runs: no join has the bare digest as its key before the group has shrunk to one row per run.

Defined results: a null text counts as empty; an empty table gives an empty result; repeated rows count one by
one, and of rows with equal length and equal doc_id each one whose id is the group's ``keep_id`` is marked kept;
a null doc_id stays only where its group has no other id of that length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SEPARATOR_CLASS, partitions, text_or_empty, written

#: Runs that meet in one merge: four binomial rounds at once.
FAN_IN = 16
KEY = ("digest", "check", "check_len")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, its second check, code points of the original text; and the run of each row."""
    body = text_or_empty(text)
    packed = F.regexp_replace(body, f"{SEPARATOR_CLASS}+", "")
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.length(body).cast("long").alias("n_points"), packed.alias("_packed"),
    ).select(
        "doc_id", "n_points",
        F.unhex(F.sha2(F.col("_packed"), 256)).alias("digest"),
        F.xxhash64("_packed").alias("check"),
        F.length("_packed").alias("check_len"),
    )


def _exchanged(runs: DataFrame) -> DataFrame:
    """Whole runs, each range's in one task and in the order of their digests: the merge needs no other shuffle or sort."""
    return runs.repartition(partitions(runs.sparkSession), "range", "run").sortWithinPartitions("range", "run", *KEY)


def _merge(runs: DataFrame, by: list[str]) -> DataFrame:
    """Merge the runs that share ``by``: of equal digests the best document, and how many there are."""
    return runs.groupBy(*by, *KEY).agg(
        F.min(F.struct((-F.col("n_points")).alias("short"), F.col("doc_id").isNull().alias("anonymous"), F.col("doc_id"))).alias("best"),
        F.sum("group_size").alias("group_size"),
    ).select(*by, *KEY, (-F.col("best.short")).alias("n_points"), F.col("best.doc_id").alias("doc_id"), "group_size")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    width = partitions(docs.sparkSession)
    leaves = written(
        digests(docs, doc_id, text).withColumns({
            "run": (F.spark_partition_id() % (1 << 20)).cast("long"),
            "range": F.pmod(F.xxhash64("digest"), F.lit(width)),
        }), "digest-runs",
    )
    n_runs = (leaves.agg(F.max("run")).first()[0] or 0) + 1
    # up: levels[0] has a run per partition, each further level one per fan_in runs of the level before
    levels = [written(_merge(leaves.withColumn("group_size", F.lit(1).cast("long")), ["range", "run"]), "digest-level")]
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        up = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in))
        levels.append(written(_merge(_exchanged(up), ["range", "run"]), "digest-level"))
    # down: each run learns its group's root
    told = levels[-1].select("range", "run", *KEY, F.col("doc_id").alias("keep_id"), F.col("n_points").alias("keep_points"), "group_size")
    for level in reversed(levels[:-1]):
        child = level.select("range", "run", *KEY, F.floor(F.col("run") / fan_in).alias("parent"))
        told = child.join(told.withColumnRenamed("run", "parent"), ["range", "parent", *KEY]).drop("parent")
    return leaves.join(told, ["range", "run", *KEY]).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
