"""Helpers that every operator of this subpackage shares: the shared folder and null-safe columns."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, space and the ASCII controls 9 to 13.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"
#: The same as a regular expression's character class, for Java, RE2 and Python alike.
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
#: The most bytes that one Arrow batch between Spark and Python holds (a longer row is a batch of its own).
BATCH_BYTES, _BATCH_KEY = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a single-process ``local[...]`` session may go without the setting (tests, notebooks); a folder is then
    made and set once for the session. On a cluster an unset folder is an error, never a machine's own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("wardlume.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="wardlume-")
    spark.conf.set("wardlume.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once as Parquet in the shared folder and read it back.

    Unlike ``checkpoint()`` this evaluates the plan once. The files survive lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle gets; operators tie their own bucket counts to it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as no column of the table takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of stages whose results have been written and that nothing refers to any more.

    Spark does so when its driver collects garbage, which a driver with little to do puts off until disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
