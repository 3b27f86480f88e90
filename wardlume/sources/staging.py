"""Results that several steps read are written once to the folder that driver and executors share.

A few columns of such a file look small to the planner, as it goes by the compressed size: millions of rows of paths and
repeated words would be broadcast through the driver. So written results ask for sort-merge joins; F.broadcast on the other side still counts.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a single-process ``local[...]`` session may go without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("wardlume.staging.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wardlume-")
        spark.conf.set("wardlume.staging.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write ``df`` as Parquet under ``shared_folder`` and read it back; lost executors lose nothing. Joins with it are never broadcast for its size."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
