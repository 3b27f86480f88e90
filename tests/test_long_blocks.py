from pyspark.sql import functions as F

from wardlume import queries_layout


def test_blocks_of_a_document_of_very_many_lines(spark, tmp_path):
    """Block 300,000 of a document times 7919 is no int: this ended in an overflow."""
    n = 300_000
    spark.range(n).select((150 * F.col("id")).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), F.lit(7).cast("long").alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    last = queries_layout._blocks(spark, str(tmp_path)).orderBy(F.desc("n")).select("n", "page", "block_id").first()
    assert tuple(last) == (n - 1, (n - 1) // 21 + 1, (n - 1) * 7919 % 100003)
