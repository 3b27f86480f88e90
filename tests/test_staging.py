from pyspark.sql import functions as F

from wardlume.sources.staging import staged


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_results_are_not_broadcast_for_their_size(spark):
    x = staged(spark.range(1000).select("id", F.concat(F.lit("node-"), "id").alias("node_id")))
    some = x.filter("id % 2 = 0").groupBy("id").agg(F.max("node_id").alias("last"))
    for joined in (x.join(some, "id"), x.join(some, "id", "left"), x.join(some, "id", "left_semi"), some.join(spark.range(10), "id")):
        assert "BroadcastHashJoin" not in _plan(joined)
    assert x.join(some, "id").count() == 500


def test_a_broadcast_that_is_asked_for_counts(spark):
    x = staged(spark.range(1000).select("id"))
    assert "BroadcastHashJoin" in _plan(x.join(F.broadcast(spark.range(10)), "id"))
