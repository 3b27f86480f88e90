from conftest import SF

from wardlume import queries as library
from wardlume.sources import tables


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 1000)
    lines = tables.table(spark, SF, "lineitem")
    n = tables.dealt(lines.select("l_orderkey"), lines, "l_orderkey").rdd.getNumPartitions()
    assert n == -(-lines.count() // 1000) > 4
    plan = library.QUERIES["cell_spans"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
