from pyspark.sql import functions as F

from wardlume.plans import dims, planner


def _findings(spark):
    rules = [r[0] for r in dims.RULES]
    rows = [(i % 7, f"v{i}", f"n{i % 9}", rules[i % len(rules)] if i % 11 else "NO_SUCH_RULE", i, i) for i in range(200)] + [(9, "same", "n", rules[0], 1, 1)] * 2 + [(8, "none", "n", None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, violation_id string, node_id string, rule_id string, dfs_pos int, bfs_pos int")


def test_plans_do_not_shuffle_findings(spark):
    plan = planner.plans(_findings(spark), planner.PERMISSIVE)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "violation_id" in x]


def test_plans_are_those_of_the_rules(spark):
    for policy in (planner.DEFAULT, planner.PERMISSIVE, planner.SCAN):
        acts = {}
        for r in dims.actions(spark).withColumn("ok", planner.allowed(policy)).withColumn("rank", planner.best_action()).orderBy("rule_id", "pos").collect():
            acts.setdefault(r.rule_id, []).append(r)
        found = _findings(spark)
        got = planner.plans(found, policy).collect()
        assert sorted(r.violation_id for r in got) == sorted(r.violation_id for r in found.collect())
        for r in got:
            known = acts.get(r.rule_id, [])
            fine = [a for a in known if a.ok]
            assert r.actions == [a.action_code for a in fine]
            assert r.best_action == (min(fine, key=lambda a: tuple(a["rank"])).action_code if fine else None)
            assert r.execution_allowed == bool(fine)
            assert r.blocked_reason == (None if fine else "actions_disallowed_by_policy" if known else "no_recommended_actions")
    assert planner.plans(_findings(spark)).filter(F.col("violation_id") == "same").count() == 2
