from pyspark.sql import functions as F

from wardlume.operators import rules


def _nodes(spark):
    x = spark.range(40).selectExpr("id % 4 as doc_id", "concat('n', id) as node_id", "'paragraph' as node_type", "if(id % 3 = 0, '#777', if(id % 3 = 1, '#999', null)) as c", "if(id % 5 = 0, 'true', 'false') as bold")
    return x.withColumn("props", F.create_map(F.lit("color"), "c", F.lit("bold"), "bold", F.lit("size_pt"), F.lit("15"))).drop("c", "bold")


def test_one_rule_is_a_plain_filter(spark):
    plan = rules.single_node_findings(_nodes(spark), ["LOW_CONTRAST_TEXT"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Filter") == 1


def test_one_rule_finds_what_it_finds_among_others(spark):
    nodes = _nodes(spark).withColumns({"content_kind": F.lit("text"), "text": F.lit("x"), "source_format": F.lit("html"), "language": F.lit("en"), "is_decorative": F.lit(False), "alt_text": F.lit("")})
    alone = rules.single_node_findings(nodes, ["LOW_CONTRAST_TEXT"])
    among = rules.single_node_findings(nodes, ["LOW_CONTRAST_TEXT", "DOCUMENT_TITLE_MISSING"]).filter("rule_id = 'LOW_CONTRAST_TEXT'")
    rows = lambda df: sorted((r.doc_id, r.node_id, r.rule_id, sorted(r.evidence.items())) for r in df.collect())
    assert rows(alone) == rows(among) and alone.count() > 0
