"""Remediation plans: which actions a policy lets through, the best one, where it is carried out and whether it lasts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dims


class Policy(NamedTuple):
    """What a policy allows; the default lets through only actions that a person reviews and that need no inference."""

    allow_auto: bool = True
    allow_ai: bool = False
    review_all: bool = True
    only: tuple[str, ...] | None = None


DEFAULT, PERMISSIVE = Policy(), Policy(allow_ai=True, review_all=False)
SCAN = Policy(allow_ai=False, review_all=False, only=tuple(dims.SCAN_ACTIONS))


def allowed(policy: Policy) -> Column:
    ok = F.lit(True)
    if policy.only is not None:
        ok = ok & F.col("action_code").isin(*policy.only)
    if not policy.allow_ai:
        ok = ok & ~F.col("requires_ai")
    if not policy.allow_auto:
        ok = ok & ~F.col("is_auto_applicable")
    return ok & F.col("requires_human_review") if policy.review_all else ok


def best_action() -> Column:
    """Order of choice: applies itself, needs no inference, needs no review, is no mere marker, then by name."""
    return F.struct(~F.col("is_auto_applicable"), F.col("requires_ai"), F.col("requires_human_review"), F.col("action_code") == "FLAG_FOR_MANUAL_REVIEW", F.col("action_code"))


def plans(findings: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """One plan per finding in reading order: allowed actions in order, the best one, and why there is none. All of it follows from the rule, so findings aren't shuffled."""
    ok = F.coalesce(allowed(policy), F.lit(False))
    by_rule = dims.actions(findings.sparkSession).groupBy("rule_id").agg(
        F.count("action_code").alias("known"), F.transform(F.sort_array(F.collect_list(F.when(ok, F.struct("pos", "action_code")))), lambda a: a["action_code"]).alias("actions"),
        F.min_by("action_code", F.when(ok, best_action())).alias("best"))
    x = findings.select("doc_id", "violation_id", "node_id", "rule_id", "dfs_pos", "bfs_pos").join(F.broadcast(by_rule), "rule_id", "left")
    made = x.withColumns({"known": F.coalesce("known", F.lit(0)), "actions": F.coalesce("actions", F.array().cast("array<string>"))})
    some = F.size("actions") > 0
    reason = F.when(some, F.lit(None).cast("string")).when(F.col("known") == 0, "no_recommended_actions").otherwise("actions_disallowed_by_policy")
    return made.select("doc_id", "violation_id", "node_id", "rule_id", "dfs_pos", "bfs_pos", "actions", F.when(some, F.col("best")).alias("best_action"), some.alias("execution_allowed"), reason.alias("blocked_reason"))


def dispatched(plan: DataFrame, executors: DataFrame) -> DataFrame:
    """Each plan's action, carried out by (action_code, ready) executors: ready, not_implemented or skipped; a node's action runs once."""
    x = plan.join(F.broadcast(executors.select(F.col("action_code").alias("best_action"), "ready")), "best_action", "left")
    again = F.row_number().over(Window.partitionBy("doc_id", "node_id", "best_action").orderBy("dfs_pos", "rule_id")) > 1
    status = F.when(~F.col("execution_allowed"), "skipped").when(F.col("ready").isNull(), "manual_review").when(~F.col("ready"), "not_implemented").when(again, "skipped").otherwise("ready")
    return x.withColumn("status", status)


def persisted_fixes(results: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Successful results (doc_id, format, node_id, action_code, status, failed_to_save) that the format's writer keeps."""
    keeps = F.broadcast(dims.persisted(results.sparkSession))
    x = results.filter("status = 'success' and not coalesce(failed_to_save, false)").join(keeps, ["format", "action_code"])
    sure = confirmations.select("doc_id", "node_id", "action_code").distinct()
    return x.filter("not needs_confirmation").drop("needs_confirmation").unionByName(x.filter("needs_confirmation").drop("needs_confirmation").join(sure, ["doc_id", "node_id", "action_code"], "left_semi"))


def reconciled(results: DataFrame, kept: DataFrame) -> DataFrame:
    """Results whose success did not last are reported as not saved."""
    lasting = kept.select("doc_id", "node_id", "action_code").distinct().withColumn("_kept", F.lit(True))
    x = results.join(lasting, ["doc_id", "node_id", "action_code"], "left")
    lost = (F.col("status") == "success") & F.col("_kept").isNull()
    return x.withColumns({"note": F.when(lost, "the writer did not keep this fix"), "status": F.when(lost, "not_saved").otherwise(F.col("status"))}).drop("_kept")


def decided(plan: DataFrame, approved: DataFrame, job: Column) -> tuple[DataFrame, DataFrame]:
    """(plans of approved violations in breadth-first order, review items of the rejected)."""
    ids = approved.select("violation_id").distinct()
    yes = plan.join(ids, "violation_id", "left_semi")
    no = plan.join(ids, "violation_id", "left_anti").withColumn("item_id", F.concat_ws("-", F.lit("mr"), job, "violation_id"))
    return yes, no


def best_fixes(findings: DataFrame, changes: DataFrame, guidance: DataFrame) -> DataFrame:
    """Each finding's fix: the writer's change of the first action in order, else the rule's guidance."""
    actions = F.broadcast(dims.actions(findings.sparkSession).select("rule_id", "pos", "action_code"))
    made = findings.join(actions, "rule_id").join(changes, ["doc_id", "node_id", "action_code"]).groupBy("doc_id", "violation_id").agg(F.min_by("change", "pos").alias("change"))
    return findings.join(made, ["doc_id", "violation_id"], "left").join(F.broadcast(guidance), "rule_id", "left").withColumn("fix", F.coalesce("change", "guidance")).drop("change", "guidance")


def review_ready(items: DataFrame) -> DataFrame:
    """Per document: items by status; ready when there are some and none is pending."""
    x = items.groupBy("doc_id").agg(F.count("*").alias("items"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "rejected")])
    return x.withColumns({"other": F.col("items") - F.col("pending") - F.col("approved") - F.col("rejected"), "ready": (F.col("items") > 0) & (F.col("pending") == 0)})


def auto_decision(decision: Column, confidence: Column, verdict: Column) -> Column:
    """Apply a suggestion without a person only if it is approved, sure and passes the validator."""
    return F.when((F.lower(decision) == "approve") & (confidence >= 0.8) & (verdict == "pass"), "approved").otherwise("pending")
