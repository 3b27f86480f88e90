"""Registered queries over records: document counters, results, jobs, teams, ledgers, plans and histories, derived from whole shipped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import color, fixed_values, text, urls
from .operators import dashboards, document_checks, findings, ledger, scoring, text_diff
from .plans import dims, planner
from .queries_nodes import passing_sql
from .registry import ORACLES, Derived, pick, query
from .sources.tables import table

# an order as a document with counters
COUNTED = Derived("orders", {
    "doc_id": "o_orderkey", "format": pick("o_custkey", "pdf", "docx", "pptx"), "title": pick("o_orderkey", None, " ", "A title"), "language": pick("o_orderkey", "en", "", "fr", None), "tagged": "o_orderkey % 2 = 0",
    "images": "o_custkey % 4", "figures": "o_orderkey % 5", "figures_missing_alt": "o_custkey % 3", "headings": "o_orderkey % 3", "outline_entries": "o_custkey % 5", "unlabeled_fields": "o_orderkey % 6", "hyperlinks": "o_custkey % 4",
    "generic_links": "o_orderkey % 4", "invalid_links": "o_custkey % 7", "tables": "o_orderkey % 4", "th": "o_custkey % 5", "td": "o_orderkey % 90", "tables_missing_headers": "o_custkey % 2", "header_scope_flags": "o_orderkey % 5",
    "heading_jumps": "o_custkey % 6", "empty_headings": "o_orderkey % 7", "slides_missing_title": "o_custkey % 8", "backward_pages": "o_orderkey % 9", "disordered_slides": "o_custkey % 9"})
_NO_TITLE = "(title IS NULL OR trim(title) = '')"
_CHECKS = {
    ("document_title_missing", "error"): f"pdf AND {_NO_TITLE}", ("missing_document_title", "warning"): f"NOT pdf AND {_NO_TITLE}", ("missing_language", "warning"): "NOT pdf AND (language IS NULL OR trim(language) = '')",
    ("missing_tag_structure", "error"): "pdf AND NOT tagged", ("images_not_tagged", "warning"): "pdf AND NOT tagged AND images > 0", ("missing_alt_text", "error"): "(pdf AND tagged AND figures > 0 AND figures_missing_alt > 0) OR (pptx AND figures_missing_alt > 0)",
    ("missing_alt_text", "warning"): "docx AND images > 0", ("missing_heading_structure", "warning"): "(NOT pdf OR tagged) AND headings = 0", ("missing_outline", "warning"): "pdf AND NOT tagged AND outline_entries = 0",
    ("unlabeled_form_field", "info"): "pdf AND unlabeled_fields > 0", ("generic_link_text", "warning"): "hyperlinks > 0 AND generic_links > 0", ("invalid_link_target", "warning"): "hyperlinks > 0 AND invalid_links > 0",
    ("table_missing_headers", "warning"): "tables > 0 AND ((pdf AND tagged AND th = 0) OR (NOT pdf AND tables_missing_headers > 0))",
    ("table_header_scope_review", "warning"): "(pdf AND tagged AND tables > 0 AND th > 0 AND td > 0 AND th <= greatest(1, td // 20)) OR (docx AND header_scope_flags > 0)", ("skipped_heading_level", "warning"): "NOT pptx AND heading_jumps > 0",
    ("empty_heading_text", "warning"): "docx AND empty_headings > 0", ("missing_slide_titles", "warning"): "pptx AND headings > 0 AND slides_missing_title > 0", ("reading_order", "warning"): "(pdf AND backward_pages > 0) OR (pptx AND disordered_slides > 0)"}


@query(f"WITH x AS (SELECT *, format = 'pdf' AS pdf, format = 'docx' AS docx, format = 'pptx' AS pptx FROM {COUNTED.sql}) " + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule_id, '{s}' AS severity FROM x WHERE {c}" for (r, s), c in _CHECKS.items()))
def document_checks_by_counters(spark, sf):
    return document_checks.document_issues(document_checks.document_counters(COUNTED.df(spark, sf))).select("doc_id", "rule_id", "severity")


LINKS = Derived("lineitem", {"doc_id": "l_orderkey", "text": pick("l_suppkey", None, " ", "Click here", " MORE ", "Our plan", "here"), "target": pick("l_partkey", "https://x.org/a", None, "http://", "mailto:a@b.c", "ftp://h", "#top", "https:///p")})
HEADINGS = Derived("lineitem", {"doc_id": "l_orderkey", "pos": "l_linenumber * 1000000 + l_partkey * 100 + l_suppkey", "level": "CAST(l_partkey % 6 + 1 AS INT)", "text": pick("l_suppkey", "A", None, " ", "B")})
HEADS = Derived("lineitem", {"doc_id": "l_orderkey", "a": pick("l_partkey", "Name", None, " ", "Column 1", "Size"), "b": pick("l_suppkey", "Name", "", "Price", None), "c": "CAST(l_quantity AS INT) % 4"})


@query(f"""WITH l AS (SELECT doc_id, count(*) AS hyperlinks, count(*) FILTER (lower(trim(coalesce(text, ''))) IN ({', '.join(f"'{x}'" for x in fixed_values.GENERIC_LINK_LABELS)})) AS generic_links,
 count(*) FILTER (trim(coalesce(text, '')) <> '' AND (target IS NULL OR target IN ('http://', 'ftp://h', 'https:///p'))) AS invalid_links FROM {LINKS.sql} GROUP BY 1),
j AS (SELECT *, level > lag(level) OVER (PARTITION BY doc_id ORDER BY pos) + 1 AS jump FROM {HEADINGS.sql}), h AS (SELECT doc_id, count(*) AS headings, count(*) FILTER (jump) AS heading_jumps, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty_headings FROM j GROUP BY 1),
c AS (SELECT doc_id, CASE c WHEN 0 THEN [] WHEN 1 THEN [a] ELSE [a, b] END AS head FROM {HEADS.sql}), k AS (SELECT *, list_filter(list_transform(head, lambda x: lower(trim(coalesce(x, '')))), lambda x: x <> '') AS labels FROM c),
t AS (SELECT doc_id, count(*) AS tables, count(*) FILTER (len(labels) = 0) AS tables_missing_headers, count(*) FILTER (len(labels) > 0 AND ((len(head) > 1 AND len(list_distinct(labels)) <= 1) OR list_contains(labels, 'column 1'))) AS header_scope_flags FROM k GROUP BY 1)
SELECT o_orderkey AS doc_id, coalesce(hyperlinks, 0) AS hyperlinks, coalesce(generic_links, 0) AS generic_links, coalesce(invalid_links, 0) AS invalid_links, coalesce(headings, 0) AS headings, coalesce(heading_jumps, 0) AS heading_jumps, coalesce(empty_headings, 0) AS empty_headings,
 coalesce(tables, 0) AS tables, coalesce(tables_missing_headers, 0) AS tables_missing_headers, coalesce(header_scope_flags, 0) AS header_scope_flags FROM orders LEFT JOIN l ON l.doc_id = o_orderkey LEFT JOIN h ON h.doc_id = o_orderkey LEFT JOIN t ON t.doc_id = o_orderkey""")
def document_counters(spark, sf):
    d = table(spark, sf, "orders").selectExpr("o_orderkey AS doc_id")
    heads = HEADS.df(spark, sf).selectExpr("doc_id", "CASE c WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array(a) ELSE array(a, b) END AS head")
    x = document_checks.document_counters(d, document_checks.link_counters(LINKS.df(spark, sf)), document_checks.heading_counters(HEADINGS.df(spark, sf)), document_checks.table_counters(heads))
    return x.select("doc_id", "hyperlinks", "generic_links", "invalid_links", "headings", "heading_jumps", "empty_headings", "tables", "tables_missing_headers", "header_scope_flags")


# findings of all rules: a line of an order is a finding
_RULE_IDS = [r[0] for r in dims.RULES]
FOUND = Derived("lineitem", {"doc_id": "l_orderkey", "violation_id": "concat(l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(l_quantity AS INT))", "node_id": "concat('n', l_partkey % 50)", "rule_id": pick("l_partkey", *_RULE_IDS), "severity": pick("l_partkey", *[r[1] for r in dims.RULES]),
                             "dfs_pos": "l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey * 100 + CAST(l_quantity AS INT)", "bfs_pos": "l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey * 100 + CAST(l_quantity AS INT)"})
_INITCAP = "array_to_string(list_transform(string_split(lower(rule_id), '_'), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(f"""SELECT doc_id, 'issue-' || node_id || '-' || lower(rule_id) AS issue_id, CASE rule_id WHEN 'DOCUMENT_TITLE_MISSING' THEN 'error' WHEN 'DECORATIVE_IMAGE_WITH_ALT' THEN 'warning' ELSE severity END AS severity,
 CASE rule_id WHEN 'DOCUMENT_TITLE_MISSING' THEN 'Document title is missing.' WHEN 'DECORATIVE_IMAGE_WITH_ALT' THEN 'Decorative image has alternative text.' ELSE {_INITCAP} || '.' END AS description FROM {FOUND.sql} x""")
def scan_issues(spark, sf):
    return document_checks.scan_issues(FOUND.df(spark, sf)).select("doc_id", "issue_id", "severity", "description")


@query(f"SELECT rule_id, severity, count(*) AS total, count(DISTINCT doc_id) AS docs, arg_min(node_id, doc_id::HUGEINT * 1000000000000000 + bfs_pos) AS first_node FROM {FOUND.sql} x GROUP BY 1, 2")
def findings_by_rule(spark, sf):
    return findings.by_rule(FOUND.df(spark, sf)).select("rule_id", "severity", "total", "docs", "first_node")


@query(f"SELECT severity, count(*) AS total FROM {FOUND.sql} x GROUP BY 1")
def findings_by_severity(spark, sf):
    return findings.by_severity(FOUND.df(spark, sf))


_CR = ", ".join(f"('{n}', '{r}')" for n, rs in dims.CRITERION_RULES.items() for r in rs.split())
_CRIT = ", ".join(f"('{n}', '{lv}')" for n, _, lv in dims.CRITERIA)
_VERDICT = "CASE WHEN c.num NOT IN (SELECT num FROM cr) THEN 'Not Evaluated' WHEN coalesce(n, 0) = 0 THEN 'Supports' WHEN e > 0 THEN 'Does Not Support' ELSE 'Partially Supports' END"


@query(f"""WITH x AS {FOUND.sql}, c(num, level) AS (VALUES {_CRIT}), cr(num, rule_id) AS (VALUES {_CR}), h AS (SELECT num, count(*) AS n, count(*) FILTER (severity = 'error') AS e, count(DISTINCT doc_id) AS d FROM x JOIN cr USING (rule_id) GROUP BY 1)
SELECT c.num, level, {_VERDICT} AS status, coalesce(n, 0) AS findings, coalesce(e, 0) AS errors, coalesce(d, 0) AS docs_affected FROM c LEFT JOIN h USING (num)""")
def conformance(spark, sf):
    return scoring.wcag_verdicts(FOUND.df(spark, sf)).drop("title")


@query(f"""WITH x AS {FOUND.sql}, c(num, level) AS (VALUES {_CRIT}), cr(num, rule_id) AS (VALUES {_CR}), h AS (SELECT doc_id, num, count(*) AS n, count(*) FILTER (severity = 'error') AS e FROM x JOIN cr USING (rule_id) GROUP BY 1, 2)
SELECT d.doc_id, c.num, {_VERDICT} AS status, coalesce(n, 0) AS findings FROM (SELECT DISTINCT doc_id FROM x) d CROSS JOIN c LEFT JOIN h ON h.doc_id = d.doc_id AND h.num = c.num""")
def conformance_by_document(spark, sf):
    f = FOUND.df(spark, sf)
    return scoring.wcag_verdicts(f, f.select("doc_id")).select("doc_id", "num", "status", "findings")


_GRADES = "CASE " + " ".join(f"WHEN raw >= {a} THEN '{g}'" for a, g in fixed_values.GRADES[:-1]) + f" ELSE '{fixed_values.GRADES[-1][1]}' END"


@query(f"""WITH x AS {FOUND.sql}, c AS (SELECT doc_id, count(*) AS issues, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (bfs_pos % 3 = 0) AS fixed FROM x GROUP BY 1),
s AS (SELECT o_orderkey AS doc_id, coalesce(issues, 0) AS issues, coalesce(fixed, 0) AS fixed, coalesce(e, 0) AS e, coalesce(w, 0) AS w FROM orders LEFT JOIN c ON doc_id = o_orderkey),
r AS (SELECT *, least(100.0::DOUBLE, 200 * fixed / (2 * greatest(2 * e + w, 1) + 0.01::DOUBLE) + 10 * fixed / greatest(issues, 1)::DOUBLE) AS raw FROM s)
SELECT doc_id, issues, fixed, CASE WHEN issues = 0 THEN 100.0 ELSE round_even(raw, 2) END::DOUBLE AS score, CASE WHEN issues = 0 THEN 'A+' ELSE {_GRADES} END AS grade FROM r""")
def remediation_scores(spark, sf):
    f = FOUND.df(spark, sf)
    return scoring.remediation_scores(table(spark, sf, "orders").selectExpr("o_orderkey AS doc_id"), f, f.filter("bfs_pos % 3 = 0"))


PASSES = Derived("lineitem", {"job_id": "l_orderkey", "pass_type": pick("l_partkey", "baseline", "post_fix", "post_manual"), "score": "l_suppkey", "created_at": "l_linenumber * 1000000 + l_partkey * 100 + l_suppkey"})


@query(f"""WITH x AS (SELECT job_id, pass_type, arg_max(score, created_at) AS s FROM {PASSES.sql} GROUP BY 1, 2), w AS (SELECT job_id, any_value(s) FILTER (pass_type = 'baseline') AS baseline, any_value(s) FILTER (pass_type = 'post_fix') AS post_fix,
 any_value(s) FILTER (pass_type = 'post_manual') AS post_manual FROM x GROUP BY 1) SELECT *, coalesce(post_manual, post_fix, baseline) AS preferred FROM w""")
def preferred_scores(spark, sf):
    return scoring.preferred_scores(PASSES.df(spark, sf))


def _policy_sql(policy: str) -> str:
    _, critical, serious, moderate, minor = next(p for p in dims.POLICIES if p[0] == policy)
    named = {n: s for p, n, s in dims.POLICY_OVERRIDES if p == policy}
    # by format and rule, in capitals or not: the overrides' names are in capitals
    over = " ".join(f"WHEN upper(t) || '.' || upper(r) = '{n}' THEN '{s}'" for n, s in named.items())
    return f"""WITH i AS (SELECT o_orderkey % 3000 AS doc_id, {pick('o_custkey', 'pdf', 'docx', 'pptx')} AS t, {pick('(o_orderkey + o_custkey)', 'MISSING_ALT_TEXT', 'tag_tree_missing', 'reading_order', 'metadata_language_missing', 'x')} AS r,
 {pick('o_custkey', 'error', 'warning', 'Critical', 'moderate', 'hint')} AS s, {pick('o_orderkey', None, '0.5', '2.0', '-1')}::DOUBLE AS k FROM orders), o AS (SELECT *, coalesce(CASE {over} END, lower(s)) AS v FROM i),
c AS (SELECT *, CASE WHEN v = 'error' THEN 'serious' WHEN v = 'warning' THEN 'moderate' WHEN v IN ('critical', 'serious', 'moderate') THEN v ELSE 'minor' END AS c, greatest(0, least(1, coalesce(k, 1))) AS sure FROM o),
a AS (SELECT doc_id, count(*) AS applicable, count(*) FILTER (c = 'critical') AS n_critical, count(*) FILTER (c = 'serious') AS n_serious, sum(sure * CASE c WHEN 'critical' THEN {critical} WHEN 'serious' THEN {serious} WHEN 'moderate' THEN {moderate} ELSE {minor} END::DOUBLE) AS p FROM c GROUP BY 1)
SELECT doc_id, applicable, n_critical, n_serious, round(p, 4) AS penalty, round(greatest(0.0, least(100.0, 100 - p)), 2) AS score, CASE WHEN n_critical = 0 AND n_serious <= 2 THEN 'pass' WHEN n_critical = 0 AND n_serious <= 10 THEN 'needs_review' ELSE 'fail' END AS status FROM a"""


def _policy(spark, sf, policy):
    i = table(spark, sf, "orders").selectExpr("o_orderkey % 3000 AS doc_id", f"{pick('o_custkey', 'pdf', 'docx', 'pptx')} AS doc_type", f"{pick('(o_orderkey + o_custkey)', 'MISSING_ALT_TEXT', 'tag_tree_missing', 'reading_order', 'metadata_language_missing', 'x')} AS rule_id",
                                              f"{pick('o_custkey', 'error', 'warning', 'Critical', 'moderate', 'hint')} AS severity", f"CAST({pick('o_orderkey', None, '0.5', '2.0', '-1')} AS DOUBLE) AS confidence")
    return scoring.policy_scores(i, policy).select("doc_id", "applicable", "n_critical", "n_serious", F.round("penalty", 4).alias("penalty"), "score", "status")


@query(_policy_sql("policy-wcag22-aa-docs"))
def policy_scores_documents(spark, sf):
    return _policy(spark, sf, "policy-wcag22-aa-docs")


@query(_policy_sql("policy-pdf-ua-focused"))
def policy_scores_pdf(spark, sf):
    return _policy(spark, sf, "policy-pdf-ua-focused")


# plans of all rules' findings
_ACTS = ", ".join(f"('{r[0]}', {i}, '{a.partition(':')[0]}', {'I' in a.partition(':')[2]}, {'H' in a.partition(':')[2]}, {'A' in a.partition(':')[2]})" for r in dims.RULES for i, a in enumerate(r[5].split()))
_BEST = "arg_min(action_code, (CASE WHEN au THEN 0 ELSE 8 END) + (CASE WHEN ai THEN 4 ELSE 0 END) + (CASE WHEN hr THEN 2 ELSE 0 END) + (CASE WHEN action_code = 'FLAG_FOR_MANUAL_REVIEW' THEN 1 ELSE 0 END))"
_PLANS = f"""f AS {FOUND.sql}, acts(rule_id, pos, action_code, ai, hr, au) AS (VALUES {_ACTS}), b AS (SELECT rule_id, {_BEST} AS best FROM acts GROUP BY 1), p AS (SELECT f.*, best FROM f LEFT JOIN b USING (rule_id))"""
_READY = ("NORMALIZE_HEADING_LEVEL", "SET_DOCUMENT_TITLE", "FIX_CONTRAST", "IMPROVE_LINK_TEXT", "REMOVE_DECORATIVE_ALT_TEXT")
_UNREADY = ("TAG_PDF_STRUCTURE", "ADD_OCR_TEXT_LAYER")


def _executors(spark):
    return spark.createDataFrame([(a, True) for a in _READY] + [(a, False) for a in _UNREADY], "action_code string, ready boolean")


@query(f"""WITH {_PLANS} SELECT doc_id, violation_id, best AS best_action, CASE WHEN best IS NULL THEN 'skipped' WHEN best IN ({', '.join(f"'{a}'" for a in _UNREADY)}) THEN 'not_implemented' WHEN best NOT IN ({', '.join(f"'{a}'" for a in _READY)}) THEN 'manual_review'
 WHEN row_number() OVER (PARTITION BY doc_id, node_id, best ORDER BY dfs_pos, rule_id) > 1 THEN 'skipped' ELSE 'ready' END AS status FROM p""")
def dispatched_actions(spark, sf):
    return planner.dispatched(planner.plans(FOUND.df(spark, sf), planner.PERMISSIVE), _executors(spark)).select("doc_id", "violation_id", "best_action", "status")


_KEEPS = ", ".join(f"('{f}', '{a}', {a in dims.CONFIRMED})" for f, x in dims.PERSISTED.items() for a in x.split())
_RESULTS = f"""{_PLANS}, r AS (SELECT doc_id, node_id, best AS action_code, any_value({pick('doc_id', 'pdf', 'docx', 'pptx', 'html')}) AS format, CASE WHEN min(dfs_pos) % 4 = 0 THEN 'failed' ELSE 'success' END AS status, min(dfs_pos) % 5 = 0 AS failed_to_save FROM p WHERE best IS NOT NULL GROUP BY 1, 2, 3),
keeps(format, action_code, asks) AS (VALUES {_KEEPS}), kept AS (SELECT r.* FROM r JOIN keeps USING (format, action_code) WHERE status = 'success' AND NOT failed_to_save AND (NOT asks OR doc_id % 3 = 0))"""


def _results(spark, sf):
    p = planner.plans(FOUND.df(spark, sf), planner.PERMISSIVE).filter("best_action is not null")
    return p.groupBy("doc_id", "node_id", F.col("best_action").alias("action_code")).agg(F.min("dfs_pos").alias("at")).selectExpr(
        "doc_id", "node_id", "action_code", f"{pick('doc_id', 'pdf', 'docx', 'pptx', 'html')} AS format", "CASE WHEN at % 4 = 0 THEN 'failed' ELSE 'success' END AS status", "at % 5 = 0 AS failed_to_save")


@query(f"WITH {_RESULTS} SELECT doc_id, node_id, action_code, format FROM kept")
def persisted_fixes(spark, sf):
    r = _results(spark, sf)
    return planner.persisted_fixes(r, r.filter("doc_id % 3 = 0")).select("doc_id", "node_id", "action_code", "format")


@query(f"WITH {_RESULTS} SELECT r.doc_id, r.node_id, r.action_code, CASE WHEN r.status = 'success' AND kept.doc_id IS NULL THEN 'not_saved' ELSE r.status END AS status FROM r LEFT JOIN kept ON kept.doc_id = r.doc_id AND kept.node_id = r.node_id AND kept.action_code = r.action_code")
def reconciled_fixes(spark, sf):
    r = _results(spark, sf)
    return planner.reconciled(r, planner.persisted_fixes(r, r.filter("doc_id % 3 = 0"))).select("doc_id", "node_id", "action_code", "status")


@query(f"WITH f AS {FOUND.sql} SELECT doc_id, violation_id, 'approved' AS decision FROM f WHERE (l_ok(bfs_pos)) UNION ALL SELECT doc_id, 'mr-j1-' || violation_id, 'rejected' FROM f WHERE NOT l_ok(bfs_pos)".replace("l_ok(bfs_pos)", "violation_id IN (SELECT violation_id FROM f WHERE bfs_pos % 4 < 2)"))
def decided_plans(spark, sf):
    f = FOUND.df(spark, sf)
    yes, no = planner.decided(planner.plans(f, planner.PERMISSIVE), f.filter("bfs_pos % 4 < 2"), F.lit("j1"))
    return yes.select("doc_id", "violation_id", F.lit("approved").alias("decision")).union(no.select("doc_id", "item_id", F.lit("rejected")))


@query(f"""WITH f AS {FOUND.sql}, acts(rule_id, pos, action_code, ai, hr, au) AS (VALUES {_ACTS}), c AS (SELECT DISTINCT doc_id, node_id, action_code, 'changed by ' || action_code AS change FROM f JOIN acts USING (rule_id) WHERE doc_id % 2 = 0 AND (pos = 1 OR doc_id % 4 = 0)),
m AS (SELECT f.doc_id, f.violation_id, arg_min(change, pos) AS change FROM f JOIN acts USING (rule_id) JOIN c ON c.doc_id = f.doc_id AND c.node_id = f.node_id AND c.action_code = acts.action_code GROUP BY 1, 2)
SELECT f.doc_id, f.violation_id, coalesce(change, CASE WHEN rule_id LIKE 'TABLE%' THEN 'see ' || rule_id END) AS fix FROM f LEFT JOIN m USING (doc_id, violation_id)""")
def best_fixes(spark, sf):
    f = FOUND.df(spark, sf)
    changes = f.join(dims.actions(spark), "rule_id").filter("doc_id % 2 = 0 and (pos = 1 or doc_id % 4 = 0)").select("doc_id", "node_id", "action_code", F.concat(F.lit("changed by "), "action_code").alias("change")).distinct()
    guidance = dims.rules(spark).filter("rule_id like 'TABLE%'").select("rule_id", F.concat(F.lit("see "), "rule_id").alias("guidance"))
    return planner.best_fixes(f, changes, guidance).select("doc_id", "violation_id", "fix")


REVIEWS = Derived("lineitem", {"doc_id": "l_orderkey", "owner_id": "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 3 END", "status": pick("l_partkey", "pending", "approved", "rejected", "approved", "held"), "line": "l_linenumber", "decision": pick("l_suppkey", "Approve", "reject", "APPROVE"),
                               "confidence": "(l_partkey % 11) / 10.0", "verdict": pick("l_linenumber", "pass", "too_long")})


@query(f"""SELECT doc_id, count(*) AS items, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'held') AS other, count(*) FILTER (status = 'pending') = 0 AS ready FROM {REVIEWS.sql} x GROUP BY 1""")
def reviews_ready(spark, sf):
    return planner.review_ready(REVIEWS.df(spark, sf))


@query(f"SELECT CASE WHEN status IN ('pending', 'approved', 'rejected') THEN status ELSE 'other' END AS status, count(*) AS items FROM {REVIEWS.sql} x GROUP BY 1")
def reviews_by_status(spark, sf):
    return dashboards.manual_summary(REVIEWS.df(spark, sf))


@query(f"SELECT doc_id, owner_id, line FROM {REVIEWS.sql} x WHERE status = 'pending' AND (owner_id IS NULL OR owner_id = 2)")
def pending_reviews(spark, sf):
    return ledger.pending_reviews(REVIEWS.df(spark, sf), F.lit(2)).select("doc_id", "owner_id", "line")


@query(f"SELECT CASE WHEN lower(decision) = 'approve' AND confidence >= 0.8 AND verdict = 'pass' THEN 'approved' ELSE 'pending' END AS decision, count(*) AS n FROM {REVIEWS.sql} x GROUP BY 1")
def automatic_decisions(spark, sf):
    return REVIEWS.df(spark, sf).select(planner.auto_decision(F.col("decision"), F.col("confidence"), F.col("verdict")).alias("decision")).groupBy("decision").agg(F.count("*").alias("n"))


# histories of issues: an order's lines before and after a fix
ISSUES = Derived("lineitem", {"doc_id": "l_orderkey", "id": "CASE WHEN l_partkey % 3 = 0 THEN '' ELSE concat('i', l_partkey) END", "rule_id": pick("l_partkey", *_RULE_IDS[:7]), "severity": pick("l_suppkey", "critical", "serious", "error", "moderate", "warning", "hint"), "location": "concat('Page ', l_suppkey % 9)",
                              "title": "concat(' A  title ', l_partkey % 4)", "phase": "CASE WHEN l_linenumber % 2 = 0 THEN 'before' ELSE 'after' END", "a": "l_partkey % 30", "b": "l_suppkey % 20", "status": pick("l_suppkey", "pending", "approved")})
_KEY = "'rule:' || lower(rule_id) || '|sev:' || severity || '|nodes:' || CASE WHEN 'n' || a < 'n' || b THEN 'n' || a || ',n' || b ELSE 'n' || b || ',n' || a END || '|pages:' || CASE WHEN a = b THEN a::VARCHAR ELSE least(a, b) || ',' || greatest(a, b) END || '|loc:' || lower(location) || '|title:a title ' || right(title, 1)"


@query(f"SELECT doc_id, {_KEY} AS issue_key, count(*) AS n FROM {ISSUES.sql} x GROUP BY 1, 2")
def issue_keys(spark, sf):
    x = ISSUES.df(spark, sf)
    key = findings.issue_key(F.col("rule_id"), F.col("severity"), F.array(F.concat(F.lit("n"), "a"), F.concat(F.lit("n"), "b")), F.array("a", "b").cast("array<int>"), F.col("location"), F.col("title"))
    return x.groupBy("doc_id", key.alias("issue_key")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CASE WHEN id <> '' THEN id ELSE sha256(rule_id || '|' || severity || '|' || location || '|' || title) END AS signature FROM {ISSUES.sql} x")
def bundle_signatures(spark, sf):
    return ISSUES.df(spark, sf).select("doc_id", findings.bundle_signature(F.col("id"), F.col("rule_id"), F.col("severity"), F.col("location"), F.col("title")).alias("signature"))


@query(f"""WITH x AS {ISSUES.sql} SELECT rule_id, location, status, CASE WHEN severity = 'critical' THEN 0 WHEN severity IN ('serious', 'error') THEN 1 WHEN severity IN ('moderate', 'warning') THEN 2 ELSE 3 END::INT AS severity_rank FROM
 (SELECT rule_id, location, severity, CASE phase WHEN 'before' THEN 'fixed' ELSE 'open' END AS status FROM x UNION ALL SELECT rule_id, location, severity, 'introduced' FROM x WHERE a = b UNION ALL SELECT rule_id, location, severity, 'manual_' || status FROM x WHERE a > b)""")
def check_rows(spark, sf):
    x = ISSUES.df(spark, sf)
    return findings.check_rows(x.filter("phase = 'before'"), x.filter("phase = 'after'"), x.filter("a = b"), x.filter("a > b")).select("rule_id", "location", "status", "severity_rank")


@query(f"WITH x AS {ISSUES.sql} SELECT doc_id, rule_id, phase FROM x WHERE phase = 'after' OR doc_id NOT IN (SELECT doc_id FROM x WHERE phase = 'after')")
def latest_phases(spark, sf):
    return findings.latest_phase(ISSUES.df(spark, sf)).select("doc_id", "rule_id", "phase")


@query(f"""WITH x AS (SELECT doc_id, rule_id || location AS issue_key, phase FROM {ISSUES.sql}), b AS (SELECT DISTINCT doc_id, issue_key FROM x WHERE phase = 'before'), a AS (SELECT DISTINCT doc_id, issue_key FROM x WHERE phase = 'after')
SELECT doc_id, issue_key, CASE WHEN a.issue_key IS NULL AND doc_id % 3 = 0 THEN 'remaining' WHEN a.issue_key IS NULL THEN 'fixed' WHEN b.issue_key IS NULL THEN 'introduced' ELSE 'remaining' END AS state FROM b FULL JOIN a USING (doc_id, issue_key)""".replace("a.issue_key IS NULL", "a.k IS NULL").replace("b.issue_key IS NULL", "b.k IS NULL").replace("SELECT DISTINCT doc_id, issue_key FROM x", "SELECT DISTINCT doc_id, issue_key, 1 AS k FROM x"))
def issue_deltas_with_fallback(spark, sf):
    x = ISSUES.df(spark, sf).withColumn("issue_key", F.concat("rule_id", "location"))
    return findings.delta_with_fallback(x.filter("phase = 'before'"), x.filter("phase = 'after'"), x.filter("doc_id % 3 > 0")).select("doc_id", "issue_key", "state")


SCANS = """s AS (SELECT o_custkey AS user_id, 'k' || o_orderkey % 2 AS url_key, o_orderkey AS id, o_orderdate AS created_at, ['f' || o_orderkey % 3, 'g' || o_orderkey % 5, 'h' || o_custkey % 2] AS fingerprints, CASE WHEN o_orderkey % 9 = 0 THEN '1' ELSE '2' END AS version, o_orderkey % 7 = 0 AS truncated, (o_orderkey % 101)::INT AS score FROM orders)"""


@query(f"""WITH {SCANS}, x AS (SELECT *, lag(fingerprints) OVER w AS pf, lag(version) OVER w AS pv, lag(truncated) OVER w AS pt, lag(score) OVER w AS ps FROM s WINDOW w AS (PARTITION BY user_id, url_key ORDER BY created_at, id))
SELECT user_id, url_key, id, len(list_filter(fingerprints, lambda f: NOT list_contains(pf, f)))::INT AS new_count, CASE WHEN pt OR truncated THEN 0 ELSE len(list_filter(pf, lambda f: NOT list_contains(fingerprints, f))) END::INT AS resolved_count,
 len(list_filter(pf, lambda f: list_contains(fingerprints, f)))::INT AS unchanged_count, score - ps AS score_change, pt OR truncated AS partial FROM x WHERE pv = version""")
def scan_changes(spark, sf):
    s = table(spark, sf, "orders").selectExpr("o_custkey AS user_id", "concat('k', o_orderkey % 2) AS url_key", "o_orderkey AS id", "o_orderdate AS created_at", "array(concat('f', o_orderkey % 3), concat('g', o_orderkey % 5), concat('h', o_custkey % 2)) AS fingerprints",
                                              "CASE WHEN o_orderkey % 9 = 0 THEN '1' ELSE '2' END AS version", "o_orderkey % 7 = 0 AS truncated", "CAST(o_orderkey % 101 AS INT) AS score")
    return findings.scan_changes(s)


@query(f"""WITH {SCANS}, x AS (SELECT *, lag(fingerprints) OVER w AS pf, lag(version) OVER w AS pv FROM s WINDOW w AS (PARTITION BY user_id, url_key ORDER BY created_at, id)) SELECT user_id, url_key, id FROM x WHERE pv = version AND len(list_filter(fingerprints, lambda f: NOT list_contains(pf, f))) > 0""")
def scan_alerts(spark, sf):
    return ledger.alerts(scan_changes(spark, sf)).select("user_id", "url_key", "id")


@query("""WITH l AS (SELECT doc_id, doc_id % 2 AS half, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), n AS (SELECT doc_id // 2 AS pair, line, count(*) FILTER (half = 1) - count(*) FILTER (half = 0) AS n FROM l GROUP BY 1, 2)
SELECT pair, CASE WHEN n > 0 THEN '+' ELSE '-' END AS change, md5(line) AS line, abs(n) AS n FROM n WHERE n <> 0""")
def text_changes(spark, sf):
    d = table(spark, sf, "documents").withColumn("pair", F.expr("doc_id div 2"))
    return findings.line_changes(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "pair", "text").withColumn("line", F.md5("line"))


# a later version of each document: lines dropped, changed and added by their place; and the document that follows it
_REVISED = """transform(filter(sequence(1, size(split(text, '\n'))), i -> i % 7 <> 3), i ->
 CASE WHEN i % 5 = 2 THEN concat('changed ', i) WHEN i % 11 = 4 THEN concat(split(text, '\n')[i - 1], '\nadded ', i) ELSE split(text, '\n')[i - 1] END)"""
_VERSIONS_SQL = """d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
r AS (SELECT doc_id, text AS before, CASE WHEN text IS NOT NULL THEN array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: i % 7 <> 3), lambda i:
 CASE WHEN i % 5 = 2 THEN 'changed ' || i WHEN i % 11 = 4 THEN l[i] || chr(10) || 'added ' || i ELSE l[i] END), chr(10)) END AS after FROM d)"""


@query(f"""WITH {_VERSIONS_SQL}, p AS (SELECT 2 * doc_id AS pair, before, after FROM r UNION ALL SELECT 2 * a.doc_id + 1, a.text, b.text FROM d a JOIN d b ON b.doc_id = a.doc_id + 1),
n AS (SELECT *, coalesce(len(string_split(before, chr(10))), 0) AS b, coalesce(len(string_split(after, chr(10))), 0) AS a FROM p)
SELECT pair, (a - b)::BIGINT AS net, sha256(after) AS after_sha256 FROM n""")
def text_diffs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    revised = d.selectExpr("2 * doc_id AS pair", "text AS before", f"array_join({_REVISED}, '\n') AS after")
    following = d.join(d.selectExpr("doc_id - 1 AS doc_id", "text AS after"), "doc_id").selectExpr("2 * doc_id + 1 AS pair", "text AS before", "after")
    # a pair's hunks stay beside its text, so texts are shuffled for the document that follows only
    rows = text_diff.hunked(revised.union(following), "pair").withColumn("net", text_diff.marked_lines("+") - text_diff.marked_lines("-"))
    return text_diff.patched_texts(rows).select("pair", "net", F.sha2("after", 256).alias("after_sha256"))


# teams, users and jobs: a customer is a user, a nation a team
USERS = Derived("customer", {"user_id": "c_custkey", "email": "concat(c_name, '@x.org')", "verified": "c_custkey % 3 = 0", "team_id": "c_nationkey", "role": "CASE WHEN c_custkey % 20 = 0 THEN 'owner' ELSE 'member' END"})
TEAMS = Derived("nation", {"team_id": "n_nationkey", "owner_id": "n_nationkey * 7"})
_MEMBERS = f"u AS {USERS.sql}, m AS (SELECT * FROM u WHERE user_id % 3 > 0), t AS {TEAMS.sql}"


def _members(spark, sf):
    return USERS.df(spark, sf).filter("user_id % 3 > 0")


@query(f"WITH {_MEMBERS} SELECT u.user_id, coalesce(t.owner_id, u.user_id) AS wallet_id FROM u LEFT JOIN m ON m.user_id = u.user_id LEFT JOIN t ON t.team_id = m.team_id")
def wallets(spark, sf):
    return ledger.wallets(USERS.df(spark, sf), _members(spark, sf).select("user_id", "team_id"), TEAMS.df(spark, sf))


@query(f"""WITH {_MEMBERS}, own AS (SELECT user_id, team_id FROM m UNION SELECT owner_id, team_id FROM t), w AS (SELECT team_id, user_id AS sees FROM m UNION SELECT team_id, owner_id FROM t)
SELECT user_id, sees FROM own JOIN w USING (team_id) UNION SELECT user_id, user_id FROM u""")
def team_scopes(spark, sf):
    return dashboards.team_scope(_members(spark, sf), TEAMS.df(spark, sf), USERS.df(spark, sf))


@query(f"WITH {_MEMBERS} SELECT m.team_id, m.role, u.email FROM m LEFT JOIN u USING (user_id)")
def team_roster(spark, sf):
    m, u = _members(spark, sf).select("user_id", "team_id", "role"), USERS.df(spark, sf).select("user_id", "email")
    return ledger.roster(m, u).select("team_id", "role", "email")


INVITES = Derived("orders", {"team_id": "o_custkey % 30", "status": pick("o_orderkey", "pending", "accepted", "pending"), "created_at": "o_orderdate"})
_AS_OF = "TIMESTAMP '2000-06-30 00:00:00'"


@query(f"""WITH {_MEMBERS}, i AS (SELECT team_id, count(*) AS invited FROM {INVITES.sql} WHERE status = 'pending' AND created_at > {_AS_OF} - INTERVAL 7 DAYS GROUP BY 1), n AS (SELECT team_id, count(*) AS members FROM m GROUP BY 1)
SELECT team_id, coalesce(members, 0) AS members, coalesce(invited, 0) AS invited, coalesce(members, 0) + coalesce(invited, 0) AS seats FROM n FULL JOIN i USING (team_id)""")
def seats_used(spark, sf):
    return ledger.seats_used(_members(spark, sf), INVITES.df(spark, sf), F.expr(_AS_OF))


SUBSCRIPTIONS = Derived("orders", {"user_id": "o_custkey", "id": "o_orderkey", "status": pick("o_orderkey", "active", "cancelled", "active"), "created_at": "o_orderdate", "plan": pick("o_custkey", "basic", "team", "gone")})


@query(f"SELECT user_id, id, plan FROM {SUBSCRIPTIONS.sql} x WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1")
def active_subscriptions(spark, sf):
    return ledger.active_subscriptions(SUBSCRIPTIONS.df(spark, sf)).select("user_id", "id", "plan")


@query(f"SELECT plan, count(*) AS active, count(*) * CASE plan WHEN 'basic' THEN 9 WHEN 'team' THEN 49 ELSE 0 END AS monthly FROM {SUBSCRIPTIONS.sql} x WHERE status = 'active' GROUP BY 1")
def monthly_revenue(spark, sf):
    prices = spark.createDataFrame([("basic", 9), ("team", 49)], "plan string, price long")
    return dashboards.revenue(SUBSCRIPTIONS.df(spark, sf), prices).select("plan", "active", "monthly")


@query(f"SELECT count(*) AS users, count(*) FILTER (user_id % 3 = 0) AS verified, count(*) FILTER (d >= {_AS_OF} - INTERVAL 30 DAYS) AS new_30d FROM (SELECT o_custkey AS user_id, o_orderdate AS d FROM orders)")
def user_totals(spark, sf):
    u = table(spark, sf, "orders").selectExpr("o_custkey AS user_id", "o_custkey % 3 = 0 AS verified", "o_orderdate AS created_at")
    return dashboards.user_totals(u, F.expr(_AS_OF))


@query(f"""SELECT count(*) AS total, count(*) FILTER (d >= {_AS_OF} - INTERVAL 30 DAYS) AS last_30d, count(*) FILTER (p = 'credits') AS by_credits, count(*) FILTER (p = 'subscription') AS by_subscription, count(*) FILTER (p = 'card') AS by_card
 FROM (SELECT o_orderdate AS d, {pick('o_orderkey', 'credits', 'subscription', 'card', 'none')} AS p FROM orders)""")
def certificate_totals(spark, sf):
    c = table(spark, sf, "orders").selectExpr("o_orderdate AS issued_at", f"{pick('o_orderkey', 'credits', 'subscription', 'card', 'none')} AS paid_with")
    return dashboards.certificate_totals(c, F.expr(_AS_OF))


JOBS = Derived("lineitem", {"id": "l_linenumber * 1000000 + l_partkey * 100 + l_suppkey", "doc_id": "l_orderkey", "started_at": "l_shipdate", "status": pick("l_partkey", "queued", "failed", "done", "done")})


@query(f"SELECT id, doc_id FROM {JOBS.sql} j WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3) ORDER BY started_at DESC, id DESC LIMIT 100")
def recent_jobs(spark, sf):
    d = table(spark, sf, "orders").selectExpr("o_orderkey AS doc_id", "o_custkey % 10 AS owner_id")
    return ledger.recent_jobs(JOBS.df(spark, sf), d, F.lit(3), limit=500).select("id", "doc_id")


@query("SELECT o_orderkey AS doc_id, o_custkey AS owner_id FROM orders WHERE o_custkey % 10 = 3 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10")
def documents_page(spark, sf):
    d = table(spark, sf, "orders").filter("o_custkey % 10 = 3").selectExpr("o_orderkey AS doc_id", "o_custkey AS owner_id", "o_orderdate AS created_at")
    return ledger.documents_page(d, limit=50, offset=10).select("doc_id", "owner_id")


@query(f"""WITH j AS (SELECT doc_id, arg_max(status, epoch_us(started_at)::HUGEINT * 1000000000 + id) AS job FROM {JOBS.sql} GROUP BY 1), m AS (SELECT doc_id, count(*) FILTER (status = 'pending') AS pend, count(*) FILTER (status = 'approved') AS appr FROM {REVIEWS.sql} GROUP BY 1),
i AS (SELECT doc_id, count(*) FILTER (phase = 'after' AND severity = 'critical') AS crit, count(*) FILTER (phase = 'before' AND severity IN ('serious', 'error')) AS before_serious FROM {ISSUES.sql} GROUP BY 1),
x AS (SELECT o_orderkey AS doc_id, job, pend, appr, crit, before_serious, o_custkey % 2 = 0 AS rep, (o_orderkey % 4) AS intro, (o_orderkey % 3) AS remain FROM orders LEFT JOIN j ON j.doc_id = o_orderkey LEFT JOIN m ON m.doc_id = o_orderkey LEFT JOIN i ON i.doc_id = o_orderkey)
SELECT doc_id, pend AS pending_manual, appr AS approved_manual, before_serious, CASE WHEN job = 'queued' THEN 'in_progress' WHEN job = 'failed' THEN 'errors' WHEN rep AND intro > 0 THEN 'errors' WHEN crit > 0 THEN 'errors' WHEN job IS NULL THEN 'not_run'
 WHEN rep AND remain = 0 AND coalesce(pend, 0) = 0 THEN 'fixed' ELSE 'needs_review' END AS status FROM x""")
def document_overview(spark, sf):
    d = table(spark, sf, "orders").selectExpr("o_orderkey AS doc_id")
    reports = table(spark, sf, "orders").filter("o_custkey % 2 = 0").selectExpr("o_orderkey AS doc_id", "o_orderkey % 4 AS introduced", "o_orderkey % 3 AS remaining")
    none = spark.createDataFrame([], "job_id long, pass_type string, score double, created_at timestamp")
    x = dashboards.document_overview(d, JOBS.df(spark, sf), reports, REVIEWS.df(spark, sf), ISSUES.df(spark, sf), none)
    return x.select("doc_id", "pending_manual", "approved_manual", "before_serious", "status")


@query("""WITH a AS (SELECT *, CASE WHEN r = 0 THEN [upper(f) || ' (summary)'] WHEN r = 1 THEN ['A'] ELSE ['A', 'B' || o_orderkey % 3] END AS rules FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 3 AS r, CASE o_custkey % 2 WHEN 0 THEN 'pdf' ELSE 'docx' END AS f FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 20)
SELECT rule, count(*) AS n FROM (SELECT unnest(rules) AS rule FROM a) GROUP BY 1 ORDER BY n DESC, rule LIMIT 5""")
def top_rules(spark, sf):
    a = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderdate AS ran_at", "CASE o_custkey % 2 WHEN 0 THEN 'pdf' ELSE 'docx' END AS format",
                                              "CASE o_orderkey % 3 WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array('A') ELSE array('A', concat('B', o_orderkey % 3)) END AS rules")
    return dashboards.top_rules(a)


@query(f"SELECT count(*) FILTER (o_orderdate >= {_AS_OF} - INTERVAL 7 DAYS) AS scans_this_week, floor(avg(o_orderkey % 101) + 0.5)::BIGINT AS average_score, count(*) * 12 AS minutes_saved FROM orders")
def audit_dashboard(spark, sf):
    return dashboards.dashboard(table(spark, sf, "orders").selectExpr("o_orderdate AS ran_at", "o_orderkey % 101 AS score"), F.expr(_AS_OF))


@query("SELECT id, ran_at FROM (SELECT o_orderkey % 300 AS id, max(o_orderdate) AS ran_at FROM orders GROUP BY 1) ORDER BY ran_at DESC, id LIMIT 50")
def audit_history(spark, sf):
    return dashboards.history(table(spark, sf, "orders").selectExpr("o_orderkey % 300 AS id", "o_orderdate AS ran_at")).select("id", "ran_at")


@query("""WITH x AS (SELECT o_orderkey AS id, (o_orderkey % 40 * 5)::DOUBLE AS manual, (o_custkey % 7 * 3 * 0.25)::DOUBLE AS own FROM orders) SELECT id, manual AS manual_cost, own AS own_cost, manual - own AS saved, CASE WHEN manual > 0 THEN floor(100 * (manual - own) / manual + 0.5) ELSE 0 END::DOUBLE AS saved_percent FROM x""")
def savings(spark, sf):
    c = dashboards.savings(F.expr("o_orderkey % 40"), F.lit(5.0), F.expr("o_custkey % 7"), F.lit(3), F.lit(0.25))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), *[v.cast("double").alias(k) for k, v in c.items()])


@query(f"""SELECT count(*) AS total, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'error') AS errored, floor(avg(coalesce(sc, 0)) FILTER (s = 'done') * 10 + 0.5) / 10 AS average_score, coalesce(sum(i) FILTER (s = 'done'), 0)::BIGINT AS issues,
 count(*) FILTER (s = 'done' AND r IN ('idle', 'error')) AS to_fix, coalesce(sum(CASE e WHEN 'pdf' THEN 5 WHEN 'docx' THEN 3 WHEN 'PPTX' THEN 4 ELSE 5 END) FILTER (s = 'done' AND r IN ('idle', 'error')), 0)::BIGINT AS credits, coalesce(sum(a) FILTER (r = 'remediated'), 0)::BIGINT AS applied
 FROM (SELECT {pick('o_orderkey', 'done', 'error', 'done', 'queued')} AS s, {pick('o_custkey', 'idle', 'error', 'remediated', 'running')} AS r, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 101 END AS sc, o_orderkey % 20 AS i, o_custkey % 6 AS a, {pick('o_orderkey', 'pdf', 'docx', 'PPTX', 'txt', 'pdf')} AS e FROM orders)""")
def batch_stats(spark, sf):
    x = table(spark, sf, "orders").selectExpr(f"{pick('o_orderkey', 'done', 'error', 'done', 'queued')} AS status", f"{pick('o_custkey', 'idle', 'error', 'remediated', 'running')} AS remediate_status", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 101 END AS score",
                                              "o_orderkey % 20 AS issues", "o_custkey % 6 AS applied", f"{pick('o_orderkey', 'pdf', 'docx', 'PPTX', 'txt', 'pdf')} AS extension")
    return document_checks.batch_stats(x)


@query(r"""WITH RECURSIVE t AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS t FROM part), f(id, t, i, a, score, last, streak) AS (SELECT id, t, 0, 0, 0, -1, 0 FROM t UNION ALL
 SELECT id, t, i + 1, a + h, score + CASE WHEN h = 1 THEN (CASE WHEN last = i - 1 THEN 5 + 2 * (streak + 1) ELSE 1 END) + (CASE WHEN i = 0 THEN 8 WHEN regexp_matches(t[i], '[\s._\-/()]') THEN 6 ELSE 0 END) ELSE 0 END,
  CASE WHEN h = 1 THEN i ELSE last END, CASE WHEN h = 0 THEN streak WHEN last = i - 1 THEN streak + 1 ELSE 0 END FROM (SELECT *, CASE WHEN a < 3 AND t[i + 1] = ('sre')[a + 1] THEN 1 ELSE 0 END AS h FROM f WHERE i < length(t)))
SELECT id, CASE WHEN a = 3 THEN score + greatest(0.0, 20 - length(t) / 4.0) END::DOUBLE AS score FROM f WHERE i = length(t)""")
def fuzzy_scores(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.fuzzy_score(" SRE", F.concat_ws(" ", "p_name", "p_type")).alias("score"))


@query("SELECT o_orderkey AS id, CASE WHEN c LIKE '%@%' THEN left(c, 1) || '***@' || split_part(c, '@', -1) ELSE '***' END AS masked FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'no address' ELSE 'u' || o_custkey || '@host' || o_orderkey % 5 || '.org' END AS c FROM orders)")
def masked_addresses(spark, sf):
    c = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'no address' ELSE concat('u', o_custkey, '@host', o_orderkey % 5, '.org') END")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.masked_email(c).alias("masked"))


@query(f"SELECT ext, CASE ext WHEN 'pdf' THEN 5 WHEN 'docx' THEN 3 WHEN '.PPTX' THEN 4 WHEN 'htm' THEN 3 ELSE 5 END::INT AS credits, count(*) AS n FROM (SELECT {pick('o_orderkey', 'pdf', 'docx', '.PPTX', 'htm', 'txt')} AS ext FROM orders) GROUP BY 1")
def credit_costs(spark, sf):
    x = table(spark, sf, "orders").selectExpr(f"{pick('o_orderkey', 'pdf', 'docx', '.PPTX', 'htm', 'txt')} AS ext")
    return x.groupBy("ext", text.credit_cost(F.col("ext")).alias("credits")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, upper(lpad(to_hex(round_even(CASE WHEN t < 0 THEN c * (1 + t) ELSE c + (255 - c) * t END, 0)::INT), 2, '0')) || '00FF' AS hex FROM (SELECT p_partkey, (p_partkey % 256)::DOUBLE AS c, ((p_partkey % 21) - 10) / 10.0::DOUBLE AS t FROM part)".replace("|| '00FF'", "|| upper(lpad(to_hex(round_even(CASE WHEN t < 0 THEN 0 ELSE 255 * t END, 0)::INT), 2, '0')) || upper(lpad(to_hex(round_even(CASE WHEN t < 0 THEN 255 * (1 + t) ELSE 255 END, 0)::INT), 2, '0'))"))
def tinted_colors(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), color.tinted(F.expr("concat(lpad(hex(p_partkey % 256), 2, '0'), '00FF')"), F.expr("CAST((p_partkey % 21) - 10 AS DOUBLE) / 10")).alias("hex"))


SITES = Derived("orders", {"id": "o_orderkey", "enabled": "o_orderkey % 5 > 0", "next_run_at": "o_orderdate", "claimed_at": f"CASE o_orderkey % 3 WHEN 0 THEN {_AS_OF} - INTERVAL '10' MINUTE WHEN 1 THEN {_AS_OF} - INTERVAL '20' MINUTE END", "consecutive_failures": "o_custkey % 7",
                           "frequency": pick("o_custkey", "daily", "weekly", "odd"), "failed": "o_orderkey % 4 = 0", "issues": "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 30 END", "last_issue_count": "o_custkey % 11"})


@query(f"SELECT id FROM {SITES.sql} x WHERE enabled AND next_run_at <= {_AS_OF} AND (claimed_at IS NULL OR claimed_at < {_AS_OF} - INTERVAL 900 SECONDS) AND consecutive_failures < 5")
def monitors_due(spark, sf):
    return ledger.monitors_due(SITES.df(spark, sf), F.expr(_AS_OF)).select("id")


@query(f"""SELECT id, {_AS_OF} + to_days(CASE frequency WHEN 'daily' THEN 1 ELSE 7 END) AS next_run_at, CASE WHEN failed THEN consecutive_failures + 1 ELSE 0 END AS consecutive_failures, enabled AND CASE WHEN failed THEN consecutive_failures + 1 ELSE 0 END < 5 AS enabled,
 coalesce(issues, last_issue_count) AS last_issue_count FROM {SITES.sql} x""")
def monitors_released(spark, sf):
    return ledger.released_monitors(SITES.df(spark, sf), F.expr(_AS_OF)).select("id", "next_run_at", "consecutive_failures", "enabled", "last_issue_count")


@query(f"SELECT o_orderkey AS id FROM orders WHERE o_orderdate < {_AS_OF} - INTERVAL 24 HOURS")
def expired_files(spark, sf):
    return ledger.expired(table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderdate AS created_at"), F.expr(_AS_OF), 24).select("id")


@query("""SELECT o_orderkey AS id, round(i / 1e6 * CASE m WHEN 'a' THEN 3.0 ELSE 10.0 END + o / 1e6 * CASE m WHEN 'a' THEN 15.0 ELSE 40.0 END, 9) AS cost FROM (SELECT o_orderkey, o_custkey % 5000 AS i, o_orderkey % 900 AS o, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'unknown' ELSE 'new' END AS m FROM orders)""")
def token_costs(spark, sf):
    calls = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey % 5000 AS input_tokens", "o_orderkey % 900 AS output_tokens", "CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'unknown' ELSE 'new' END AS model")
    prices = spark.createDataFrame([("a", 3.0, 15.0), ("unknown", 10.0, 40.0)], "model string, input double, output double")
    return ledger.token_cost(calls, prices).select("id", F.round("cost", 9).alias("cost"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path FROM pages), n AS (SELECT page_id, regexp_replace(lower(host), '^www\.', '') AS site,
 trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1), '\.[a-zA-Z0-9]{1,5}$', ''), '[-_+%]+', ' ', 'g')) AS w FROM p)
SELECT page_id, CASE WHEN w = '' THEN site ELSE array_to_string(list_transform(string_split(w, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' (' || site || ')' END AS suggestion FROM n""")
def suggested_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.suggested_link_text(F.col("url")).alias("suggestion"))


# folds, by recursion in SQL
ORACLES["ledger_balances"] = """WITH RECURSIVE e AS (SELECT o_custkey AS user_id, o_orderkey AS id, ['purchase', 'spend', 'spend', 'reversal'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 50 ELSE -(o_orderkey % 23) END AS amount,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders), f(user_id, id, n, applied, shortfall, balance) AS (SELECT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM e WHERE n = 1 UNION ALL
 SELECT user_id, id, n, x, CASE WHEN kind = 'reversal' THEN -amount + x ELSE 0 END, balance + x FROM (SELECT e.user_id, e.id, e.n, kind, amount, balance, CASE WHEN kind = 'reversal' THEN -least(balance, -amount) WHEN amount >= 0 OR balance + amount >= 0 THEN amount ELSE 0 END AS x
 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)) SELECT user_id, id, applied, shortfall, balance FROM f WHERE n > 0"""
ORACLES["rate_limiter"] = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f(user_id, event_id, n, w, allowed) AS (SELECT user_id, 0::BIGINT, 0::BIGINT, []::DOUBLE[], false FROM e WHERE n = 1 UNION ALL
 SELECT user_id, event_id, n, CASE WHEN len(w) < 3 THEN list_append(w, s) ELSE w END, len(w) < 3 FROM (SELECT e.user_id, e.event_id, e.n, s, list_filter(f.w, lambda t: t > s - 3600) AS w FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT user_id, event_id, allowed FROM f WHERE n > 0"""
# the nearest passing colour of each part's colours
ORACLES["contrast_suggestions"] = f"""WITH c AS (SELECT p_partkey AS id, upper(printf('%06x', (p_partkey * 7919 + 12345) % 16777216)) AS fg, upper(printf('%06x', (p_partkey * 104729 + 777) % 16777216)) AS bg,
 CASE WHEN 8 + p_partkey % 20 >= 18 OR (p_partkey % 3 = 0 AND 8 + p_partkey % 20 >= 14) THEN 3.0 ELSE 4.5 END::DOUBLE AS need FROM part), {passing_sql('c')} SELECT id, fg, bg, hex AS new_fg FROM best"""
