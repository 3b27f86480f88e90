"""Registered queries over the shipped tables, each with SQL of the same result where SQL can express it.

Operators whose inputs the shipped tables lack (positioned text, colours, ledgers, headings of all levels) run over whole
shipped tables mapped by plain arithmetic to such inputs; the SQL uses the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color, fixed_values, language, text, urls
from .operators import dashboards, executors, findings, layout, ledger, rules, scoring
from .plans import dims, planner
from .registry import ORACLES, QUERIES, query
from .sources.html import parse_pages
from .sources.staging import staged
from .sources.tables import table

def _values(words) -> str:
    return ", ".join("'" + str(w).replace("'", "''") + "'" for w in words)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return parse_pages(table(spark, sf, "pages"))


GENERIC = _values(fixed_values.GENERIC_LINK_TEXT)
URL_RE = r"(?i)^(?:https?://\S+|www\.\S+|[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:\.[a-z0-9\-]+)*\.(?:" + fixed_values.LINK_DOMAINS + r"|gov\.uk)(?:/\S*)?)$"
LINKS_SQL = rf"""links AS (
  SELECT page_id, k AS link_no, hs[k] AS target, trim(regexp_replace(replace(replace(replace(ts[k], '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, ts, hs, unnest(range(1, len(ts) + 1)) AS k
        FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">(.*?)</a>', 1) AS ts, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hs FROM pages))),
norm AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]+', '', 'g'), '\s+', ' ', 'g')) AS n FROM links),
bad AS (SELECT * FROM norm WHERE n = '' OR n IN ({GENERIC}) OR regexp_matches(text, '{URL_RE}'))"""
SCORES_SQL = """scores AS (
  SELECT page_id AS doc_id, coalesce(c, 0) AS issues, 0::BIGINT AS errors, coalesce(c, 0) AS warnings, round_even(greatest(0.0, 100 - 2.5 * coalesce(c, 0)), 2)::DOUBLE AS score,
         greatest(0.0, 100 - 2.5 * coalesce(c, 0)) AS raw
  FROM pages LEFT JOIN (SELECT page_id, count(*) AS c FROM bad GROUP BY 1) USING (page_id))"""
GRADE_SQL = "CASE WHEN raw >= 95 THEN 'A+' WHEN raw >= 90 THEN 'A' WHEN raw >= 80 THEN 'B' WHEN raw >= 70 THEN 'C' WHEN raw >= 60 THEN 'D' ELSE 'F' END"


@query(f"WITH {LINKS_SQL} SELECT 'LINK_TEXT_NON_DESCRIPTIVE' AS rule_id, 'warning' AS severity, count(*) AS total, count(DISTINCT page_id) AS pages FROM bad HAVING count(*) > 0")
def site_rule_rollup(spark, sf):
    """The flagship: parse every page, run every rule, roll up by rule."""
    return dashboards.site_rollup(rules.audit(_nodes(spark, sf)))


@query(f"WITH {LINKS_SQL} SELECT page_id, link_no, text, target FROM bad")
def link_text_findings(spark, sf):
    links = _nodes(spark, sf).filter("node_type = 'link'").selectExpr("*", "cast(row_number() over (partition by doc_id order by dfs_pos) as bigint) as link_no")
    hits = rules.RULES["LINK_TEXT_NON_DESCRIPTIVE"](links)
    return links.join(hits, ["doc_id", "node_id"], "left_semi").select(F.col("doc_id").alias("page_id"), "link_no", "text", "target")


@query(f"WITH {LINKS_SQL}, {SCORES_SQL} SELECT doc_id, issues, errors, warnings, score, {GRADE_SQL} AS grade FROM scores")
def page_scores(spark, sf):
    n = _nodes(spark, sf)
    return scoring.scan_scores(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id")), rules.audit(n))


@query(rf"WITH {LINKS_SQL}, {SCORES_SQL} SELECT regexp_extract(url, '//([^/?#:]*)', 1) AS host, round_even(avg(score), 2)::DOUBLE AS site_score, count(*) AS pages, sum(issues)::BIGINT AS issues FROM scores JOIN pages ON page_id = doc_id GROUP BY 1")
def site_scores(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), urls.host(F.col("url")).alias("host"))
    return dashboards.site_score(page_scores(spark, sf).join(p, "doc_id"), ["host"])


@query(r"""SELECT page_id AS doc_id, len(regexp_extract_all(html, '<h[1-6]')) AS n_heading, len(regexp_extract_all(html, '<a href')) AS n_link, len(regexp_extract_all(html, '<ul')) AS n_list,
  len(regexp_extract_all(html, '<li')) AS n_list_item, len(regexp_extract_all(html, '<img')) AS n_image, len(regexp_extract_all(html, '<table')) AS n_table FROM pages""")
def page_node_counts(spark, sf):
    return dashboards.page_summary(_nodes(spark, sf)).drop("nodes")


PLAN_SQL = f"""WITH {LINKS_SQL}, a(pos, action_code) AS (VALUES (0, 'IMPROVE_LINK_TEXT'), (1, 'FLAG_FOR_MANUAL_REVIEW'))
SELECT page_id AS doc_id, link_no, 'IMPROVE_LINK_TEXT' AS best_action, (SELECT string_agg(action_code, ',' ORDER BY pos) FROM a) AS actions, true AS execution_allowed FROM bad"""


@query(PLAN_SQL)
def remediation_plans(spark, sf):
    n = _nodes(spark, sf)
    no = n.filter("node_type = 'link'").selectExpr("doc_id", "node_id", "cast(row_number() over (partition by doc_id order by dfs_pos) as bigint) as link_no")
    return planner.plans(rules.audit(n)).join(no, ["doc_id", "node_id"]).select("doc_id", "link_no", "best_action", F.array_join("actions", ",").alias("actions"), "execution_allowed")


_PLANS_ALL = """WITH acts(rule_id, pos, action_code, ai, hr, au) AS (VALUES {values}),
ok AS (SELECT * FROM acts WHERE {cond})
SELECT r.rule_id, coalesce((SELECT string_agg(action_code, ',' ORDER BY pos) FROM ok WHERE ok.rule_id = r.rule_id), '') AS actions,
  (SELECT arg_min(action_code, (CASE WHEN au THEN 0 ELSE 1 END) * 8 + (CASE WHEN ai THEN 4 ELSE 0 END) + (CASE WHEN hr THEN 2 ELSE 0 END) + (CASE WHEN action_code = 'FLAG_FOR_MANUAL_REVIEW' THEN 1 ELSE 0 END)) FROM ok WHERE ok.rule_id = r.rule_id) AS best_action,
  CASE WHEN EXISTS (SELECT 1 FROM ok WHERE ok.rule_id = r.rule_id) THEN NULL WHEN EXISTS (SELECT 1 FROM acts WHERE acts.rule_id = r.rule_id) THEN 'actions_disallowed_by_policy' ELSE 'no_recommended_actions' END AS blocked_reason
FROM (VALUES {names}) r(rule_id)"""
_ACTS = ", ".join(f"('{r[0]}', {i}, '{a.partition(':')[0]}', {'I' in a.partition(':')[2]}, {'H' in a.partition(':')[2]}, {'A' in a.partition(':')[2]})" for r in dims.RULES for i, a in enumerate(r[5].split()))
_NAMES = ", ".join(f"('{r[0]}')" for r in dims.RULES)


def _plans_by_policy(spark: SparkSession, policy: planner.Policy) -> DataFrame:
    one = dims.rules(spark).selectExpr("cast(1 as bigint) as doc_id", "rule_id as violation_id", "'n1' as node_id", "rule_id", "1 as dfs_pos", "1 as bfs_pos")
    return planner.plans(one, policy).select("rule_id", F.array_join("actions", ",").alias("actions"), "best_action", "blocked_reason")


@query(_PLANS_ALL.format(values=_ACTS, cond="NOT ai AND hr", names=_NAMES))
def plans_default_policy(spark, sf):
    return _plans_by_policy(spark, planner.DEFAULT)


@query(_PLANS_ALL.format(values=_ACTS, cond=f"NOT ai AND action_code IN ({_values(dims.SCAN_ACTIONS)})", names=_NAMES))
def plans_scan_policy(spark, sf):
    return _plans_by_policy(spark, planner.SCAN)


FP_SQL = f"""WITH {LINKS_SQL},
sig AS (SELECT page_id, link_no, 'LINK_TEXT_NON_DESCRIPTIVE|LinkNode|' || left(lower(target), 200) || '|' || left(lower(text), 80) AS base FROM bad),
idx AS (SELECT *, row_number() OVER (PARTITION BY page_id, base ORDER BY link_no) - 1 AS i FROM sig)"""


@query(FP_SQL + " SELECT page_id AS doc_id, left(sha1(base || '#' || i), 16) AS fingerprint FROM idx")
def finding_fingerprints(spark, sf):
    n = _nodes(spark, sf)
    return findings.fingerprints(rules.audit(n), n).select("doc_id", "fingerprint")


@query(FP_SQL + r""", f AS (SELECT regexp_extract(url, '//([^/?#:]*)', 1) AS host, page_id % 2 AS scan, left(sha1(base || '#' || i), 16) AS fingerprint FROM idx JOIN pages USING (page_id)),
 a AS (SELECT DISTINCT host, fingerprint FROM f WHERE scan = 0), b AS (SELECT DISTINCT host, fingerprint FROM f WHERE scan = 1)
SELECT coalesce(a.host, b.host) AS host, count(*) FILTER (a.host IS NULL) AS new_count, count(*) FILTER (b.host IS NULL) AS resolved_count, count(*) FILTER (a.host IS NOT NULL AND b.host IS NOT NULL) AS unchanged_count
FROM a FULL JOIN b ON a.host = b.host AND a.fingerprint = b.fingerprint GROUP BY 1""")
def fingerprint_diff(spark, sf):
    host = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), urls.host(F.col("url")).alias("host"))
    # both scans are read from it, so pages are audited once
    f = staged(finding_fingerprints(spark, sf).join(host, "doc_id"), "fingerprints")
    return findings.fingerprint_diff(f.filter("doc_id % 2 = 0"), f.filter("doc_id % 2 = 1"), "host")


_CRIT = ", ".join(f"('{n}', '{lv}')" for n, _, lv in dims.CRITERIA)
_CRULES = ", ".join(f"('{n}', '{r}')" for n, rs in dims.CRITERION_RULES.items() for r in rs.split())
VERDICT_SQL = f"""WITH {LINKS_SQL}, c(num, level) AS (VALUES {_CRIT}), cr(num, rule_id) AS (VALUES {_CRULES}),
h AS (SELECT num, count(*) AS findings FROM bad JOIN cr ON cr.rule_id = 'LINK_TEXT_NON_DESCRIPTIVE' GROUP BY 1),
v AS (SELECT c.num, level, coalesce(findings, 0) AS findings, CASE WHEN c.num NOT IN (SELECT num FROM cr) THEN 'Not Evaluated' WHEN findings IS NULL THEN 'Supports' ELSE 'Partially Supports' END AS status FROM c LEFT JOIN h USING (num))"""


@query(VERDICT_SQL + " SELECT num, level, status, findings FROM v")
def wcag_verdicts(spark, sf):
    return scoring.wcag_verdicts(rules.audit(_nodes(spark, sf))).select("num", "level", "status", "findings")


@query(VERDICT_SQL + " SELECT status, count(*) AS criteria FROM v GROUP BY 1")
def wcag_totals(spark, sf):
    return scoring.verdict_totals(wcag_verdicts(spark, sf))


_URL = r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[^:]*://([^/?#:]*)', 1)) AS host,
  regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages)"""


@query(_URL + r""" SELECT page_id, scheme || '://' || host || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN query = '' THEN '' ELSE '?' || left(sha1(query), 10) END AS url_key,
  scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS shown, host, scheme || '|' || host || '|' || CASE WHEN scheme = 'https' THEN '443' ELSE '80' END AS origin FROM p""")
def url_keys(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.url_key(u).alias("url_key"), urls.sanitized_url(u).alias("shown"), urls.host(u).alias("host"), urls.origin(u).alias("origin"))


@query(rf"""WITH {LINKS_SQL} SELECT page_id, link_no, CASE WHEN n = '' THEN 'empty' WHEN regexp_matches(text, '{URL_RE.replace("|gov[.]uk", "")}') THEN 'url' WHEN n IN ({GENERIC}) THEN 'generic' WHEN length(n) <= 2 THEN 'short' ELSE 'ok' END AS verdict,
  target = '' OR target IN ('#', 'http://', 'https://') AS broken, '' AS reason FROM norm""")
def link_verdicts(spark, sf):
    x = _nodes(spark, sf).filter("node_type = 'link'").selectExpr("doc_id as page_id", "cast(row_number() over (partition by doc_id order by dfs_pos) as bigint) as link_no", "text", "target")
    return x.select("page_id", "link_no", text.link_text_verdict(F.col("text")).alias("verdict"), text.target_is_broken(F.col("target")).alias("broken"), text.invalid_link_reason(F.col("target")).alias("reason"))


@query("SELECT page_id, 1::BIGINT AS headings, 1::BIGINT AS h1, 0::BIGINT AS empty, 0::BIGINT AS jumps, 1 AS first_level, true AS ok FROM pages")
def heading_outlines(spark, sf):
    return dashboards.outline_report(table(spark, sf, "pages").select("page_id", "html"), "page_id", "html").withColumn("first_level", F.col("first_level").cast("int"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: regexp_matches(x, '(?i)[a-z0-9]'))) AS w FROM documents),
y AS (SELECT doc_id, regexp_replace(lower(w), '[^a-z]', '', 'g') AS w FROM w),
s AS (SELECT doc_id, CASE WHEN w = '' THEN 0 WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - (CASE WHEN w LIKE '%e' AND w NOT LIKE '%le' THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(w, '[^aeiou]le$') THEN 1 ELSE 0 END)) END AS s FROM y),
a AS (SELECT doc_id, count(*) AS words, sum(s)::BIGINT AS syllables, count(*) FILTER (s >= 3) AS complex_words FROM s GROUP BY 1),
b AS (SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: regexp_matches(x, '(?i)[a-z0-9]'))))::BIGINT AS sentences FROM documents),
e AS (SELECT *, greatest(0.0, least(100.0, 206.835::DOUBLE - 1.015::DOUBLE * (words::DOUBLE / sentences) - 84.6::DOUBLE * (syllables::DOUBLE / words))) AS ease, greatest(0.0, 0.39::DOUBLE * (words::DOUBLE / sentences) + 11.8::DOUBLE * (syllables::DOUBLE / words) - 15.59::DOUBLE) AS g FROM a JOIN b USING (doc_id))
SELECT doc_id, words, sentences, syllables, complex_words, floor(ease * 10 + 0.5) / 10 AS reading_ease, floor(g * 10 + 0.5) / 10 AS grade_level,
  CASE WHEN ease >= 90 THEN 'Very easy — 5th grade' WHEN ease >= 80 THEN 'Easy — 6th grade' WHEN ease >= 70 THEN 'Fairly easy — 7th grade' WHEN ease >= 60 THEN 'Plain English — 8th–9th grade' WHEN ease >= 50 THEN 'Fairly difficult — 10th–12th grade' WHEN ease >= 30 THEN 'Difficult — college' ELSE 'Very difficult — college graduate' END AS band FROM e""")
def readability(spark, sf):
    return dashboards.readability(table(spark, sf, "documents"), "doc_id", "text")


@query(r"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: regexp_matches(x, '(?i)[a-z0-9]')) AS ss FROM documents),
x AS (SELECT doc_id, i AS sentence, len(list_filter(regexp_split_to_array(ss[i], '[ \t\n\x0B\f\r]+'), lambda x: regexp_matches(x, '(?i)[a-z0-9]'))) AS words FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s))
SELECT doc_id, sentence, words FROM x WHERE words > 25 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, sentence) <= 5""")
def long_sentences(spark, sf):
    return dashboards.long_sentences(table(spark, sf, "documents"), "doc_id", "text")


def _vote_sql(words) -> str:
    # words are counted one by one: the lists hold no word that is part of another's boundary
    parts = [f"len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({_values(ws)})))" for _, ws in words]
    return ", ".join(f"{p} AS {c}" for p, (c, _) in zip(parts, words, strict=True))


@query(f"""WITH v AS (SELECT doc_id, {_vote_sql(fixed_values.LANGUAGE_WORDS)} FROM documents), b AS (SELECT *, greatest(en, fr, es, de, it) AS best FROM v)
SELECT doc_id, en, fr, es, de, it, CASE WHEN best = 0 THEN NULL WHEN en = best THEN 'en' WHEN fr = best THEN 'fr' WHEN es = best THEN 'es' WHEN de = best THEN 'de' ELSE 'it' END AS language,
  round(CASE WHEN best = 0 THEN 0 ELSE least(0.85, 0.3 + 0.05 * best) END, 2)::DOUBLE AS confidence FROM b""")
def language_vote(spark, sf):
    votes = language.language_votes(F.coalesce("text", F.lit("")))
    d = table(spark, sf, "documents").select("doc_id", *[n.cast("long").alias(c) for c, n in votes.items()])
    named = {c: F.col(c) for c in votes}
    return d.withColumns({"language": language.winner(named), "confidence": F.round(language.vote_confidence(F.greatest(*named.values())), 2)})


@query(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '[\x{3040}-\x{30FF}]')) AS ja, len(regexp_extract_all(text, '\p{Cyrillic}')) AS ru FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, letters, CASE WHEN letters > 0 AND ja > 0 AND ja::DOUBLE / letters >= 0.6 THEN 'ja' WHEN letters > 0 AND ru > 0 AND ru::DOUBLE / letters >= 0.6 THEN 'ru' END AS script FROM c""")
def dominant_scripts(spark, sf):
    d = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("letters"), language.dominant_script(F.col("text"))["code"].alias("script"))


@query(r"""WITH l AS (SELECT doc_id, i AS line_no, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
h AS (SELECT doc_id, line_no, CASE WHEN t = '' OR length(t) > 120 THEN NULL WHEN regexp_matches(t, '^\d+(\.\d+){0,5}\s+.+$') THEN least(6, len(regexp_extract_all(regexp_extract(t, '^(\d+(\.\d+){0,5})', 1), '\.')) + 1)
  WHEN length(t) <= 80 AND regexp_matches(t, '^[A-Z0-9][A-Z0-9 \-:&,''".]+$') THEN 1 WHEN len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) <= 8 AND t LIKE '%:' THEN 2 END AS level FROM l)
SELECT doc_id, line_no, level::INT AS level FROM h WHERE level IS NOT NULL""")
def heading_lines(spark, sf):
    x = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return x.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), text.heading_level_of_line(F.col("line")).cast("int").alias("level")).filter("level is not null")


@query(f"""SELECT page_id, lower(trim(t)) IN ({_values(fixed_values.GENERIC_TITLES)}) OR regexp_matches(lower(trim(t)), '^({'|'.join(fixed_values.NUMBERED_TITLES)})\\s*\\d+$') AS placeholder, trim(t) = '' AS empty
FROM (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t FROM pages)""")
def title_checks(spark, sf):
    t = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return table(spark, sf, "pages").select("page_id", text.title_is_placeholder(t).alias("placeholder"), text.blank(t).alias("empty"))


@query(r"""SELECT doc_id, CASE WHEN l = '' THEN 'doc' ELSE l END AS label FROM (SELECT doc_id, trim(left(regexp_replace(trim(regexp_replace(regexp_replace(text, '[/\\:*?"<>|\p{Cc}\p{Cf}\p{Co}]', '', 'g'), '\s+', ' ', 'g')), '^[. ]+', ''), 96)) AS l FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""")
def document_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.document_id(F.col("text")).alias("label"))


@query("""WITH b AS (SELECT date_trunc('week', max(ts))::DATE AS last FROM events), w AS (SELECT (last - 7 * i::INT)::DATE AS week FROM b, range(12) r(i)),
e AS (SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n, sum(value) AS v FROM events GROUP BY 1) SELECT week, coalesce(n, 0) AS n, round(coalesce(v, 0), 4) AS total FROM w LEFT JOIN e USING (week)""")
def weekly_timeline(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts")).first()[0]
    return dashboards.weekly(e, "ts", F.lit(last), total=F.col("value")).withColumn("total", F.round("total", 4))


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS run FROM d), l AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY 1, 2)
SELECT user_id, max(n) AS longest_streak, sum(n)::BIGINT AS active_days FROM l GROUP BY 1""")
def activity_streaks(spark, sf):
    return dashboards.longest_streaks(table(spark, sf, "events"), ["user_id"], "ts")


@query("""WITH b AS (SELECT max(ts)::DATE AS last FROM events), s AS (SELECT i::INT AS i, (last - 34 + i::INT)::DATE AS day FROM b, range(35) r(i)), e AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)
SELECT day, (i // 7)::INT AS week, (isodow(day) - 1)::INT AS weekday, coalesce(n, 0) AS n FROM s LEFT JOIN e USING (day)""")
def activity_heatmap(spark, sf):
    e = table(spark, sf, "events")
    return dashboards.heatmap(e, "ts", F.to_date(F.lit(e.agg(F.max("ts")).first()[0])))


@query("""SELECT event_id, user_id, (count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)) - 1 AS in_window,
 (count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)) - 1 < 3 AS allowed FROM events""")
def trailing_24h_cap(spark, sf):
    return ledger.trailing(table(spark, sf, "events"), ["user_id"], "ts", 24, 3).select("event_id", "user_id", "in_window", "allowed")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND contains(user_id::VARCHAR, '1') ORDER BY ts DESC, event_id DESC LIMIT 2000")
def audit_filter(spark, sf):
    log = table(spark, sf, "events").selectExpr("event_id as id", "ts as at", "cast(user_id as string) as actor_email", "event_type as event", "user_id")
    return ledger.audit_list(log, email="1", event="click", since=F.lit("2024-01-05").cast("timestamp"), until=F.lit("2024-01-20").cast("timestamp"), limit=2000).selectExpr("id as event_id", "user_id", "event as event_type")


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def retention_top20(spark, sf):
    return findings.retained(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "ts")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS")
def audit_purge(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.col("ts"))
    return ledger.purged(e, F.lit(e.agg(F.max("ts")).first()[0]), 10).select("event_id", "ts")


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10")
def recent_events(spark, sf):
    return dashboards.recent(table(spark, sf, "events"), [F.desc("ts"), F.col("event_id")]).select("event_id", "user_id", "ts")


@query()
def rate_limiter(spark, sf):
    return ledger.rate_limited(table(spark, sf, "events"), "user_id", "ts", most=3, seconds=3600.0)


_COLORS = """c AS (SELECT p_partkey AS id, upper(printf('%06x', (p_partkey * 7919 + 12345) % 16777216)) AS fg, upper(printf('%06x', (p_partkey * 104729 + 777) % 16777216)) AS bg, (8 + p_partkey % 20)::DOUBLE AS pt, p_partkey % 3 = 0 AS strong FROM part)"""


def _lum(c: str) -> str:
    part = [f"(('0x' || substr({c}, {i}, 2))::INT / 255.0::DOUBLE)" for i in (1, 3, 5)]
    lin = [f"(CASE WHEN {p} <= 0.03928 THEN {p} / 12.92::DOUBLE ELSE pow(({p} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)" for p in part]
    return f"({lin[0]} * 0.2126::DOUBLE + {lin[1]} * 0.7152::DOUBLE + {lin[2]} * 0.0722::DOUBLE)"


@query(f"""WITH {_COLORS}, l AS (SELECT *, {_lum('fg')} AS a, {_lum('bg')} AS b FROM c), r AS (SELECT *, (greatest(a, b) + 0.05::DOUBLE) / (least(a, b) + 0.05::DOUBLE) AS x, CASE WHEN pt >= 18 OR (strong AND pt >= 14) THEN 3.0 ELSE 4.5 END::DOUBLE AS need FROM l)
SELECT id, fg, bg, round(x, 6) AS ratio, need AS required, x + 0.05::DOUBLE < need AS low FROM r""")
def contrast_checks(spark, sf):
    c = _colors(spark, sf)
    fg, bg = F.col("fg"), F.col("bg")
    return c.select("id", "fg", "bg", F.round(color.contrast(fg, bg), 6).alias("ratio"), color.required(F.col("pt"), F.col("strong")).cast("double").alias("required"), color.low_contrast(fg, bg, F.col("pt"), F.col("strong")).alias("low"))


def _colors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey as id", "lpad(hex((p_partkey * 7919 + 12345) % 16777216), 6, '0') as fg", "lpad(hex((p_partkey * 104729 + 777) % 16777216), 6, '0') as bg",
        "cast(8 + p_partkey % 20 as double) as pt", "p_partkey % 3 = 0 as strong")


@query()
def contrast_suggestions(spark, sf):
    # a few MB of parts are one split, but much work: dealt over all cores
    c = _colors(spark, sf).repartition(spark.sparkContext.defaultParallelism, "id")
    need = color.required(F.col("pt"), F.col("strong"))
    new = color.nearest_passing(F.col("fg"), F.col("bg"), need)
    return c.select("id", "fg", "bg", new.alias("new_fg")).filter("new_fg is not null")


# headings of all levels: a document's line i is a heading of level (doc_id * 7 + i * i * 3) % 6 + 1
_HEADS = "h AS (SELECT doc_id, i::INT AS dfs_pos, ((doc_id * 7 + i * i * 3) % 6 + 1)::INT AS level FROM (SELECT doc_id, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents))"


def _headings(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("dfs_pos", "text"))
    return x.selectExpr("doc_id", "concat('n', dfs_pos) as node_id", "'heading' as node_type", "dfs_pos", "text", "cast((doc_id * 7 + dfs_pos * dfs_pos * 3) % 6 + 1 as int) as level")


@query(f"WITH {_HEADS}, l AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY dfs_pos) AS before FROM h) SELECT doc_id, 'n' || dfs_pos AS node_id, 'HEADING_LEVEL_JUMP' AS rule_id FROM l WHERE level > before + 1")
def heading_jumps(spark, sf):
    return rules.RULES["HEADING_LEVEL_JUMP"](_headings(spark, sf)).select("doc_id", "node_id", "rule_id")


@query(f"""WITH RECURSIVE {_HEADS}, f(doc_id, dfs_pos, old_level, level) AS (SELECT doc_id, dfs_pos, level, level FROM h WHERE dfs_pos = 0
 UNION ALL SELECT h.doc_id, h.dfs_pos, h.level, least(h.level, f.level + 1, 6) FROM f JOIN h ON h.doc_id = f.doc_id AND h.dfs_pos = f.dfs_pos + 1)
SELECT doc_id, 'n' || dfs_pos AS node_id, old_level, level FROM f WHERE old_level <> level""")
def normalized_headings(spark, sf):
    return executors.normalized_heading_levels(_headings(spark, sf))


@query(f"WITH {_HEADS}, l AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY dfs_pos) AS before FROM h) SELECT doc_id, arg_min('n' || dfs_pos, dfs_pos) AS node_id, arg_min(level, dfs_pos) AS level, arg_min(before, dfs_pos) AS before FROM l WHERE level > before + 1 GROUP BY 1")
def first_heading_skips(spark, sf):
    return layout.first_skips(_headings(spark, sf).withColumn("tag", F.concat(F.lit("H"), F.col("level"))))


# positioned text: order lines as blocks of an order's page
@query("""WITH b AS (SELECT l_orderkey AS doc_id, (8 + l_quantity::INT % 5) AS size, length(l_partkey::VARCHAR) AS c FROM lineitem), s AS (SELECT doc_id, size, sum(c) AS chars FROM b GROUP BY 1, 2),
y AS (SELECT doc_id, size AS body FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, size) = 1), l AS (SELECT s.doc_id, size, least(6, dense_rank() OVER (PARTITION BY s.doc_id ORDER BY size DESC))::INT AS level FROM s JOIN y USING (doc_id) WHERE size > body * 1.15::DOUBLE)
SELECT level, count(*) AS blocks FROM b LEFT JOIN l USING (doc_id, size) GROUP BY 1""")
def heading_sizes(spark, sf):
    b = table(spark, sf, "lineitem").selectExpr("l_orderkey as doc_id", "8 + cast(l_quantity as int) % 5 as size", "cast(l_partkey as string) as text")
    return layout.heading_sizes(b).groupBy("level").agg(F.count("*").alias("blocks"))


@query("""WITH i AS (SELECT o_custkey AS k, (floor(o_totalprice)::BIGINT % 1000)::DOUBLE AS lo, (floor(o_totalprice)::BIGINT % 1000 + 10 + o_orderkey % 50)::DOUBLE AS hi FROM orders),
m AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i) SELECT k, sum(greatest(0.0, hi - greatest(lo, coalesce(r, lo))))::DOUBLE AS covered FROM m GROUP BY 1""")
def interval_coverage(spark, sf):
    i = table(spark, sf, "orders").selectExpr("o_custkey as k", "cast(cast(floor(o_totalprice) as bigint) % 1000 as double) as lo", "cast(cast(floor(o_totalprice) as bigint) % 1000 + 10 + o_orderkey % 50 as double) as hi")
    return layout.covered_length(i, ["k"], "lo", "hi")


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, round(o_totalprice)::BIGINT % 1000 AS x FROM orders), n AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY k ORDER BY x) > 40 THEN 1 ELSE 0 END AS f FROM s),
g AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY x ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT k, island::BIGINT AS island, round(avg(x), 6) AS center, count(*) AS n FROM g GROUP BY 1, 2""")
def gap_clusters(spark, sf):
    v = table(spark, sf, "orders").selectExpr("o_custkey as k", "cast(round(o_totalprice) as bigint) % 1000 as x")
    return layout.clusters(v, ["k"], "x", 40).select("k", F.col("island").cast("long").alias("island"), F.round("center", 6).alias("center"), "n")


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_partkey % 3 AS slide, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS idx, (l_suppkey * 90000) % 5000000 AS top FROM lineitem),
m AS (SELECT *, min(top + 100000) OVER (PARTITION BY doc_id, slide ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS low FROM s) SELECT DISTINCT doc_id, slide FROM m WHERE top > low + 182880""")
def inverted_slides(spark, sf):
    s = table(spark, sf, "lineitem").selectExpr("l_orderkey as doc_id", "l_partkey % 3 as slide", "l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey as idx", "(l_suppkey * 90000) % 5000000 as top", "100000 as height", "'a text of a dozen' as text")
    return layout.inverted_slides(s)


# results of audits: an order is a document's result
@query("""SELECT o_custkey AS user_id, count(*) AS documents, sum(o_orderkey % 20)::BIGINT AS found, sum((o_orderkey % 20) // 2)::BIGINT AS fixed, sum((o_orderkey % 20) - (o_orderkey % 20) // 2)::BIGINT AS pending FROM orders GROUP BY 1""")
def results_by_user(spark, sf):
    return _results(spark, sf).groupBy("user_id").agg(F.count("*").alias("documents"), F.sum("initial_issues").alias("found"), F.sum("fixed_automatically").alias("fixed"), F.sum("pending_manual").alias("pending"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_custkey as user_id", "o_orderkey as document_id", "o_orderkey % 20 as initial_issues", "(o_orderkey % 20) div 2 as fixed_automatically", "(o_orderkey % 20) - (o_orderkey % 20) div 2 as pending_manual",
        "o_orderkey % 101 as score", "element_at(array('pdf', 'DOCX', 'pptx', 'html', ''), cast(o_orderkey % 5 + 1 as int)) as source_format", "element_at(array('A', 'B', 'C', 'D', 'F', 'A+'), cast(o_orderkey % 6 + 1 as int)) as grade")


@query("""SELECT count(*) AS documents, sum(o_orderkey % 20)::BIGINT AS found, sum((o_orderkey % 20) // 2)::BIGINT AS fixed, sum((o_orderkey % 20) - (o_orderkey % 20) // 2)::BIGINT AS pending, round_even(avg(o_orderkey % 101), 0)::BIGINT AS average_score,
 round_even(100.0 * sum((o_orderkey % 20) // 2) / sum(o_orderkey % 20), 0)::BIGINT AS percent_fixed FROM orders""")
def metrics_totals(spark, sf):
    return dashboards.totals(_results(spark, sf))


@query("SELECT CASE WHEN f = '' THEN 'other' ELSE lower(f) END AS format, count(*) AS documents, sum(i)::BIGINT AS found FROM (SELECT ['pdf', 'DOCX', 'pptx', 'html', ''][o_orderkey % 5 + 1] AS f, o_orderkey % 20 AS i FROM orders) GROUP BY 1")
def metrics_by_format(spark, sf):
    return dashboards.by_format(_results(spark, sf))


@query("SELECT g AS grade, count(*) AS documents, CASE WHEN length(g) = 1 THEN strpos('ABCDF', g) ELSE 99 END::INT AS rank FROM (SELECT ['A', 'B', 'C', 'D', 'F', 'A+'][o_orderkey % 6 + 1] AS g FROM orders) GROUP BY 1")
def metrics_by_grade(spark, sf):
    return dashboards.by_grade(_results(spark, sf)).withColumn("rank", F.col("rank").cast("int"))


_ISSUES = "i AS (SELECT l_orderkey AS doc_id, 'pdf' AS t, ['MISSING_ALT_TEXT', 'missing_tag_structure', 'reading_order', 'x'][l_partkey % 4 + 1] AS r, ['error', 'warning', 'info'][l_suppkey % 3 + 1] AS s FROM lineitem)"


@query(f"""WITH {_ISSUES}, c AS (SELECT doc_id, CASE WHEN r = 'MISSING_ALT_TEXT' THEN 'serious' WHEN s = 'error' THEN 'serious' WHEN s = 'warning' THEN 'moderate' ELSE 'minor' END AS c FROM i),
a AS (SELECT doc_id, count(*) AS applicable, 0::BIGINT AS n_critical, count(*) FILTER (c = 'serious') AS n_serious, count(*) FILTER (c = 'moderate') AS n_moderate, count(*) FILTER (c = 'minor') AS n_minor FROM c GROUP BY 1)
SELECT *, (8.0 * n_serious + 3.0 * n_moderate + n_minor)::DOUBLE AS penalty, greatest(0.0, 100 - (8.0 * n_serious + 3.0 * n_moderate + n_minor))::DOUBLE AS score, CASE WHEN n_serious <= 2 THEN 'pass' WHEN n_serious <= 10 THEN 'needs_review' ELSE 'fail' END AS status FROM a""")
def policy_scores(spark, sf):
    i = table(spark, sf, "lineitem").selectExpr("l_orderkey as doc_id", "'pdf' as doc_type", "element_at(array('MISSING_ALT_TEXT', 'missing_tag_structure', 'reading_order', 'x'), cast(l_partkey % 4 + 1 as int)) as rule_id",
                                                "element_at(array('error', 'warning', 'info'), cast(l_suppkey % 3 + 1 as int)) as severity", "cast(null as double) as confidence")
    return scoring.policy_scores(i, "policy-508-wcag20-aa")


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey::VARCHAR AS issue_key FROM lineitem WHERE l_linenumber % 2 = 0), a AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey::VARCHAR AS issue_key FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.issue_key, b.issue_key) AS issue_key, CASE WHEN a.doc_id IS NULL THEN 'fixed' WHEN b.doc_id IS NULL THEN 'introduced' ELSE 'remaining' END AS state FROM b FULL JOIN a ON a.doc_id = b.doc_id AND a.issue_key = b.issue_key""")
def issue_deltas(spark, sf):
    x = table(spark, sf, "lineitem").selectExpr("l_orderkey as doc_id", "cast(l_partkey as string) as issue_key", "l_linenumber % 2 as phase")
    return findings.issue_delta(x.filter("phase = 0"), x.filter("phase = 1"))


_STATE = "s AS (SELECT o_orderkey AS doc_id, ['queued', 'failed', 'done', 'done', 'done'][o_orderkey % 5 + 1] AS job, o_custkey % 7 <> 0 AS jobs, o_orderkey % 3 <> 0 AS report, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS intro, CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 0 END AS crit, o_custkey % 4 AS pend, o_custkey % 3 AS rem, ['pass', 'fail', 'needs_review', ''][o_custkey % 4 + 1] AS sc FROM orders)"


@query(f"""WITH {_STATE} SELECT doc_id, CASE WHEN job = 'queued' THEN 'in_progress' WHEN job = 'failed' THEN 'errors' WHEN intro > 0 THEN 'errors' WHEN crit > 0 THEN 'errors' WHEN sc = 'fail' THEN 'errors' WHEN NOT jobs THEN 'not_run' WHEN report AND rem = 0 AND intro = 0 AND pend = 0 THEN 'fixed'
 WHEN pend > 0 OR sc = 'needs_review' OR rem > 0 OR NOT report THEN 'needs_review' ELSE 'fixed' END AS status FROM s""")
def document_states(spark, sf):
    s = table(spark, sf, "orders").selectExpr(
        "o_orderkey as doc_id", "element_at(array('queued', 'failed', 'done', 'done', 'done'), cast(o_orderkey % 5 + 1 as int)) as latest_job_status", "o_custkey % 7 <> 0 as has_jobs", "o_orderkey % 3 <> 0 as has_fix_report",
        "if(o_orderkey % 11 = 0, 1, 0) as introduced", "if(o_orderkey % 13 = 0, 2, 0) as critical_remaining", "o_custkey % 4 as pending_manual", "o_custkey % 3 as remaining",
        "element_at(array('pass', 'fail', 'needs_review', ''), cast(o_custkey % 4 + 1 as int)) as preferred_score_status")
    return s.select("doc_id", scoring.document_status()["status"].alias("status"))


@query("SELECT sum(CASE WHEN a > 0 THEN a ELSE 0 END)::BIGINT AS granted, sum(CASE WHEN a < 0 THEN -a ELSE 0 END)::BIGINT AS spent, sum(a)::BIGINT AS outstanding FROM (SELECT (o_orderkey % 41) - 20 AS a FROM orders)")
def credit_totals(spark, sf):
    return dashboards.credit_totals(table(spark, sf, "orders").selectExpr("(o_orderkey % 41) - 20 as amount"))


@query()
def ledger_balances(spark, sf):
    x = table(spark, sf, "orders").selectExpr("o_custkey as user_id", "o_orderkey as id", "o_orderdate as at", "element_at(array('purchase', 'spend', 'spend', 'reversal'), cast(o_orderkey % 4 + 1 as int)) as kind",
                                              "if(o_orderkey % 4 = 0, 50, -(o_orderkey % 23)) as amount", "cast(o_orderkey as string) as ref")
    return ledger.balances(x)


@query("SELECT labels.quality, labels.toxic, count(*) AS documents, round(avg(length(text)), 3) AS average_chars FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def labelled_lengths(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))
    return table(spark, sf, "labels").join(d, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("documents"), F.round(F.avg("n"), 3).alias("average_chars"))


@query(r"SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN length(t) < 4 THEN 'too_short' WHEN length(t) > 140 THEN 'too_long' WHEN regexp_matches(lower(t), '^(image of|picture of|photo of|graphic of)') THEN 'generic_prefix' WHEN lower(t) IN ('decorative', 'n/a', 'none', 'no alt') THEN 'generic_value' ELSE 'pass' END AS verdict FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations)")
def alt_verdicts(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.alt_verdict(F.col("text")).alias("verdict"))


@query(r"""SELECT page_id, 'Read more about ' || regexp_replace(regexp_extract(url, '//([^/?#]*)', 1), '^www\.', '') AS suggestion FROM pages""")
def heuristic_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.heuristic_link_text(F.col("url"), F.lit("a link")).alias("suggestion"))


from . import queries_edits, queries_layout, queries_nodes, queries_records, queries_sources  # noqa: E402, F401  they register theirs
