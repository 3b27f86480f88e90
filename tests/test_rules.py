from pyspark.sql import functions as F

from wardlume.functions import color, text
from wardlume.operators import dashboards, executors, findings, layout, ledger, rules, scoring
from wardlume.plans import planner
from wardlume.sources.html import parse_pages, purpose, Element

DIRTY = """<html><body><h1>Top</h1><h3>Deep</h3><h2></h2><img src=a.png><img src=b.png alt="IMG_1234"><a href="/docs">click here</a><a href="#">go</a>
<iframe src=x></iframe><input name=email_address><input type=password name=password><span tabindex=3>x</span>
<table><tr><td>a<td>b<td>c<tr><td>1<td>2<td>3<tr><td>4<td>5<td>6</table><ul></ul><p style="color:#999999;background:#fff">grey</p><a href="/n"></a></body></html>"""
CLEAN = """<html lang=en><head><title>A real title</title></head><body><h1>Top</h1><h2>Next</h2><img src=a.png alt="A red car on a road"><a href="/docs">Read the annual report</a>
<iframe src=x title="Map"></iframe><label for=e>Email</label><input id=e name=email autocomplete=email><table><tr><th>a<th>b<tr><td>1<td>2</table><ul><li>x</ul></body></html>"""


def audit(spark, *pages):
    nodes = parse_pages(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).cache()
    return nodes, rules.audit(nodes).cache()


def test_dirty_and_clean_pages(spark):
    _, found = audit(spark, DIRTY, CLEAN, None, "")
    by = {}
    for r in found.collect():
        by.setdefault(r["doc_id"], []).append(r["rule_id"])
    assert set(by[0]) == {"HEADING_LEVEL_JUMP", "HEADING_TEXT_EMPTY", "MISSING_ALT_TEXT", "ALT_TEXT_NOT_DESCRIPTIVE", "LINK_TEXT_NON_DESCRIPTIVE", "LINK_TARGET_BROKEN", "LINK_NAME_MISSING",
                          "IFRAME_TITLE_MISSING", "INPUT_AUTOCOMPLETE_MISSING", "POSITIVE_TABINDEX", "FORM_FIELD_UNLABELED", "DOCUMENT_LANGUAGE_MISSING", "DOCUMENT_TITLE_MISSING",
                          "TABLE_MISSING_HEADERS", "TABLE_CAPTION_MISSING", "LIST_STRUCTURE_INVALID", "LOW_CONTRAST_TEXT"}
    assert 1 not in by
    assert set(by[2]) == set(by[3]) == {"DOCUMENT_LANGUAGE_MISSING", "DOCUMENT_TITLE_MISSING"}


def test_one_finding_per_node_and_rule(spark):
    _, found = audit(spark, DIRTY)
    assert found.groupBy("doc_id", "node_id", "rule_id").count().filter("count > 1").count() == 0


def test_fingerprints_survive_insertion_and_wrapping(spark):
    shifted = DIRTY.replace("<h1>", "<p>new</p><p>lines</p><h1>")
    wrapped = DIRTY.replace("<body>", "<body><div><div>")
    nodes, found = audit(spark, DIRTY, shifted, wrapped)
    prints = {}
    # the document node is recognised by its first texts, so only its parts are independent of insertions
    for r in findings.fingerprints(found.filter("node_type <> 'document'"), nodes).collect():
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[0] == prints[1] == prints[2]


def test_fingerprints_are_those_of_all_findings(spark):
    page = "<body>" + "".join(f'<p><a href="/t{i}">click here</a></p>' for i in range(450))
    nodes, found = audit(spark, page, page.replace('<p><a href="/t7">click here</a></p>', ""))
    total = {r["doc_id"]: r["count"] for r in found.groupBy("doc_id").count().collect()}
    prints = findings.fingerprints(found, nodes)
    assert {r["doc_id"]: r["count"] for r in prints.groupBy("doc_id").count().collect()} == total and min(total.values()) > 400
    same_site = lambda df, i: df.filter(f"doc_id = {i}").withColumn("site", F.lit("s"))
    links = found.filter("node_type = 'link'")
    whole, cut = findings.fingerprints(links, nodes), findings.fingerprints(links, nodes, findings.MOST_FINGERPRINTS)
    got = findings.fingerprint_diff(same_site(whole, 0), same_site(whole, 1), "site").first().asDict()
    assert got == {"site": "s", "new_count": 0, "resolved_count": 1, "unchanged_count": 449}
    assert cut.filter("truncated").count() == cut.count() == 800
    for a, b in ((cut, cut), (cut, whole), (whole, cut)):
        got = findings.fingerprint_diff(same_site(a, 0), same_site(b, 1), "site").first()
        assert got["partial"] and got["resolved_count"] == 0
    short = findings.fingerprints(links, nodes, 1000)
    got = findings.fingerprint_diff(same_site(short, 0), same_site(short, 1), "site").first()
    assert (got["partial"], got["resolved_count"]) == (False, 1)


def test_diffs_carry_the_cut_of_either_scan(spark):
    rows = [(1, "u", i, i, p, "1", t, 80) for i, (p, t) in enumerate([(["a", "b"], False), (["a"], True), (["b"], False), (["c"], False)])]
    df = spark.createDataFrame(rows, "user_id long, url_key string, id long, created_at long, fingerprints array<string>, version string, truncated boolean, score int")
    assert [(r["resolved_count"], r["partial"]) for r in findings.scan_changes(df).orderBy("id").collect()] == [(0, True), (0, True), (1, False)]


def test_streaming_alerts_carry_the_cut(spark, tmp_path):
    from wardlume.streaming.jobs import rescan_alerts

    schema = "site string, scan_id long, fingerprints array<string>, truncated boolean"
    rows = [("s", i, p, t) for i, (p, t) in enumerate([(["a", "b"], False), (["a"], True), (["b"], None), (["c"], False)])]
    for k, want in (("plain", [(0, 0, 1), (1, 1, 1), (2, 1, 1)]), ("marked", [(0, 0, 0, True), (1, 1, 0, True), (2, 1, 1, False)])):
        for i in range(2):
            spark.createDataFrame(rows[2 * i : 2 * i + 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{k}/in{i}")
        scans = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{k}/in*")
        alerts = rescan_alerts(scans if k == "marked" else scans.drop("truncated"))
        alerts.writeStream.format("memory").queryName(f"alerts_{k}").outputMode("append").option("checkpointLocation", f"{tmp_path}/{k}/cp").trigger(availableNow=True).start().awaitTermination()
        got = spark.table(f"alerts_{k}").orderBy("scan_id").collect()
        assert [(r["scan_id"] - 1, *r[2:]) for r in got] == want


def test_deep_wrappers_are_quick(spark):
    import time

    from wardlume.sources.html import page_nodes

    began = time.time()
    assert len(page_nodes(1, "<div>" * 4000 + "<p>x</p>")) == 2
    assert time.time() - began < 2


def test_purposes():
    def field(**a):
        return purpose(Element("input", a, None))

    assert [field(name=n) for n in ("email_address", "phoneNumber", "zipcode", "favourite_colour", "friend_email")] == ["email", "tel", "postal-code", None, None]
    assert field(name="password", type="password") is None


def test_colors(spark):
    rows = [("000000", "FFFFFF", 12.0, False), ("FFFFFF", "FFFFFF", 12.0, False), ("777777", "FFFFFF", 12.0, False), ("777777", "FFFFFF", 18.0, False), ("nope", "FFFFFF", 12.0, False)]
    df = spark.createDataFrame(rows, "fg string, bg string, pt double, b boolean")
    got = [tuple(r) for r in df.select(F.round(color.contrast(F.col("fg"), F.col("bg")), 2), color.required(F.col("pt"), F.col("b")).cast("double"), color.low_contrast(F.col("fg"), F.col("bg"), F.col("pt"), F.col("b"))).collect()]
    assert got == [(21.0, 4.5, False), (1.0, 4.5, True), (4.48, 4.5, False), (4.48, 3.0, False), (None, 4.5, False)]
    new = df.select(color.nearest_passing(F.col("fg"), F.col("bg"), F.lit(4.5)).alias("n")).collect()
    assert [r["n"] is not None for r in new] == [False, True, True, True, False]
    css = spark.createDataFrame([("#abc",), ("rgb(1, 2,3)",), ("navy",), ("rgba(1,2,3,0.5)",), ("nonsense",)], "c string").select(color.css_hex(F.col("c")).alias("h")).collect()
    assert [r["h"] for r in css] == ["AABBCC", "010203", "000080", None, None]


def test_text_judgements(spark):
    df = spark.createDataFrame([("IMG_1234",), ("photo.png",), ("Red car",), ("image 3",), ("1024x768",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.alt_is_nondescriptive(F.col("t"))).collect()] == [True, True, False, True, True, False, False]
    links = spark.createDataFrame([("",), ("#top",), ("http://",), ("https:///x",), ("mailto:a@b",), ("/rel",), ("ftp://x",)], "t string")
    assert [r[0] for r in links.select(text.invalid_link_reason(F.col("t"))).collect()] == ["missing_target", "", "placeholder_target", "missing_host", "", "", "unsupported_scheme"]


def test_status_and_scores(spark):
    row = spark.createDataFrame([("running", True, False, 0, 0, 0, 0, ""), ("done", True, True, 0, 0, 0, 0, "pass"), ("done", True, True, 0, 0, 0, 2, ""), (None, False, False, 0, 0, 0, 0, "")],
                                "latest_job_status string, has_jobs boolean, has_fix_report boolean, remaining int, introduced int, critical_remaining int, pending_manual int, preferred_score_status string")
    assert [r[0] for r in row.select(scoring.document_status()["status"]).collect()] == ["in_progress", "fixed", "needs_review", "not_run"]
    docs, found = spark.createDataFrame([(1,), (2,)], "doc_id long"), spark.createDataFrame([(1, "error"), (1, "warning"), (1, "warning")], "doc_id long, severity string")
    assert {r["doc_id"]: (r["score"], r["grade"]) for r in scoring.scan_scores(docs, found).collect()} == {1: (89.0, "B"), 2: (100.0, "A+")}


def test_plan_policies(spark):
    _, found = audit(spark, DIRTY)
    default = {r["rule_id"]: r["best_action"] for r in planner.plans(found).collect()}
    assert default["HEADING_LEVEL_JUMP"] is None and default["LINK_TEXT_NON_DESCRIPTIVE"] == "IMPROVE_LINK_TEXT"
    assert {r["rule_id"]: r["best_action"] for r in planner.plans(found, planner.PERMISSIVE).collect()}["HEADING_LEVEL_JUMP"] == "NORMALIZE_HEADING_LEVEL"


def test_metrics_fixture(spark):
    rows = [(10, 6, 4, 80, "docx", "B"), (4, 4, 0, 90, "pdf", "A")]
    df = spark.createDataFrame(rows, "initial_issues int, fixed_automatically int, pending_manual int, score int, source_format string, grade string")
    assert tuple(dashboards.totals(df).first()) == (2, 14, 10, 4, 85, 71)


def test_fixes(spark):
    nodes, _ = audit(spark, DIRTY)
    assert {r["level"] for r in executors.normalized_heading_levels(nodes).collect()} == {2}
    assert executors.document_titles(nodes).first()["title"] == "Top"
    assert executors.contrast_fixes(nodes).count() == 1
    assert executors.table_headers(nodes).first()["mode"] == "promote_first_row"


def test_layout(spark):
    items = spark.createDataFrame([(1, "a", 0, 0.0), (1, "a", 1, 20.0), (1, "a", 2, 40.0), (1, "a", 3, 20.0), (1, "a", 4, 0.0)], "doc_id long, list_id string, pos int, x0 double")
    assert [r["nesting"] for r in layout.nested_levels(items).orderBy("pos").collect()] == [0, 1, 2, 1, 0]
    p = spark.createDataFrame([(1, 0, "- a"), (1, 1, "- b"), (1, 2, "text"), (1, 3, "1. x"), (1, 4, "2. y"), (1, 5, "3. z"), (1, 6, "- lone")], "doc_id long, pos int, text string")
    assert sorted((r["kind"], r["items"]) for r in layout.fake_list_runs(p).collect()) == [("bullet", 2), ("decimal", 3)]


def test_history(spark):
    rows = [(1, "u", i, i, ["a", "b"] if i < 25 else ["b", "c"], "1", False, 80) for i in range(26)]
    df = spark.createDataFrame(rows, "user_id long, url_key string, id long, created_at long, fingerprints array<string>, version string, truncated boolean, score int")
    assert findings.retained(df, ["user_id", "url_key"], [F.desc("created_at")]).count() == 20
    last = findings.scan_changes(df).filter("id = 25").first()
    assert (last["new_count"], last["resolved_count"], last["unchanged_count"]) == (1, 1, 1)


def test_ledger(spark):
    rows = [(1, 1, 1, "purchase", 10, "p1"), (1, 2, 2, "purchase", 10, "p1"), (1, 3, 3, "spend", -7, None), (1, 4, 4, "spend", -7, None), (1, 5, 5, "reversal", -10, None)]
    got = ledger.balances(spark.createDataFrame(rows, "user_id long, id long, at long, kind string, amount long, ref string")).orderBy("id").collect()
    assert [r["balance"] for r in got] == [10, 10, 3, 3, 0] and got[-1]["shortfall"] == 7


def test_streaming_rate_limit_equals_batch(spark, tmp_path):
    from wardlume.streaming.jobs import rate_limit

    rows = [("a", i, float(i)) for i in range(10)] + [("b", 100 + i, 0.5 * i) for i in range(5)]
    spark.createDataFrame(rows, "key string, event_id long, at double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, event_id long, at double").parquet(str(tmp_path / "in"))
    q = rate_limit(stream, most=3, seconds=4.0).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["event_id"]: r["allowed"] for r in spark.table("limited").collect()}
    batch = ledger.rate_limited(spark.createDataFrame(rows, "key string, event_id long, at double").withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))), "key", "ts", 3, 4.0)
    assert got == {r["event_id"]: r["allowed"] for r in batch.collect()}


def test_streaming_state_ends(spark, tmp_path):
    import time

    from wardlume.streaming.jobs import failure_window

    schema = "key string, event_id long, at double, failed boolean"
    spark.createDataFrame([("a", i, float(i), True) for i in range(4)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = failure_window(events, most=2, seconds=60.0, idle=1).writeStream.format("memory").queryName("windows").outputMode("append").trigger(processingTime="1 second").start()
    left = None
    for _ in range(120):
        time.sleep(0.5)
        states = [o["numRowsTotal"] for o in (q.lastProgress or {}).get("stateOperators", [])]
        left = states[0] if states else left
        if left == 0 and spark.table("windows").count() == 4:
            break
    q.stop()
    assert left == 0 and [r["blocked"] for r in spark.table("windows").orderBy("event_id").collect()] == [False, False, True, True]
