"""Aggregations behind reports: totals, rollups, time buckets, streaks, heatmaps, readability, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import language
from ..functions.language import js_round

WEEKS = 12
#: Parts that a team's viewers are dealt into.
VIEWER_SLICES = 16


def totals(results: DataFrame) -> DataFrame:
    """Documents, issues found, fixed and pending, mean score and share fixed, whole numbers with halves to even."""
    found, fixed = F.coalesce(F.sum("initial_issues"), F.lit(0)), F.coalesce(F.sum("fixed_automatically"), F.lit(0))
    return results.agg(F.count("*").alias("documents"), found.alias("found"), fixed.alias("fixed"), F.coalesce(F.sum("pending_manual"), F.lit(0)).alias("pending"),
                       F.coalesce(F.bround(F.avg("score"), 0), F.lit(0)).cast("long").alias("average_score"), F.when(found == 0, 0).otherwise(F.bround(100 * fixed / found, 0)).cast("long").alias("percent_fixed"))


def by_format(results: DataFrame) -> DataFrame:
    name = F.lower(F.coalesce("source_format", F.lit("")))
    return results.groupBy(F.when(name == "", "other").otherwise(name).alias("format")).agg(F.count("*").alias("documents"), F.sum("initial_issues").alias("found")).orderBy(F.desc("documents"), "format")


def by_grade(results: DataFrame) -> DataFrame:
    """Documents by grade, A to F and then all others: A+ has no place in this order."""
    name = F.upper(F.coalesce("grade", F.lit("")))
    rank = F.coalesce(F.nullif(F.instr(F.lit("ABCDF"), F.col("grade")), F.lit(0)), F.lit(99))
    x = results.groupBy(F.when(name == "", "?").otherwise(name).alias("grade")).agg(F.count("*").alias("documents"))
    return x.withColumn("rank", F.when(F.length("grade") == 1, rank).otherwise(99)).orderBy("rank", "grade")


def weekly(rows: DataFrame, at: str, as_of: Column, weeks: int = WEEKS, **sums: Column) -> DataFrame:
    """Counts (and sums) of the last ``weeks`` weeks from Monday, empty weeks too, older rows left out; as_of is a date literal."""
    last = F.to_date(F.date_trunc("week", as_of))
    spark = rows.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, 7 * (weeks - 1)), last, F.expr("interval 7 days"))).alias("week"))
    counts = rows.groupBy(F.to_date(F.date_trunc("week", F.col(at))).alias("week")).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    return spine.join(counts, "week", "left").fillna(0, ["n", *sums])


def recent(rows: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def team_scope(members: DataFrame, teams: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, sees): oneself, or all of one's team and its owner.

    There are as many pairs as the squares of the teams' sizes, so they are neither shuffled nor held: slices of a team's viewers, each of which meets
    the whole team in one task, come out as they are. Repeats are looked for only where they can be, among viewers with several teams.
    """
    of = lambda user: members.select("team_id", F.col("user_id").alias(user)).union(teams.select("team_id", F.col("owner_id").alias(user))).filter("team_id is not null").distinct()
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = of("user_id").withColumns({"several": F.count("*").over(Window.partitionBy("user_id")) > 1, "slice": F.pmod(F.hash("user_id"), F.lit(VIEWER_SLICES))})
    whole = of("sees").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(VIEWER_SLICES - 1))))
    # small tables with many pairs: a number of partitions that is asked for stays as it is
    pairs = own.repartition(n, "team_id", "slice").join(whole.repartition(n, "team_id", "slice"), ["team_id", "slice"])
    alone, shared = pairs.filter("not several").select("user_id", "sees"), pairs.filter("several").select("user_id", "sees").distinct()
    # whoever has a team is among those seen there
    viewers = of("viewer").select("viewer").distinct()
    rest = users.select("user_id").distinct().join(viewers, F.col("user_id").eqNullSafe(F.col("viewer")), "left_anti").select("user_id", F.col("user_id").alias("sees"))
    return alone.union(shared).union(rest)


def user_totals(users: DataFrame, as_of: Column) -> DataFrame:
    return users.agg(F.count("*").alias("users"), F.count_if("verified").alias("verified"), F.count_if(F.col("created_at") >= as_of - F.expr("interval 30 days")).alias("new_30d"))


def revenue(subscriptions: DataFrame, prices: DataFrame) -> DataFrame:
    return subscriptions.filter("status = 'active'").groupBy("plan").agg(F.count("*").alias("active")).join(F.broadcast(prices), "plan", "left").withColumn("monthly", F.col("active") * F.coalesce("price", F.lit(0)))


def credit_totals(ledger: DataFrame) -> DataFrame:
    """Credits granted, spent and outstanding of signed amounts."""
    plus, minus = F.coalesce(F.sum(F.when(F.col("amount") > 0, F.col("amount"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("amount") < 0, -F.col("amount"))), F.lit(0))
    return ledger.agg(plus.alias("granted"), minus.alias("spent"), (plus - minus).alias("outstanding"))


def certificate_totals(certificates: DataFrame, as_of: Column) -> DataFrame:
    x = certificates.agg(F.count("*").alias("total"), F.count_if(F.col("issued_at") >= as_of - F.expr("interval 30 days")).alias("last_30d"),
                         *[F.count_if(F.col("paid_with") == p).alias(f"by_{p}") for p in ("credits", "subscription", "card")])
    return x


def site_rollup(findings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rules over a site: how often and on how many pages; errors first, then the most frequent."""
    x = findings.groupBy("rule_id", "severity").agg(F.count("*").alias("total"), F.count_distinct(doc).alias("pages"))
    return x.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), F.desc("total"), "rule_id")


def site_score(page_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the pages' rounded scores."""
    return page_scores.groupBy(*keys).agg(F.bround(F.avg("score"), 2).alias("site_score"), F.count("*").alias("pages"), F.sum("issues").alias("issues"))


def page_summary(nodes: DataFrame) -> DataFrame:
    kinds = ("heading", "link", "list", "list_item", "image", "table")
    return nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), *[F.count_if(F.col("node_type") == k).alias(f"n_{k}") for k in kinds])


def manual_summary(items: DataFrame) -> DataFrame:
    known = F.when(F.col("status").isin("pending", "approved", "rejected"), F.col("status")).otherwise("other")
    return items.groupBy(known.alias("status")).agg(F.count("*").alias("items"))


def longest_streaks(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Most consecutive days with a row, of each key."""
    days = rows.select(*keys, F.to_date(at).alias("day")).distinct()
    run = F.date_sub("day", F.row_number().over(Window.partitionBy(*keys).orderBy("day")))
    return days.withColumn("run", run).groupBy(*keys, "run").agg(F.count("*").alias("length")).groupBy(*keys).agg(F.max("length").alias("longest_streak"), F.sum("length").alias("active_days"))


def heatmap(rows: DataFrame, at: str, last: Column, days: int = 35) -> DataFrame:
    """A count for each of the last ``days`` days, zero where nothing happened, with week and weekday."""
    spine = rows.sparkSession.range(1).select(F.posexplode(F.sequence(F.date_sub(last, days - 1), last)).alias("i", "day"))
    counts = rows.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").select("day", F.floor(F.col("i") / 7).cast("int").alias("week"), F.weekday("day").alias("weekday"), F.coalesce("n", F.lit(0)).alias("n"))


def top_rules(audits: DataFrame, latest: int = 20, n: int = 5) -> DataFrame:
    """The commonest rules of the latest audits; an audit without rules counts for its format."""
    last = audits.orderBy(F.desc("ran_at"), "id").limit(latest)
    named = F.when(F.size("rules") > 0, F.col("rules")).otherwise(F.array(F.concat(F.upper("format"), F.lit(" (summary)"))))
    return last.select(F.explode(named).alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(n)


def dashboard(audits: DataFrame, as_of: Column, minutes_each: int = 12) -> DataFrame:
    week = F.col("ran_at") >= as_of - F.expr("interval 7 days")
    return audits.agg(F.count_if(week).alias("scans_this_week"), js_round(F.avg("score")).cast("long").alias("average_score"), (F.count("*") * minutes_each).alias("minutes_saved"))


def history(audits: DataFrame, most: int = 50) -> DataFrame:
    """The newest audits, one per id."""
    last = audits.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ran_at")))).filter("_n = 1").drop("_n")
    return last.orderBy(F.desc("ran_at"), "id").limit(most)


def savings(pages: Column, page_rate: Column, docs: Column, credits: Column, credit_price: Column) -> dict[str, Column]:
    manual, own = pages * page_rate, docs * credits * credit_price
    return {"manual_cost": manual, "own_cost": own, "saved": manual - own, "saved_percent": F.when(manual > 0, js_round(100 * (manual - own) / manual)).otherwise(0)}


def outline(pages: DataFrame, key: str, body: str) -> DataFrame:
    """Headings of HTML, or of Markdown where there is none: (key, pos, level, text, previous level)."""
    raw = F.expr(f"regexp_extract_all({body}, '(?is)<h([1-6])\\\\b[^>]*>.*?</h\\\\1>', 0)")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("raw"), "<[^>]+>", " "), "(?i)&nbsp;", " "), "(?i)&amp;", "&"), "(?i)&lt;", "<"), "(?i)&gt;", ">")
    html = pages.select(key, F.posexplode(raw).alias("pos", "raw")).select(key, "pos", F.regexp_extract("raw", "(?i)^<h([1-6])", 1).cast("int").alias("level"), F.trim(F.regexp_replace(plain, r"\s+", " ")).alias("text"))
    marks = pages.filter(F.size(raw) == 0).select(key, F.posexplode(F.split(F.col(body), r"\r?\n")).alias("pos", "line"))
    mark = r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$"
    md = marks.filter(F.col("line").rlike(mark)).select(key, "pos", F.length(F.regexp_extract("line", mark, 1)).alias("level"), F.trim(F.regexp_extract("line", mark, 2)).alias("text"))
    order = Window.partitionBy(key).orderBy("pos")
    return html.union(md).withColumns({"previous": F.lag("level").over(order), "pos": (F.row_number().over(order) - 1).cast("int")})


def outline_report(pages: DataFrame, key: str, body: str) -> DataFrame:
    """Per page: headings, level-one headings, empty ones, jumps, whether the first is level one, and whether all is well."""
    x = outline(pages, key, body).groupBy(key).agg(
        F.count("*").alias("headings"), F.count_if(F.col("level") == 1).alias("h1"), F.count_if(F.col("text") == "").alias("empty"), F.count_if(F.col("level") > F.col("previous") + 1).alias("jumps"),
        F.min_by("level", "pos").alias("first_level"))
    y = pages.select(key).join(x, key, "left").fillna(0, ["headings", "h1", "empty", "jumps", "first_level"])
    return y.withColumn("ok", (F.col("headings") > 0) & (F.col("h1") == 1) & (F.col("first_level") == 1) & (F.col("empty") == 0) & (F.col("jumps") == 0))


def readability(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Words, sentences, syllables, complex words, reading ease, grade and band of every text that has words.

    Words are exploded so that syllables are counted by ordinary expressions; one shuffle by document adds them up.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    word = docs.select(key, F.explode(F.split(body, r"[ \t\n\x0B\f\r]+")).alias("w")).filter(F.col("w").rlike("(?i)[a-z0-9]")).select(key, language.syllables(F.col("w")).alias("s"))
    words = word.groupBy(key).agg(F.count("*").alias("words"), F.sum("s").cast("long").alias("syllables"), F.count_if(F.col("s") >= 3).alias("complex_words"))
    sentences = docs.select(key, F.greatest(F.lit(1), F.size(F.filter(F.split(body, "[.!?]+"), lambda s: s.rlike("(?i)[a-z0-9]")))).cast("long").alias("sentences"))
    x = words.join(sentences, key)
    per_sentence, per_word = F.col("words") / F.col("sentences"), F.col("syllables") / F.col("words")
    ease = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * per_sentence - 84.6 * per_word))
    grade = F.greatest(F.lit(0.0), 0.39 * per_sentence + 11.8 * per_word - 15.59)
    return x.select(key, "words", "sentences", "syllables", "complex_words", js_round(ease, 1).alias("reading_ease"), js_round(grade, 1).alias("grade_level"), language.ease_band(ease).alias("band"))


def long_sentences(docs: DataFrame, key: str, text: str, over: int = 25, most: int = 5) -> DataFrame:
    """A text's longest sentences of more than ``over`` words: (key, sentence number, words)."""
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[.!?]+"), lambda s: s.rlike("(?i)[a-z0-9]"))
    n = F.size(F.filter(F.split("s", r"[ \t\n\x0B\f\r]+"), lambda w: w.rlike("(?i)[a-z0-9]")))
    x = docs.select(key, F.posexplode(parts).alias("i", "s")).select(key, (F.col("i") + 1).alias("sentence"), n.alias("words")).filter(F.col("words") > over)
    return x.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("words"), "sentence"))).filter(F.col("_n") <= most).drop("_n")


def palette(colors: DataFrame, key: str = "color") -> DataFrame:
    """Contrast of every ordered pair of a palette's distinct colours: a palette is a handful of colours, given by a person."""
    from ..functions import color

    c = colors.select(color.hex6(F.col(key)).alias("hex")).filter("hex is not null").distinct()
    pairs = c.select(F.col("hex").alias("fg"), F.lit(1).alias("k")).join(c.select(F.col("hex").alias("bg"), F.lit(1).alias("k")), "k").filter("fg <> bg")
    ratio = color.contrast(F.col("fg"), F.col("bg"))
    return pairs.select("fg", "bg", js_round(ratio, 2).alias("ratio"), (ratio >= 4.5).alias("aa"), (ratio >= 3).alias("aa_large"), (ratio >= 7).alias("aaa"), (ratio >= 4.5).alias("aaa_large"))


def document_overview(documents: DataFrame, jobs: DataFrame, reports: DataFrame, manual: DataFrame, issues: DataFrame, scores: DataFrame) -> DataFrame:
    """The document list: latest job, fix report counts, manual items by status, issues by phase and severity, preferred score, status."""
    from . import scoring

    job = jobs.groupBy("doc_id").agg(F.max_by(F.struct(F.col("id").alias("job_id"), "status"), F.struct("started_at", "id")).alias("job"))
    m = manual.groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(f"{s}_manual") for s in ("pending", "approved", "rejected")])
    i = issues.groupBy("doc_id").agg(*[F.count_if((F.col("phase") == p) & (scoring.severity_class(F.col("severity")) == s)).alias(f"{p}_{s}") for p in ("before", "after") for s in ("critical", "serious", "moderate", "minor")])
    best = scoring.preferred_scores(scores).select("job_id", F.col("preferred").alias("score"))
    x = documents.join(job, "doc_id", "left").join(reports.withColumn("has_fix_report", F.lit(True)), "doc_id", "left").join(m, "doc_id", "left").join(i, "doc_id", "left")
    x = x.withColumns({"job_id": F.col("job.job_id"), "latest_job_status": F.col("job.status"), "has_jobs": F.col("job").isNotNull(), "critical_remaining": F.col("after_critical")}).drop("job").join(best, "job_id", "left")
    x = x.withColumn("preferred_score_status", F.when(F.col("score") >= 90, "pass").when(F.col("score") >= 60, "needs_review").when(F.col("score").isNotNull(), "fail"))
    return x.withColumn("state", scoring.document_status()).select("*", "state.status", "state.reason").drop("state")
