"""Identity of findings: signatures, fingerprints, diffs between scans, history, deltas, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_FINGERPRINTS, MOST_SCANS = 400, 20
KIND_NAMES = {"document": "DocumentNode", "section": "SectionNode", "heading": "HeadingNode", "paragraph": "ParagraphNode", "list": "ListNode", "list_item": "ListItemNode", "table": "TableNode",
              "table_row": "TableRowNode", "table_cell": "TableCellNode", "image": "ImageNode", "link": "LinkNode", "artifact": "ArtifactNode"}


def _short(c: Column, limit: int) -> Column:
    return F.substring(F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " ")), 1, limit)


def signatures(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, signature): what a node is recognised by after other parts of its page have changed.

    A link's target and text; else its text; else up to six short texts of its children and theirs; else its kind.
    """
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_NAMES.items() for x in kv]), "node_type")
    own = nodes.select("doc_id", "node_id", "parent_id", "sibling_pos", kind.alias("kind"), _short(F.col("text"), 80).alias("t"), _short(F.col("target"), 200).alias("to"), _short(F.col("text"), 24).alias("bit"))
    child = own.filter("parent_id is not null and sibling_pos < 6")
    grand = own.filter("sibling_pos < 4").select("doc_id", F.col("parent_id").alias("up"), F.col("sibling_pos").alias("g"), F.col("bit").alias("gbit"))
    bits = child.select("doc_id", F.col("parent_id").alias("node_id"), F.col("sibling_pos").alias("c"), F.lit(-1).alias("g"), "bit").union(
        child.join(grand, (child.doc_id == grand.doc_id) & (child.node_id == grand.up)).select(child.doc_id, child.parent_id, child.sibling_pos, "g", "gbit"))
    below = bits.filter("bit <> ''").groupBy("doc_id", "node_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "g", "bit"))), 1, 6).alias("bits"))
    joined = F.array_join(F.transform("bits", lambda x: x["bit"]), ",")
    return own.join(below, ["doc_id", "node_id"], "left").select("doc_id", "node_id", (
        F.when(F.col("to") != "", F.concat_ws("|", "kind", "to", "t")).when(F.col("t") != "", F.concat_ws("|", "kind", "t"))
        .when(F.col("bits").isNotNull(), F.concat_ws("|", F.col("kind"), joined)).otherwise(F.concat("kind", F.lit("|")))).alias("signature"))


def fingerprints(findings: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, violation_id, fingerprint): stable under changes elsewhere; equal findings are told apart by their order.

    All findings, in breadth-first order. With ``most`` (MOST_FINGERPRINTS for a row of the stored
    history) only that many of each document, and ``truncated``: the document has more.
    """
    ranked = findings.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("bfs_pos", "rule_id")))
    cut = []
    if most is not None:
        ranked = ranked.withColumn("truncated", F.count("*").over(Window.partitionBy("doc_id")) > most).filter(F.col("n") <= most)
        cut = ["truncated"]
    base = ranked.join(signatures(nodes), ["doc_id", "node_id"]).withColumn("base", F.concat_ws("|", "rule_id", "signature"))
    index = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("n")) - 1
    return base.select("doc_id", "violation_id", F.substring(F.sha1(F.concat(F.col("base"), F.lit("#"), index.cast("string")).cast("binary")), 1, 16).alias("fingerprint"), *cut)


def fingerprint_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per key: fingerprints that are new, resolved and unchanged between two scans (key, fingerprint).

    If a scan has the column ``truncated``, the result has ``partial``: one of the key's scans was cut off, and nothing counts as resolved.
    """
    a, b = before.select(key, "fingerprint").distinct().withColumn("old", F.lit(True)), after.select(key, "fingerprint").distinct().withColumn("now", F.lit(True))
    both = a.join(b, [key, "fingerprint"], "full")
    out = both.groupBy(key).agg(F.count_if(F.col("old").isNull()).alias("new_count"), F.count_if(F.col("now").isNull()).alias("resolved_count"),
                                F.count_if(F.col("old") & F.col("now")).alias("unchanged_count"))
    cuts = [x.filter("truncated").select(key) for x in (before, after) if "truncated" in x.columns]
    if not cuts:
        return out
    cut = cuts[0].union(cuts[-1]).distinct().withColumn("partial", F.lit(True))
    return out.join(cut, key, "left").withColumns({
        "partial": F.coalesce("partial", F.lit(False)), "resolved_count": F.when(F.col("partial"), 0).otherwise(F.col("resolved_count")).cast("long")})


def scan_changes(history: DataFrame) -> DataFrame:
    """Each scan against the one before of its (user_id, url_key); none across versions; where one of the two was cut off, nothing counts as resolved and it is partial."""
    order = Window.partitionBy("user_id", "url_key").orderBy("created_at", "id")
    prior = {f"p_{c}": F.lag(c).over(order) for c in ("fingerprints", "version", "truncated", "score")}
    x = history.withColumns(prior).filter((F.col("p_version") == F.col("version")))
    partial = F.coalesce("p_truncated", F.lit(False)) | F.coalesce("truncated", F.lit(False))
    return x.select("user_id", "url_key", "id", F.size(F.array_except("fingerprints", "p_fingerprints")).alias("new_count"),
                    F.when(partial, 0).otherwise(F.size(F.array_except("p_fingerprints", "fingerprints"))).alias("resolved_count"),
                    F.size(F.array_intersect("fingerprints", "p_fingerprints")).alias("unchanged_count"), (F.col("score") - F.col("p_score")).alias("score_change"), partial.alias("partial"))


def retained(rows: DataFrame, keys: list[str], order: list[Column], most: int = MOST_SCANS) -> DataFrame:
    """The first ``most`` rows of each key in the order given."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def issue_key(rule: Column, severity: Column, nodes: Column, pages: Column, location: Column, title: Column) -> Column:
    """Identity of a stored issue: rule, severity, ten sorted nodes, distinct pages by number, place and title."""

    def plain(c: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))

    some = F.array_join(F.array_sort(F.slice(F.coalesce(nodes, F.array().cast("array<string>")), 1, 10)), ",")
    leaves = F.array_join(F.array_sort(F.array_distinct(F.coalesce(pages, F.array().cast("array<int>")))), ",")
    return F.concat(F.lit("rule:"), plain(rule), F.lit("|sev:"), plain(severity), F.lit("|nodes:"), some, F.lit("|pages:"), leaves, F.lit("|loc:"), plain(location), F.lit("|title:"), plain(title))


def issue_delta(before: DataFrame, after: DataFrame, key: str = "issue_key", doc: str = "doc_id") -> DataFrame:
    """(doc, key, state): fixed, remaining or introduced."""
    return before.select(doc, key).distinct().withColumn("b", F.lit(1)).join(after.select(doc, key).distinct().withColumn("a", F.lit(1)), [doc, key], "full").select(
        doc, key, F.when(F.col("a").isNull(), "fixed").when(F.col("b").isNull(), "introduced").otherwise("remaining").alias("state"))


def delta_with_fallback(before: DataFrame, after: DataFrame, scanned: DataFrame, doc: str = "doc_id") -> DataFrame:
    """As issue_delta, but a document without issues after that was never scanned again keeps all its issues (note set)."""
    d = issue_delta(before, after, doc=doc).join(scanned.select(doc).distinct().withColumn("s", F.lit(True)), doc, "left")
    lost = (F.col("state") == "fixed") & F.col("s").isNull()
    return d.select(doc, "issue_key", F.when(lost, "remaining").otherwise(F.col("state")).alias("state"), F.when(lost, "no scan after the fix").alias("note"))


def bundle_signature(issue_id: Column, rule: Column, severity: Column, location: Column, snippet: Column) -> Column:
    """A bundle's identity of an issue: its id, or a digest of what it says."""
    made = F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (rule, severity, location)], F.substring(F.coalesce(snippet, F.lit("")), 1, 200)), 256)
    return F.when(F.coalesce(issue_id, F.lit("")) != "", issue_id).otherwise(made)


def check_rows(fixed: DataFrame, remaining: DataFrame, introduced: DataFrame, manual: DataFrame) -> DataFrame:
    """Rows of the checks report (rule_id, location, status) in its order: worst first, then rule, place and status."""
    x = None
    for status, part in (("fixed", fixed), ("open", remaining), ("introduced", introduced)):
        p = part.select("rule_id", "severity", "location", F.lit(status).alias("status"))
        x = p if x is None else x.unionByName(p)
    x = x.unionByName(manual.select("rule_id", "severity", "location", F.concat(F.lit("manual_"), F.col("status")).alias("status")))
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity").isin("serious", "error"), 1).when(F.col("severity").isin("moderate", "warning"), 2).otherwise(3)
    return x.withColumn("severity_rank", rank).orderBy("severity_rank", "rule_id", "location", "status")


def by_rule(findings: DataFrame) -> DataFrame:
    """Findings by rule: how many, in how many documents, where first seen."""
    return findings.groupBy("rule_id", "severity").agg(F.count("*").alias("total"), F.count_distinct("doc_id").alias("docs"), F.min(F.struct("doc_id", "bfs_pos")).alias("first"),
                                                      F.min_by(F.col("node_id"), F.struct("doc_id", "bfs_pos")).alias("first_node"))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("total"))


def latest_phase(issues: DataFrame) -> DataFrame:
    """Issues of the phase after where a document has any, else of the phase before."""
    after = issues.filter("phase = 'after'")
    return after.unionByName(issues.filter("phase = 'before'").join(after.select("doc_id").distinct(), "doc_id", "left_anti"))


def line_changes(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """(key, change, line, n): lines of a text that went or came, as often as they did, wherever they stand (``text_diff`` has their places)."""

    def lines(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line")).groupBy(key, "line").agg(F.count("*").alias(name))

    both = lines(before, "b").join(lines(after, "a"), [key, "line"], "full").withColumn("n", F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))
    return both.filter("n <> 0").select(key, F.when(F.col("n") > 0, "+").otherwise("-").alias("change"), "line", F.abs("n").alias("n"))
