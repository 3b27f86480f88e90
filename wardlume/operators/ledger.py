"""Logs and ledgers: filters, retention, latest rows, trailing windows, running balances."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed


def audit_list(log: DataFrame, email: str | None = None, exact: bool = False, event: str | None = None, since: Column | None = None, until: Column | None = None, limit: int = 200) -> DataFrame:
    """Newest entries that hold all filters; an email matches in part unless exact, in any case; limit from 1 to 2000."""
    x = log
    if email is not None:
        who = F.lower(F.coalesce("actor_email", F.lit("")))
        x = x.filter(who == email.lower()) if exact else x.filter(F.contains(who, F.lit(email.lower())))
    if event is not None:
        x = x.filter(F.col("event") == event)
    if since is not None:
        x = x.filter(F.col("at") > since)
    if until is not None:
        x = x.filter(F.col("at") < until)
    return x.orderBy(F.desc("at"), F.desc("id")).limit(max(1, min(2000, limit)))


def accepted_events(log: DataFrame) -> DataFrame:
    return log.filter(F.col("event").isin(*fixed.AUDIT_EVENTS))


def purged(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    """What a purge of entries older than ``days`` (one at least) keeps."""
    return log.filter(F.col("at") >= as_of - F.make_interval(days=F.lit(max(1, days))))


def pending_reviews(items: DataFrame, owner: Column) -> DataFrame:
    return items.filter((F.col("status") == "pending") & (F.col("owner_id").isNull() | (F.col("owner_id") == owner)))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def active_subscriptions(subscriptions: DataFrame) -> DataFrame:
    return latest(subscriptions.filter("status = 'active'"), ["user_id"], [F.desc("created_at"), F.desc("id")])


def wallets(users: DataFrame, members: DataFrame, teams: DataFrame) -> DataFrame:
    """(user_id, wallet_id): the team owner's wallet for members, else one's own."""
    m = members.join(teams, "team_id").select("user_id", "owner_id")
    return users.select("user_id").join(m, "user_id", "left").select("user_id", F.coalesce("owner_id", "user_id").alias("wallet_id"))


def roster(members: DataFrame, users: DataFrame) -> DataFrame:
    return members.join(users, "user_id", "left").orderBy("team_id", F.when(F.col("role") == "owner", 0).otherwise(1), "email")


def seats_used(members: DataFrame, invites: DataFrame, as_of: Column) -> DataFrame:
    """Members and invites that are pending and younger than seven days, by team."""
    open_ = invites.filter((F.col("status") == "pending") & (F.col("created_at") > as_of - F.expr("interval 7 days"))).groupBy("team_id").agg(F.count("*").alias("invited"))
    return members.groupBy("team_id").agg(F.count("*").alias("members")).join(open_, "team_id", "full").fillna(0, ["members", "invited"]).withColumn("seats", F.col("members") + F.col("invited"))


def recent_jobs(jobs: DataFrame, documents: DataFrame, owner: Column, limit: int = 20) -> DataFrame:
    mine = documents.filter(F.col("owner_id") == owner).select("doc_id")
    return jobs.join(mine, "doc_id", "left_semi").orderBy(F.desc("started_at"), F.desc("id")).limit(max(1, min(100, limit)))


def documents_page(documents: DataFrame, owner: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    x = documents if owner is None else documents.filter(F.col("owner_id") == owner)
    return x.orderBy(F.desc("created_at"), "doc_id").offset(offset).limit(limit)


def trailing(rows: DataFrame, keys: list[str], at: str, hours: int, cap: int) -> DataFrame:
    """Each row with how many of its key came in the ``hours`` before it, and whether that is below the cap."""
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-hours * 3_600_000_000, 0)
    return rows.withColumn("in_window", F.count("*").over(w) - 1).withColumn("allowed", F.col("in_window") < cap)


def folded(rows: DataFrame, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], schema: str) -> DataFrame:
    """A fold over each key's rows (key first, then the columns of order) that carries only its state from batch to batch.

    ``step`` changes the state and returns a row of the schema. Spark deals rows by key and sorts them, spilling if need be; a key with a
    large share of all rows takes one task long, but no more memory than a batch.
    """
    key = rows.columns[0]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                now = None if pd.isna(r[0]) else r[0]
                if now != at:
                    at, state = now, start()
                out.append(step(state, r))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def balances(ledger: DataFrame) -> DataFrame:
    """Replay of a signed ledger in order: debits that the balance does not cover are refused, a key is spent or granted once, a
    reversal takes back what is there and reports the shortfall. A fold over one wallet's entries."""
    once = F.col("kind").isin("spend_once", "grant_once", "purchase") & (F.coalesce("ref", F.lit("")) != "")
    nth = F.row_number().over(Window.partitionBy("user_id", "kind", "ref").orderBy("at", "id"))

    def step(wallet: dict, r: tuple) -> tuple:
        amount, applied, short = int(r.amount), 0, 0
        if r.kind == "reversal":
            applied = -min(wallet["balance"], -amount)
            short = -amount + applied
        elif not r.again and (amount >= 0 or wallet["balance"] + amount >= 0):
            applied = amount
        wallet["balance"] += applied
        return r.user_id, r.id, applied, short, wallet["balance"]

    x = ledger.select("user_id", "id", "at", "kind", "amount", (once & (nth > 1)).alias("again"))
    return folded(x, ["at", "id"], lambda: {"balance": 0}, step, "user_id long, id long, applied long, shortfall long, balance long")


def rate_limited(events: DataFrame, key: str, at: str, most: int = 60, seconds: float = 60.0) -> DataFrame:
    """Each request with whether it was let through: ``most`` in any ``seconds``; a request that is refused does not count."""
    kind = events.schema[key].dataType.simpleString()

    def step(window: deque, r: tuple) -> tuple:
        while window and window[0] <= r.s - seconds:
            window.popleft()
        ok = len(window) < most
        if ok:
            window.append(r.s)
        return r.k, r.i, ok

    x = events.select(F.col(key).alias("k"), F.col("event_id").alias("i"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("s"))
    return folded(x, ["s", "i"], deque, step, f"k {kind}, i long, allowed boolean").withColumnsRenamed({"k": key, "i": "event_id"})


def monitors_due(sites: DataFrame, as_of: Column, stale_seconds: int = 900, most_failures: int = 5) -> DataFrame:
    """Sites to scan now: enabled, due, not claimed by a live worker, not failed too often."""
    free = F.col("claimed_at").isNull() | (F.col("claimed_at") < as_of - F.make_interval(secs=F.lit(stale_seconds)))
    return sites.filter(F.col("enabled") & (F.col("next_run_at") <= as_of) & free & (F.col("consecutive_failures") < most_failures))


def released_monitors(runs: DataFrame, as_of: Column, most_failures: int = 5) -> DataFrame:
    """Sites after a run (site columns, failed, issues): the next run by frequency, the claim dropped, off after too many failures in a row."""
    days = F.when(F.col("frequency") == "daily", 1).otherwise(7)
    failures = F.when(F.col("failed"), F.coalesce("consecutive_failures", F.lit(0)) + 1).otherwise(0)
    return runs.withColumns({"next_run_at": as_of + F.make_dt_interval(days), "claimed_at": F.lit(None).cast("timestamp"), "consecutive_failures": failures,
                             "enabled": F.col("enabled") & (failures < most_failures), "last_issue_count": F.coalesce("issues", "last_issue_count")})


def alerts(changes: DataFrame) -> DataFrame:
    """Scans worth a message: those with new issues."""
    return changes.filter("new_count > 0")


def expired(artefacts: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """What a sweep of files older than ``hours`` takes away."""
    return artefacts.filter(F.col("created_at") < as_of - F.make_dt_interval(hours=F.lit(hours)))


def token_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of model calls by price per million tokens; unknown models take the price named unknown."""
    p = F.broadcast(prices)
    fallback = prices.filter("model = 'unknown'").select(F.col("input").alias("fi"), F.col("output").alias("fo"))
    x = calls.join(p, "model", "left").join(F.broadcast(fallback.withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k"), "left")
    return x.withColumn("cost", F.col("input_tokens") / 1e6 * F.coalesce("input", "fi") + F.col("output_tokens") / 1e6 * F.coalesce("output", "fo")).drop("fi", "fo", "_k", "input", "output")
