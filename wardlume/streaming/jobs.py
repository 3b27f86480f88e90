"""Streaming twins of the polled loops: rate limiting, failure windows, and re-scan diffs with the last scan as state.

With ``idle``, a key that has had no event for so many seconds is forgotten, so state doesn't grow with every key ever seen: give it
for streams that run on, far beyond the job's own window, as events can arrive later than they happened. Spark keeps on running
batches to look for such keys, so runs that end by themselves (``availableNow``) go without it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _kept(state: GroupState, value: tuple, idle: int | None) -> None:
    state.update(value)
    if idle is not None:
        state.setTimeoutDuration(idle * 1000)


def _timeout(idle: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


def rate_limit(events: DataFrame, most: int = 60, seconds: float = 60.0, idle: int | None = None) -> DataFrame:
    """(key, event_id, allowed) of a stream of (key, event_id, at seconds): a request that is refused does not count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for at in rows["at"]:
            times = [t for t in times if t > at - seconds]
            ok = len(times) < most
            if ok:
                times.append(float(at))
            out.append(ok)
        _kept(state, (times,), idle)
        yield rows[["key", "event_id"]].assign(allowed=out)

    return events.groupBy("key").applyInPandasWithState(step, "key string, event_id long, allowed boolean", "times array<double>", "append", _timeout(idle))


def failure_window(events: DataFrame, most: int = 5, seconds: float = 900.0, idle: int | None = None) -> DataFrame:
    """(key, event_id, blocked) of a stream of (key, event_id, at, failed): blocked while ``most`` failures lie in the window; success clears them."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for at, failed in zip(rows["at"], rows["failed"], strict=True):
            times = [t for t in times if t > at - seconds]
            blocked = len(times) >= most
            out.append(blocked)
            if not blocked:
                times = [*times, float(at)] if failed else []
        _kept(state, (times,), idle)
        yield rows[["key", "event_id"]].assign(blocked=out)

    return events.groupBy("key").applyInPandasWithState(step, "key string, event_id long, blocked boolean", "times array<double>", "append", _timeout(idle))


def rescan_alerts(scans: DataFrame, idle: int | None = None) -> DataFrame:
    """(site, scan_id, new_count, resolved_count) of a stream of (site, scan_id, fingerprints): against the site's last scan.

    If the scans have ``truncated``, alerts have ``partial``: one of the two scans was cut off, and nothing counts as resolved.
    """
    marked = "truncated" in scans.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, cut = (set(json.loads(state.get[0])), marked and bool(state.get[1])) if state.exists else (None, False)
        out = []
        for r in pd.concat(list(batches)).sort_values("scan_id").itertuples():
            now, now_cut = set(r.fingerprints), marked and r.truncated is not None and bool(r.truncated)
            if last is not None:
                partial = cut or now_cut
                out.append((r.site, r.scan_id, len(now - last), 0 if partial else len(last - now), partial))
            last, cut = now, now_cut
        _kept(state, (json.dumps(sorted(last)), cut)[: 1 + marked], idle)
        made = pd.DataFrame(out, columns=["site", "scan_id", "new_count", "resolved_count", "partial"])
        yield made if marked else made.drop(columns="partial")

    rows = "site string, scan_id long, new_count long, resolved_count long" + (", partial boolean" if marked else "")
    return scans.groupBy("site").applyInPandasWithState(step, rows, "last string, cut boolean" if marked else "last string", "append", _timeout(idle))
