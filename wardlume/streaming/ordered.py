"""Folds over a stream in the order of event time, on ``transformWithState``: results don't depend on how events fall into micro-batches.

A key's events wait in list state until the watermark has passed them; then a timer folds them in order, as the batch operators do. Events behind the watermark are late
and dropped by Spark. One more timer, a fold's own ``keep`` behind its last event, clears the key's state, so state ends by itself while the stream goes on.

What waits for a key is what came within the watermark's delay; the folded state is what the fold keeps. Neither grows with the stream. The session needs the
RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). Events with a null key are one key; those without a time never come in order and are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Step = Callable[[dict, tuple], tuple | None]


class _Fold(StatefulProcessor):
    def __init__(self, start: Callable[[], dict], step: Step, waiting: StructType, order: list[str], out: list[str], keep_ms: int | None) -> None:
        self.start, self.step, self.waiting, self.order, self.keep_ms = start, step, waiting, order, keep_ms
        self.row = Row(*out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("waiting", self.waiting)
        self.state = handle.getValueState("folded", "state string, last_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.waiting.names) for r in rows]
        self.queue.appendList(new)
        # a timer for the first new event is enough: it sets the next one when it fires
        self.handle.registerTimer(-(-min(r[0] for r in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [Row(*self.waiting.names)(*r) for r in self.queue.get()]
        ripe = sorted((r for r in waiting if r[0] <= passed), key=lambda r: tuple((r[c] is not None, r[c]) for c in self.order))
        held = [r for r in waiting if r[0] > passed]
        known = self.state.get() if self.state.exists() else None
        if ripe:
            state = json.loads(known[0]) if known else self.start()
            out = [self.step(state, r) for r in ripe]
            last = ripe[-1][0]
            self.state.update((json.dumps(state), last))
            self.queue.clear()
            if held:
                self.queue.put([tuple(r) for r in held])
                self.handle.registerTimer(-(-min(r[0] for r in held) // 1000))
            if self.keep_ms is not None:
                self.handle.registerTimer(-(-last // 1000) + self.keep_ms)
            yield from (self.row(*o) for o in out if o is not None)
        elif not held and known and self.keep_ms is not None and -(-known[1] // 1000) + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()


def ordered_fold(events: DataFrame, key: str, at: str, order: list[str], start: Callable[[], dict], step: Step, schema: str, keep: timedelta | None = None) -> DataFrame:
    """Rows of ``schema`` that ``step(state, event)`` yields (None: no row) over each key's events in the order of (``at``, ``order``).

    ``events`` is a stream with a watermark on the timestamp ``at``. ``state`` is a dict that JSON can hold; ``step`` changes it in place. ``at_us`` of an event is
    its time in microseconds. ``keep`` after a key's last event its state is forgotten (never, if None): give what ``step`` looks back at.
    """
    x = events.filter(F.col(at).isNotNull()).withColumn("at_us", F.unix_micros(F.col(at).cast("timestamp")))
    columns = [f for f in x.schema.fields if f.name not in (at, "at_us")]
    waiting = StructType([StructField("at_us", LongType()), *columns])
    out = StructType.fromDDL(schema)
    fold = _Fold(start, step, waiting, ["at_us", *order], out.names, None if keep is None else int(keep.total_seconds() * 1000))
    return x.groupBy(key).transformWithState(fold, out, "append", "eventTime")


def rate_limit(events: DataFrame, most: int = 60, window: timedelta = timedelta(seconds=60)) -> DataFrame:
    """(key, event_id, allowed) of (key, event_id, at): at most ``most`` requests in any ``window``; a request that is refused does not count."""
    span = int(window.total_seconds() * 1e6)

    def step(state: dict, r) -> tuple:
        state["times"] = [t for t in state["times"] if t > r.at_us - span]
        ok = len(state["times"]) < most
        if ok:
            state["times"].append(r.at_us)
        return r.key, r.event_id, ok

    return ordered_fold(events.select("key", "event_id", "at"), "key", "at", ["event_id"], lambda: {"times": []}, step, f"key {_kind(events, 'key')}, event_id {_kind(events, 'event_id')}, allowed boolean", window)


def failure_window(events: DataFrame, most: int = 5, window: timedelta = timedelta(minutes=15)) -> DataFrame:
    """(key, event_id, blocked) of (key, event_id, at, failed): blocked while ``most`` failures lie in the window; success clears them. A null counts as success."""
    span = int(window.total_seconds() * 1e6)

    def step(state: dict, r) -> tuple:
        state["times"] = [t for t in state["times"] if t > r.at_us - span]
        blocked = len(state["times"]) >= most
        if not blocked:
            state["times"] = [*state["times"], r.at_us] if r.failed else []
        return r.key, r.event_id, blocked

    return ordered_fold(events.select("key", "event_id", "at", "failed"), "key", "at", ["event_id"], lambda: {"times": []}, step, f"key {_kind(events, 'key')}, event_id {_kind(events, 'event_id')}, blocked boolean", window)


def rescan_alerts(scans: DataFrame, keep: timedelta | None = timedelta(days=90)) -> DataFrame:
    """(site, scan_id, new_count, resolved_count, partial) of (site, scan_id, at, fingerprints, truncated): against the site's scan before, if it is within ``keep``.

    If one of the two scans was cut off the alert is partial and nothing counts as resolved. The first scan of a site has no row.
    """

    def step(state: dict, r) -> tuple | None:
        now, cut, before = set(r.fingerprints or ()), bool(r.truncated), state.get("last")
        partial = cut or bool(state.get("cut"))
        row = None if before is None else (r.site, r.scan_id, len(now.difference(before)), 0 if partial else len(set(before) - now), partial)
        state.update(last=sorted(x for x in now if x is not None), cut=cut)
        return row

    kinds = f"site {_kind(scans, 'site')}, scan_id {_kind(scans, 'scan_id')}"
    return ordered_fold(scans.select("site", "scan_id", "at", "fingerprints", "truncated"), "site", "at", ["scan_id"], dict, step, f"{kinds}, new_count long, resolved_count long, partial boolean", keep)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
