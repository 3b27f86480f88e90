import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wardlume.operators import ledger
from wardlume.streaming import ordered

START = datetime(2024, 5, 1, tzinfo=timezone.utc)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(PROVIDER, ordered.ROCKSDB)
    yield spark
    spark.conf.unset(PROVIDER)


def _streamed(spark, tmp_path, name, schema, batches, job, delay="1 hour"):
    """What a job makes of batches of rows, one file and one micro-batch each, and the rows of state left at the end."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i:03d}"))
        files = list((tmp_path / "in" / f"b={i:03d}").glob("*.parquet"))
        assert len(files) == 1
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = job(stream.withWatermark("at", delay)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    state = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress["stateOperators"] else None
    q.stop()
    return spark.table(name), state


def _shuffled(rows, parts, late_rows):
    rng = random.Random(3)
    rows = rows[:]
    rng.shuffle(rows)
    return [rows[i::parts] for i in range(parts)] + [late_rows]


def test_rate_limit_equals_batch_on_shuffled_batches(rocksdb, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, START + timedelta(seconds=rng.randint(0, 1800), microseconds=rng.choice([0, 1, 999]))) for i in range(200)]
    schema = "key string, event_id long, at timestamp"
    # far later events of another key move the watermark past all others, and then past what is kept
    end = [("end", 1000, START + timedelta(hours=9))]
    got, _ = _streamed(rocksdb, tmp_path, "limited_in_order", schema, [*_shuffled(rows, 4, end), [("end", 1001, START + timedelta(hours=20))]], lambda s: ordered.rate_limit(s, 3, timedelta(seconds=90)))
    batch = ledger.rate_limited(rocksdb.createDataFrame([(k or "none", i, t) for k, i, t in rows], schema), "key", "at", 3, 90.0)
    want = {r.event_id: r.allowed for r in batch.collect()}
    assert {r.event_id: r.allowed for r in got.filter("event_id < 1000").collect()} == want and len(set(want.values())) == 2


def test_state_ends_by_itself_and_late_events_go(rocksdb, tmp_path):
    schema = "key string, event_id long, at timestamp, failed boolean"
    minute = lambda k, i, m, failed=True: (k, i, START + timedelta(minutes=m), failed)
    batches = [[minute("a", 3, 3), minute("a", 1, 1), minute("b", 9, 2, None)], [minute("a", 2, 2), minute("a", 4, 4)], [minute("end", 100, 600)], [minute("end", 103, 601)], [minute("a", 5, 5)], [minute("end", 101, 1200)], [minute("end", 102, 1800)]]
    got, state = _streamed(rocksdb, tmp_path, "windows_in_order", schema, batches, lambda s: ordered.failure_window(s, 3, timedelta(minutes=15)))
    rows = {r.event_id: r.blocked for r in got.collect()}
    assert {k: v for k, v in rows.items() if k < 100} == {1: False, 2: False, 3: False, 4: True, 9: False}  # the fifth came behind the watermark
    assert state is None or state <= 8  # one key's event, timers and their indexes are left


def test_rescans_in_order(rocksdb, tmp_path):
    schema = "site string, scan_id long, at timestamp, fingerprints array<string>, truncated boolean"
    day = lambda i, prints, cut=None: ("s", i, START + timedelta(days=i), prints, cut)
    batches = [[day(2, ["b", "c"]), day(0, ["a", "b"])], [day(3, None, True), day(1, ["a", "b", "d"])], [("end", 9, START + timedelta(days=400), [], None)]]
    got, _ = _streamed(rocksdb, tmp_path, "rescans_in_order", schema, batches, ordered.rescan_alerts, "30 days")
    assert sorted(tuple(r) for r in got.filter(F.col("site") == "s").collect()) == [("s", 1, 1, 0, False), ("s", 2, 1, 2, False), ("s", 3, 0, 0, True)]
