"""The stream's claims against the batch operator's, claim by claim, and leases that end with and without further events."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cairnwork.operators import queue as Q
from cairnwork.streaming import leases

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = "lane int, kind string, id bigint, attempt int, worker string, at timestamp"


def _at(seconds):
    return START + dt.timedelta(seconds=seconds)


def _run(spark, tmp_path, batches, lease=600, most=3):
    """The actions of a stream that gets ``batches`` one after the other, and then an event far later that makes the watermark pass all leases."""
    leases.use_rocksdb(spark)
    last = [(99, "enqueue", 1, None, None, 10**7)], [(99, "enqueue", 2, None, None, 10**7 + 1)]
    for k, rows in enumerate([*batches, *last]):
        spark.createDataFrame([(*r[:5], _at(r[5])) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = leases.lease_actions(events, lease, most).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(180) and query.exception() is None, k
    out = spark.read.parquet(str(tmp_path / "out")).where("lane <> 99")
    return sorted(((r.lane, r["at"].timestamp() - START.timestamp(), r.action, r.id, r.attempt, r.worker) for r in out.collect()), key=repr)


def test_leases_end_by_events_and_by_timers(spark, tmp_path):
    first = [(0, "enqueue", 1, None, None, 0), (0, "enqueue", 2, None, None, 1), (0, "enqueue", 2, None, None, 2), (0, "claim", None, None, "a", 10), (0, "claim", None, None, "b", 20), (0, "claim", None, None, "c", 30), (1, "claim", None, None, "a", 30)]
    second = [(0, "done", 2, 1, "b", 100), (0, "done", 1, 1, "a", 611), (0, "claim", None, None, "c", 612), (0, "done", 1, 1, "a", 613), (0, "done", 1, 2, "c", 614), (0, "enqueue", 3, None, None, 700), (0, "claim", None, None, "d", 701)]
    got = _run(spark, tmp_path, [first, second])
    assert got == sorted([
        (0, 2.0, "ignored", 2, None, None), (0, 10.0, "claimed", 1, 1, "a"), (0, 20.0, "claimed", 2, 1, "b"), (0, 30.0, "idle", None, None, "c"), (1, 30.0, "idle", None, None, "a"),
        (0, 100.0, "done", 2, 1, "b"), (0, 610.0, "timed_out", 1, 1, "a"), (0, 611.0, "refused", 1, 1, "a"), (0, 612.0, "claimed", 1, 2, "c"), (0, 613.0, "refused", 1, 1, "a"), (0, 614.0, "done", 1, 2, "c"),
        (0, 701.0, "claimed", 3, 1, "d"), (0, 1301.0, "timed_out", 3, 1, "d"),
    ], key=repr)


def test_attempts_are_exhausted(spark, tmp_path):
    rows = [(0, "enqueue", 1, None, None, 0), *((0, "claim", None, None, "a", 20 * k) for k in range(1, 4))]
    got = _run(spark, tmp_path, [rows], lease=10, most=2)
    assert [(x[1], x[2], x[4]) for x in sorted(got, key=lambda x: (x[1], x[2] == "exhausted"))] == [(20.0, "claimed", 1), (30.0, "timed_out", 1), (40.0, "claimed", 2), (50.0, "timed_out", 2), (50.0, "exhausted", 2), (60.0, "idle", None)]


def test_claims_equal_the_batch_operator(spark, tmp_path):
    """A random history: the row that each claim gets is the one that the batch claim picks from the same queue at that time."""
    draw = random.Random(5)
    events, now = [], 0
    for row in range(6):
        events.append((0, "enqueue", row, None, None, now := now + draw.randint(1, 9)))
    for k in range(9):
        events.append((0, "claim", None, None, f"w{k}", now := now + draw.randint(5, 45)))
    got = _run(spark, tmp_path, [events[:8], events[8:]], lease=60, most=100)
    claims = {x[1]: x[3] for x in got if x[2] in ("claimed", "idle")}
    queue = spark.createDataFrame([(e[2], "pending", None, 0, e[5]) for e in events if e[1] == "enqueue"], "id bigint, status string, claimed_at timestamp, attempts int, enqueued int")
    for event in events:
        if event[1] == "claim":
            after, _ = Q.claim(queue, "id", [F.asc("enqueued")], F.lit(_at(event[5])), 60, 1)
            rows = after.collect()
            picked = [r.id for r in rows if r.claimed_at and r.claimed_at.timestamp() == _at(event[5]).timestamp()]
            assert claims[float(event[5])] == (picked[0] if picked else None)
            queue = spark.createDataFrame(rows, queue.schema)
