"""A work queue as a stream of events: claims under leases that end by timers, with no scan of the queue.

Rows are dealt into lanes; a lane's rows that wait and rows in work are kept as state. A lease that runs out
gives its row back when the lane's next event comes or when the watermark passes the lease's end, whichever is
first, and with the same result. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIONS = "lane int, id bigint, attempt int, at timestamp, action string, worker string"


def use_rocksdb(spark: SparkSession) -> None:
    """Has the session's streams keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def lane_of(key: Column, lanes: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")


class _Lane(StatefulProcessor):
    """One lane: ``waiting`` has (enqueued, attempts) and ``working`` has (claimed, attempt, enqueued, worker) by row, times in microseconds."""

    def __init__(self, lease_us: int, most_attempts: int):
        self.lease, self.most = lease_us, most_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "id bigint", "enqueued bigint, attempts int")
        self.working = handle.getMapState("working", "id bigint", "claimed bigint, attempt int, enqueued bigint, worker string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        lane = key[0]
        for event in sorted(rows, key=lambda r: (r.us, r.rank, r.id or 0, r.worker or "")):
            yield from self._expired(lane, event.us)
            if event.kind == "enqueue":
                if event.id is not None and not self.waiting.containsKey((event.id,)) and not self.working.containsKey((event.id,)):
                    self.waiting.updateValue((event.id,), (event.us, 0))
                else:
                    yield self._row(lane, event.id, None, event.us, "ignored", None)
            elif event.kind == "claim":
                yield self._claimed(lane, event)
            else:
                yield self._reported(lane, event)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._expired(key[0], expiredTimerInfo.getExpiryTimeInMs() * 1000)

    def _claimed(self, lane: int, event: Row) -> Row:
        first = min(((value[0], k[0], value[1]) for k, value in self.waiting.iterator()), default=None)
        if first is None:
            return self._row(lane, None, None, event.us, "idle", event.worker)
        enqueued, row, attempts = first
        self.waiting.removeKey((row,))
        self.working.updateValue((row,), (event.us, attempts + 1, enqueued, event.worker))
        self.handle.registerTimer(-(-(event.us + self.lease) // 1000))
        return self._row(lane, row, attempts + 1, event.us, "claimed", event.worker)

    def _reported(self, lane: int, event: Row) -> Row:
        held = self.working.getValue((event.id,)) if event.id is not None and self.working.containsKey((event.id,)) else None
        if held is None or held[1] != event.attempt or held[3] != event.worker:
            return self._row(lane, event.id, event.attempt, event.us, "refused", event.worker)
        self.working.removeKey((event.id,))
        return self._row(lane, event.id, event.attempt, event.us, event.kind, event.worker)

    def _expired(self, lane: int, now: int) -> list[Row]:
        """Gives back the rows whose lease has run out, the earliest first; rows in work are as many as the lane's workers."""
        over = sorted((v[0] + self.lease, k[0], v[1], v[2], v[3]) for k, v in self.working.iterator() if v[0] + self.lease <= now)
        out = []
        for end, row, attempt, enqueued, worker in over:
            self.working.removeKey((row,))
            out.append(self._row(lane, row, attempt, end, "timed_out", worker))
            if attempt >= self.most:
                out.append(self._row(lane, row, attempt, end, "exhausted", worker))
            else:
                self.waiting.updateValue((row,), (enqueued, attempt))
        return out

    def _row(self, lane: int, row: int | None, attempt: int | None, us: int, action: str, worker: str | None) -> Row:
        return Row(lane=lane, id=row, attempt=attempt, us=us, action=action, worker=worker)


def lease_actions(events: DataFrame, lease_seconds: int, most_attempts: int = 3, lateness: str = "0 seconds") -> DataFrame:
    """``(lane, id, attempt, at, action, worker)`` of a stream of ``events (lane, kind, id, attempt, worker, at)``.

    Kinds: ``enqueue`` puts a row in (``ignored`` if it is there or null); ``claim`` gives a worker the lane's row that
    was enqueued first (``claimed``, or ``idle`` if none waits); ``done`` and ``failed`` end a row if the
    worker still holds that attempt (else ``refused``). A lease that runs out at ``claim + lease_seconds`` is ``timed_out`` at that time;
    the row waits again at its old place, or is ``exhausted`` after ``most_attempts``. Events of one time are taken as
    reports, then enqueued rows, then claims. Events later than the watermark are dropped. A claim looks
    through the lane's waiting rows, so deal large queues into many lanes.
    """
    us = F.unix_micros(F.col("at").cast("timestamp"))
    rank = F.when(F.col("kind").isin("done", "failed"), 0).when(F.col("kind") == "enqueue", 1).otherwise(2)
    rows = events.withWatermark("at", lateness).select("lane", "kind", F.col("id").cast("bigint"), F.col("attempt").cast("int"), "worker", "at", us.alias("us"), rank.alias("rank"))
    schema = "lane int, id bigint, attempt int, us bigint, action string, worker string"
    actions = rows.where("lane IS NOT NULL").groupBy("lane").transformWithState(_Lane(lease_seconds * 1_000_000, most_attempts), schema, "append", "eventTime")
    return actions.select("lane", "id", "attempt", F.timestamp_micros("us").alias("at"), "action", "worker")
