"""A work queue as a table: claims with leases, and what becomes of attempts whose lease ran out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claimable(status: Column, claimed_at: Column, now: Column, lease_seconds: int) -> Column:
    """Pending rows, and rows in work whose lease has run out."""
    late = F.coalesce(F.timestamp_diff("SECOND", claimed_at, now) >= lease_seconds, F.lit(True))
    return (status == "pending") | ((status == "in_work") & late)


def claim(queue: DataFrame, key: str, order: Sequence[Column], now: Column, lease_seconds: int, count: int) -> tuple[DataFrame, DataFrame]:
    """(the whole queue after the claim of the next ``count`` rows, the attempts that timed out by it).

    ``queue`` has status, claimed_at and attempts; ``order`` is total and keys are unique. The
    claim is a top-k of bounded size, joined back by key.
    """
    ready = queue.where(claimable(F.col("status"), F.col("claimed_at"), now, lease_seconds))
    picked = ready.orderBy(*order).limit(count)
    marks = picked.select(key, F.lit(True).alias("_claimed"))
    mine = F.coalesce(F.col("_claimed"), F.lit(False))
    after = queue.join(marks, key, "left").withColumns({
        "status": F.when(mine, "in_work").otherwise(F.col("status")),
        "claimed_at": F.when(mine, now).otherwise(F.col("claimed_at")),
        "attempts": F.col("attempts") + mine.cast("int"),
    }).select(*queue.columns)
    lost = picked.where("status = 'in_work'").select(key, "claimed_at", F.col("attempts").alias("attempt"), F.lit("timed_out").alias("outcome"))
    return after, lost


def complete(queue: DataFrame, reports: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the queue after reports of finished work, the reports that were refused).

    ``reports`` has (key, attempts, claimed_at, outcome, failed). A report counts only if its
    attempt still holds the row: the row is in work, with the same attempt and claim time.
    Otherwise another worker took the row over, and the report is refused.
    """
    held = queue.where("status = 'in_work'").select(key, F.col("attempts").alias("_a"), F.col("claimed_at").alias("_c"))
    same = [reports[key] == held[key], reports["attempts"].eqNullSafe(held["_a"]), reports["claimed_at"].eqNullSafe(held["_c"])]
    valid = reports.join(held, same, "left_semi").groupBy(key).agg(F.max_by("outcome", "failed").alias("_outcome"), F.max("failed").alias("_failed"))
    before = F.col("outcome") if "outcome" in queue.columns else F.lit(None).cast("string")
    status = F.when(F.col("_failed"), "failed_permanent").when(~F.col("_failed"), "done").otherwise(F.col("status"))
    kept = [status.alias(c) if c == "status" else F.col(c) for c in queue.columns if c != "outcome"]
    done = queue.join(valid, key, "left").select(*kept, F.coalesce("_outcome", before).alias("outcome"))
    return done, reports.join(held, same, "left_anti")


def over_budget(queue: DataFrame, most: int, now: Column) -> DataFrame:
    """The queue with rows claimed more than ``most`` times closed as failed, with the time and the reason."""
    spent = (F.coalesce("attempts", F.lit(0)) > most) & F.col("status").isin("pending", "in_work")
    error = F.format_string(f"exhausted {most} attempts before processing (claimed %d times without a result)", F.coalesce("attempts", F.lit(0)))
    return queue.withColumns({
        "processed_at": F.when(spent, now), "last_outcome": F.when(spent, "transient"), "last_error": F.when(spent, error), "status": F.when(spent, "failed_permanent").otherwise(F.col("status")),
    })


def enqueued(queue: DataFrame, batch: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The rows of the batch that may enter: one of each key, and none of a key that has an active row (pending or in work)."""
    from cairnwork.operators.ranking import first_per_key

    active = queue.where("status IN ('pending', 'in_work')").select(key).distinct()
    return first_per_key(batch.join(active, key, "left_anti"), [key], order)


def next_state(events: DataFrame, key: str, order: Sequence[str], transitions: dict[tuple[str, str], str], start: str) -> DataFrame:
    """(key, state): where each key's log of events leads, from ``start``; an event without a transition from the state changes nothing.

    The log of a key is folded in order inside one aggregate, so it must fit a task.
    """
    log = events.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "event"))), lambda x: x["event"]).alias("_log"))
    table = F.create_map(*[F.lit(x) for (state, event), new in transitions.items() for x in (f"{state}|{event}", new)])
    return log.select(key, F.aggregate("_log", F.lit(start), lambda s, e: F.coalesce(table[F.concat_ws("|", s, e)], s)).alias("state"))
