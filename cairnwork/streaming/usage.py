"""Usage events as a stream: windowed counts under a watermark, and the same over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_usage(events: DataFrame, length: str = "1 day", lateness: str = "2 hours", ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums for each window and kind, of a table or a stream.

    On a stream, state is held only for windows that the watermark has not passed: an event
    later than ``lateness`` is left out. A table has no late events. Null times are dropped.
    Times without zone are read in the session's zone on a stream, so set that to UTC.
    """
    rows = events.where(F.col(ts).isNotNull())
    if events.isStreaming:
        rows = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return rows.groupBy(F.window(ts, length).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").cast(events.schema[ts].dataType).alias("start"), kind, "n", "total")
