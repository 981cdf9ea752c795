"""Places of rows in a sort, overall and in groups, with no group and no table in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwork.storage import materialize

PART_BITS = 33

#: A column to sort by, or an expression with its direction (``F.asc``, ``F.desc`` or one that says where nulls go).
Order = Column | str | tuple[Column, Callable[[str], Column]]


def sorted_ranges(df: DataFrame, order: Sequence[Order]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order`` and written, with ``_part`` and ``_at``: a row's range and its place there.

    A sort evaluates an expression anew for both rows of each comparison, so expressions given with
    their direction are made columns first and evaluated once a row.
    """
    made = {f"_key{i}": x[0] for i, x in enumerate(order) if isinstance(x, tuple)}
    by = [x[1](f"_key{i}") if isinstance(x, tuple) else x for i, x in enumerate(order)]
    ranged = df.withColumns(made).repartitionByRange(*by).sortWithinPartitions(*by).drop(*made)
    placed = ranged.withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumns({"_part": F.shiftright("_id", PART_BITS), "_at": F.col("_id").bitwiseAND(F.lit((1 << PART_BITS) - 1))}).drop("_id")
    return materialize(placed, "ordered")


def overall_places(df: DataFrame, order: Sequence[Order], name: str = "_place") -> DataFrame:
    """``df`` with places from 0 in the order; only the table of ranges, one row each, goes through one task."""
    placed = sorted_ranges(df, order)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def group_places(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_place`` from 0 in each group by ``order`` and the group's ``_count``.

    Rows are range-sorted by (keys, order), so a group of any size is spread over ranges. The
    first place and the rows of each group in each range are a small table, joined by its keys.
    """
    placed = sorted_ranges(df, [*keys, *order])
    runs = placed.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("_part", *[F.col(k).alias(f"_k_{k}") for k in keys], (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("_count"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = placed.join(starts.withColumnRenamed("_part", "_p"), [F.col("_part") == F.col("_p"), *same])
    return joined.withColumn("_place", F.col("_at") + F.col("_shift")).drop("_part", "_p", "_at", "_shift", *[f"_k_{k}" for k in keys])
