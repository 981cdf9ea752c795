"""Conditional pivots, bucket summaries and interpolated quantiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.operators.places import group_places


def conditional_pivot(df: DataFrame, keys: Sequence[str], field: str, value: str, columns: Mapping[str, str]) -> DataFrame:
    """Long to wide: the greatest ``value`` of each named field, one column each, in one aggregate."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(field) == name, F.col(value))).alias(out) for out, name in columns.items()])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float], digits: int = 4) -> DataFrame:
    """Linear-interpolated quantiles, rounded, in one aggregate that holds a group's distinct values: for values of bounded number."""
    found = df.groupBy(*keys).agg(F.percentile(value, F.lit([float(p) for p in points])).alias("_p"))
    return found.select(*keys, *[F.round(F.col("_p")[i], digits).alias(f"p{round(100 * p)}") for i, p in enumerate(points)])


def ranked_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float], digits: int | None = 4) -> DataFrame:
    """``quantiles`` for groups of any size: a range sort gives each value its place, and only the neighbours of the wanted places are picked.

    Keys without a value have no row. Nothing is rounded if ``digits`` is None. No task holds more than its range of the sort.
    """
    placed = group_places(df.select(*keys, value).where(F.col(value).isNotNull()), keys, [value])
    at = {f"p{round(100 * p)}": (F.col("_count") - 1) * F.lit(float(p)) for p in points}
    aggs = []
    for name, place in at.items():
        low, high = F.floor(place), F.ceil(place)
        aggs += [F.max(F.when(F.col("_place") == low, F.col(value))).alias(f"_low_{name}"), F.max(F.when(F.col("_place") == high, F.col(value))).alias(f"_high_{name}"), F.max(place - low).alias(f"_part_{name}")]
    wanted = reduce(lambda a, b: a | b, [(F.col("_place") == F.floor(p)) | (F.col("_place") == F.ceil(p)) for p in at.values()])
    picked = placed.where(wanted).groupBy(*keys).agg(*aggs)
    found = {n: F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}") for n in at}
    return picked.select(*keys, *[(v if digits is None else F.round(v, digits)).alias(n) for n, v in found.items()])


def with_total(df: DataFrame, key: str, aggs: Sequence[Column], label: str = "TOTAL") -> DataFrame:
    """The aggregates of each key, and of all rows under ``label``, in one pass."""
    rows = df.rollup(key).agg(*aggs, F.grouping(key).alias("_all"))
    return rows.withColumn(key, F.when(F.col("_all") == 1, label).otherwise(F.col(key))).drop("_all")


def counts_around(df: DataFrame, key: str, before: Column, after: Column) -> DataFrame:
    """Counts of each key among the rows of two conditions, and the difference, in one pass; keys with neither are left out."""
    counts = df.groupBy(key).agg(F.count_if(before).alias("before"), F.count_if(after).alias("after"))
    return counts.where("before > 0 OR after > 0").withColumn("delta", F.col("after") - F.col("before"))


def bucket(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Half-open buckets, the last open."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels[:-1], strict=True))):
        out = F.when(value < edge, label).otherwise(out)
    return out


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def signed_totals(df: DataFrame, key: str, seeks: Column, size: Column, low: float, high: float) -> DataFrame:
    """Sum of sizes, those that don't seek counted negative, kept in ``low`` to ``high``; 0 for a key with both kinds."""
    marked = df.select(key, seeks.alias("_s"), size.alias("_n"))
    sums = marked.groupBy(key).agg(F.sum(F.when(F.col("_s"), F.col("_n")).otherwise(-F.col("_n"))).alias("_t"), (F.bool_or("_s") & ~F.bool_and("_s")).alias("conflicted"))
    return sums.select(key, F.when(F.col("conflicted"), 0).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col("_t")))).alias("total"), "conflicted")


def with_all_labels(df: DataFrame, name: str, labels: Sequence[str], zero: Sequence[str] = ()) -> DataFrame:
    """A row for each of ``labels``, empty ones too; columns in ``zero`` are 0 there, others null."""
    every = df.sparkSession.createDataFrame([(x,) for x in labels], f"`{name}` string")
    return every.join(df, name, "left").fillna(0, list(zero))


def count_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts of each key before and after, and the difference; a key missing on one side counts 0 there."""
    sides = [d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((before, "before"), (after, "after"))]
    return sides[0].join(sides[1], key, "full_outer").fillna(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))


def non_null_count(columns: Sequence[str]) -> Column:
    """How many of the columns hold a value in a row."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def compare_matrix(facts: DataFrame, ids: Sequence, id_col: str, field: str, value: str, columns: Sequence[str], placeholder: str) -> DataFrame:
    """One row for each asked id in the order asked (first mention), one column for each field, gaps filled."""
    order = list(dict.fromkeys(ids))
    wanted = facts.sparkSession.createDataFrame(list(enumerate(order)), f"position int, `{id_col}` {facts.schema[id_col].dataType.simpleString()}")
    cells = facts.where(F.col(id_col).isin(order) & F.col(field).isin(list(columns)))
    wide = conditional_pivot(cells, [id_col], field, value, {c: c for c in columns})
    return wanted.join(wide, id_col, "left").select("position", id_col, *[F.coalesce(F.col(c).cast("string"), F.lit(placeholder)).alias(c) for c in columns])
