"""Joins that keep, classify or overlay rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_exists_flag(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``left`` with whether its key is in ``right``; rows of ``left`` are not multiplied."""
    marks = right.select(*keys).distinct().withColumn(name, F.lit(True))
    return left.join(marks, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def classified(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str, str] = ("both", "removed", "added")) -> DataFrame:
    """(key, class): in both, only in ``a`` or only in ``b``."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    kind = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), names[0]).when(F.col("_b").isNull(), names[1]).otherwise(names[2])
    return left.join(right, key, "full_outer").select(key, kind.alias("class"))


def overlay(official: DataFrame, curated: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Curated values win where not null; rows of either side stay."""
    c = curated.select(key, *[F.col(x).alias(f"_c_{x}") for x in columns])
    return official.select(key, *columns).join(c, key, "full_outer").select(key, *[F.coalesce(f"_c_{x}", x).alias(x) for x in columns])


def year_pairs(df: DataFrame, entity: str, year: str, value: str, prior: int, latest: int) -> DataFrame:
    """Each entity's values in two years, both present."""
    a = df.where(F.col(year) == prior).select(entity, F.col(value).alias("prior_value"))
    b = df.where(F.col(year) == latest).select(entity, F.col(value).alias("latest_value"))
    return a.join(b, entity)


def paired_counts(df: DataFrame, entity: str, at: str, prior: int, latest: int) -> DataFrame:
    """Each entity's row counts in two years, both present: one scan of the years' ranges of ``at``, which the scan can prune by, and one aggregate."""

    def within(year: int) -> Column:
        return (F.col(at) >= F.expr(f"TIMESTAMP_NTZ '{year}-01-01 00:00:00'")) & (F.col(at) < F.expr(f"TIMESTAMP_NTZ '{year + 1}-01-01 00:00:00'"))

    counts = df.where(within(prior) | within(latest)).groupBy(entity).agg(F.count_if(within(prior)).alias("prior_value"), F.count_if(within(latest)).alias("latest_value"))
    return counts.where("prior_value > 0 AND latest_value > 0")


def latest_overlay(base: DataFrame, extra: DataFrame, on: Sequence[str], fits: str, order: Sequence, columns: Sequence[str]) -> DataFrame:
    """``base`` with ``columns`` of the first row of ``extra`` by ``order`` that fits it, null where none does.

    ``fits`` is a condition over ``b`` and ``e``, ``order`` columns of ``e``. Equal rows of ``base`` all stay and get the same.
    """
    rows = base.withColumn("_base", F.struct(*[F.col(c) for c in base.columns]))
    equal = " AND ".join(f"b.`{c}` = e.`{c}`" for c in on)
    pairs = rows.select("_base", *base.columns).distinct().alias("b").join(extra.alias("e"), F.expr(f"{equal} AND ({fits})"))
    best = pairs.groupBy("_base").agg(F.min_by(F.struct(*[F.col(f"e.{c}") for c in columns]), F.struct(*order)).alias("_best"))
    return rows.join(best, "_base", "left").select(*base.columns, *[F.col(f"_best.{c}") for c in columns])


def missing(ours: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``ours`` whose key is not in ``theirs``; a null part of a key equals a null part."""
    other = theirs.select(*[F.col(k).alias(f"_t_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    return ours.join(other, same, "left_anti")
