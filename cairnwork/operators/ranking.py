"""Latest-per-key, precedence and tiered picks as ranking windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwork.operators.places import Order, overall_places


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``; Spark plans a group limit before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with 1-based places in each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ranked_overall(df: DataFrame, order: Sequence[Order], name: str = "rank") -> DataFrame:
    """``df`` with 1-based places in the whole table, sorted by ranges."""
    return overall_places(df, order, name).withColumn(name, F.col(name) + 1)


def any_earlier(df: DataFrame, keys: Sequence[str], order: Sequence[Column], condition: Column, name: str) -> DataFrame:
    """Whether ``condition`` held in any strictly earlier row of the key."""
    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.max(condition).over(rows), F.lit(False)))


def match_tier(text: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 substring, 3 other, ignoring case."""
    low, q = F.lower(text), query.lower()
    return F.when(low == q, 0).when(low.startswith(q), 1).when(low.contains(q), 2).otherwise(3)


def pinned(df: DataFrame, id_col: str, asked_id: str, name: Column, text: str, limit: int, order: Sequence[Column], prefix: str | None = None) -> DataFrame:
    """The best hits of a search: the row whose id is asked for first, then exact names, then names with the prefix (the text if not given).

    The asked id is trimmed; ``limit`` is kept between 1 and 25.
    """
    low = F.lower(name)
    kind = df.schema[id_col].dataType.simpleString()
    tier = F.when(F.col(id_col) == F.lit(asked_id.strip()).try_cast(kind), -1).when(low == text.lower(), 0).when(low.startswith((prefix or text).lower()), 1)
    return df.withColumn("_tier", tier).where("_tier IS NOT NULL").orderBy("_tier", *order).limit(max(1, min(25, limit))).drop("_tier")
