"""Upserts as joins of the stored table with a batch; each returns the whole new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.operators.ranking import first_per_key


def last_write_wins(stored: DataFrame, batch: DataFrame, keys: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """``stored`` with the batch's rows, of equal key the first by ``arrival``; keys not in the batch stay."""
    latest = first_per_key(batch, keys, arrival).select(*stored.columns)
    return stored.join(latest.select(*keys), list(keys), "left_anti").select(*stored.columns).unionByName(latest)


def insert_ignore(stored: DataFrame, batch: DataFrame, keys: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """The rows of the batch whose key isn't stored yet, one for each key: append them and count them for the number inserted."""
    return first_per_key(batch.join(stored.select(*keys), list(keys), "left_anti"), keys, arrival).select(*batch.columns)


def upsert_keeping(stored: DataFrame, batch: DataFrame, key: str, kept: Sequence[str], reviewed: Column) -> DataFrame:
    """The batch's rows, with ``kept`` columns of stored rows; stored rows that aren't in the batch stay only if ``reviewed``.

    Keys are unique on both sides.
    """
    own = stored.select(key, *[F.col(c).alias(f"_s_{c}") for c in kept])
    fresh = batch.join(own, key, "left").select(*[F.coalesce(f"_s_{c}", c).alias(c) if c in kept else F.col(c) for c in stored.columns])
    return fresh.unionByName(stored.where(F.coalesce(reviewed, F.lit(False))).join(batch.select(key), key, "left_anti").select(*stored.columns))


def update_from(stored: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Stored rows with the source's values of ``columns`` where it has the key, null values too."""
    new = source.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = stored.join(new, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])
