"""Matching records by signatures that are unique on both sides, and names by similarity within blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def unique_matches(a: DataFrame, b: DataFrame, signature: Sequence[str]) -> DataFrame:
    """Rows of both sides that share a signature held by one row on each side; null parts match nothing."""

    def single(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c not in signature]
        once = df.groupBy(*signature).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in others])
        return once.where("_n = 1").drop("_n")

    return single(a).join(single(b), list(signature))


@pandas_udf(DoubleType())
def similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the matching characters over all characters; null if either side is."""
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def best_names(a: DataFrame, b: DataFrame, name_a: str, name_b: str, least: float = 0.82, usable: Column | None = None) -> DataFrame:
    """``(name_a, name_b, score)``: for each name of ``a`` the most similar name of ``b``, at ``least`` or more, ties to the lesser name.

    Names are compared once for each distinct pair that shares a token, ignoring case, and only
    if their lengths allow the score: a score of ``least`` needs lengths within a factor of
    (2 - least) / least, so tokens join by bins of length, which also splits common tokens, and
    pairs out of that range aren't made. Names under one very common token and of like length
    are still all held against each other. ``usable`` may exclude pairs.
    """
    step = (2 - least) / least

    def tokens(df: DataFrame, name: str) -> DataFrame:
        words = F.array_distinct(F.split(F.lower(name), "[^\\p{L}\\p{N}]+"))
        length_bin = F.floor(F.log(F.length(name)) / F.log(F.lit(max(step, 1.0001)))).cast("int")
        return df.select(name).where(f"`{name}` <> ''").distinct().select(name, length_bin.alias("_bin"), F.explode(words).alias("_token")).where("_token <> ''")

    size_a, size_b = F.length(name_a), F.length(name_b)
    near = F.least(size_a, size_b) * 2 >= least * (size_a + size_b)
    around = tokens(a, name_a).withColumn("_bin", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)))
    pairs = around.join(tokens(b, name_b), ["_token", "_bin"]).where(near)
    pairs = (pairs.where(usable) if usable is not None else pairs).select(name_a, name_b).distinct()
    scored = pairs.withColumn("score", similarity(F.lower(name_a), F.lower(name_b))).where(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy(name_a).orderBy(F.desc("score"), name_b))
    return scored.withColumn("_place", place).where("_place = 1").drop("_place")
