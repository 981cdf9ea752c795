"""Typed facts from coded values with labels and imputation marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a label that name a status, in the order in which they are tried.
STATUS_WORDS = {
    "not_applicable": ("not applicable", "not in universe", "not offered"),
    "suppressed": ("suppressed", "privacy", "confidential"),
    "missing": ("not reported", "not available", "missing", "unknown"),
}


def quality_of_label(label: Column) -> Column:
    """imputed, not_applicable, suppressed, missing or, for other labels and null, reported."""
    low, out = F.lower(label), F.lit("reported")
    for status, words in reversed(STATUS_WORDS.items()):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), status).otherwise(out)
    return F.when(low.contains("imput"), "imputed").otherwise(out)


def typed_facts(values: DataFrame, labels: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Rows of ``values`` (ids, keys, kind, raw, mark) with number, text, label and quality.

    ``labels`` has (keys, code, code_label), unique by keys and code. Codes are matched
    trimmed. Blank values are no facts. A negative number with a label is a status, not a
    number; a value of kind number that isn't one is dropped; a mark whose label speaks of
    imputation wins over the value's own label.
    """
    rows = values.withColumn("raw", F.trim("raw")).where("raw <> ''").withColumn("mark", F.trim("mark"))
    rows = rows.join(labels.withColumnsRenamed({"code": "raw", "code_label": "label"}), [*keys, "raw"], "left")
    rows = rows.join(labels.withColumnsRenamed({"code": "mark", "code_label": "mark_label"}), [*keys, "mark"], "left")
    number = F.regexp_replace("raw", ",", "").try_cast("double")
    status = F.coalesce((number < 0) & F.col("label").isNotNull(), F.lit(False))
    numeric = F.col("kind") == "number"
    imputed = ~status & (quality_of_label(F.col("mark_label")) == "imputed")
    return rows.where(status | ~numeric | number.isNotNull()).select(
        *ids, *keys, "raw",
        F.when(numeric & ~status, number).alias("number"),
        F.when(~numeric & ~status, F.col("raw")).alias("text"),
        F.when(F.col("kind") == "label", F.coalesce("label", "raw")).otherwise(F.col("label")).alias("label"),
        F.when(imputed, "imputed").otherwise(quality_of_label(F.col("label"))).alias("quality"),
    )
