"""Year-on-year changes of reported values: the kind of each change and how much it matters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Flags of rows that can't be compared, and upper bounds of the prior rate for each selectivity band.
BAD_FLAGS = ("wrong_file", "blank_template", "low_coverage")
BANDS = {"high_selectivity": 0.20, "selective": 0.50, "broad_access": None}


def selectivity_band(rate: Column) -> Column:
    out = F.lit("unknown_selectivity")
    for name, below in reversed(BANDS.items()):
        out = F.when(rate.isNotNull() if below is None else rate < below, name).otherwise(out)
    return out


def producer_family(producer: Column) -> Column:
    """What stands before the first underscore; empty for null."""
    return F.coalesce(F.substring_index(producer, "_", 1), F.lit(""))


def severity(old: Column, new: Column, notable: Mapping[str, Column], major: Mapping[str, Column], least: Column) -> Column:
    """major, notable or watch by the thresholds ``absolute`` and ``relative``; the relative ones need an old value of ``least`` or more.

    A null threshold is never reached.
    """
    size, base = F.abs(new - old), F.abs(old)
    share = F.when((base > 0) & (base >= F.coalesce(least, F.lit(0))), size / base)

    def reached(limits: Mapping[str, Column]) -> Column:
        return F.coalesce(size >= limits["absolute"], F.lit(False)) | F.coalesce(share >= limits["relative"], F.lit(False))

    return F.when(reached(major), "major").when(reached(notable), "notable").otherwise("watch")


def card_changes(pairs: DataFrame) -> DataFrame:
    """``pairs`` whose quality of the strategy card changed between two years, as events ``card_quality_changed``; worse than ok is notable, anything else watch."""
    moved = pairs.where("old_quality IS NOT NULL AND new_quality IS NOT NULL AND old_quality <> new_quality")
    return moved.withColumns({"event": F.lit("card_quality_changed"), "severity": F.when(F.col("old_quality") == "ok", "notable").otherwise("watch")})


def change_events(pairs: DataFrame, rated: Column, weighed: Column) -> DataFrame:
    """``pairs`` with ``event`` and ``severity``; pairs without an event are dropped.

    A pair has old, new, old_flag, new_flag, old_producer, new_producer, old_version,
    new_version, old_format, new_format, old_source, new_source and earlier (reported in a
    year before the old one). ``rated`` tells rates and scores from other values: their loss
    is notable. ``weighed`` is the severity of a change between two values; where the source
    changed it counts as watch.
    """
    had, has = F.col("old").isNotNull(), F.col("new").isNotNull()
    was_bad, is_bad = (F.coalesce(F.col(c).isin(*BAD_FLAGS), F.lit(False)) for c in ("old_flag", "new_flag"))
    alike = (producer_family(F.col("old_producer")) == producer_family(F.col("new_producer"))) & _same("version")
    lost = F.when(alike, "newly_missing").when(_same("format"), "producer_changed").otherwise("format_changed")
    event = (
        F.when(~had & ~has, None)
        .when(is_bad & ~was_bad, "quality_regression")
        .when(was_bad & ~is_bad & has, "quality_recovered")
        .when(was_bad | is_bad, None)
        .when(~has, lost)
        .when(~had, F.when(F.col("earlier"), "reappeared").otherwise("newly_reported"))
        .when(F.col("old") != F.col("new"), "material_delta")
    )
    kept = pairs.withColumn("event", event).where("event IS NOT NULL")
    graded = F.when((F.col("event") == "material_delta") & _same("source"), weighed).when((F.col("event") == "newly_missing") & rated, "notable")
    return kept.withColumn("severity", graded.otherwise("watch"))


def _same(what: str) -> Column:
    return F.coalesce(F.col(f"old_{what}"), F.lit("")) == F.coalesce(F.col(f"new_{what}"), F.lit(""))
