"""Derived admissions figures: totals by schema version, valid ranges, strategy flags and rates of the early and waiting-list funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that add up to a total in each schema version, the field that holds the total itself where a
# part is missing, and groups of fields that are added up instead where the total is missing or zero.
PARTS = {
    "2024-25": {
        "applied": ("C.101", "C.102", "C.103", "C.104"),
        "admitted": ("C.105", "C.106", "C.107", "C.108"),
        "first_year_enrolled": ("C.109", "C.110", "C.111", "C.112", "C.113", "C.114", "C.115", "C.116"),
    },
    "2025-26": {"applied": ("C.116",), "admitted": ("C.117",), "first_year_enrolled": ("C.118",)},
}
TOTALS = {"2024-25": {"applied": "C.117", "admitted": "C.118", "first_year_enrolled": "C.119"}}
GROUPS = {
    "2025-26": {
        "applied": (("C.101", "C.102", "C.103"),),
        "admitted": (("C.104", "C.105", "C.106"),),
        "first_year_enrolled": (("C.107", "C.108", "C.109"), ("C.110", "C.111", "C.112", "C.113", "C.114", "C.115")),
    }
}
# Least and greatest value of each score.
BOUNDS = {"sat_composite": (400, 1600), "sat_ebrw": (200, 800), "sat_math": (200, 800), "act_composite": (1, 36)}
# Weights of a factor that count as important, flags of documents that show nothing, the share of early admits that is high.
IMPORTANT, HIDDEN, HIGH_SHARE = ("important", "very important"), ("wrong_file", "blank_template", "low_coverage"), 0.1951


def total(fields: Column, parts: Sequence[str], whole: str | None = None, groups: Sequence[Sequence[str]] = ()) -> Column:
    """The sum of ``parts`` in a map of numbers by field.

    With no part present it is the first group that has a member; with some missing the
    field ``whole`` if present; otherwise the sum of those present, unless that is zero and
    a group's sum is positive.
    """

    def present(names: Sequence[str]) -> Column:
        return F.filter(F.array(*[fields[n] for n in names]), lambda x: x.isNotNull())

    def added(names: Sequence[str]) -> Column:
        values = present(names)
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x))

    own, other = added(parts), F.coalesce(*[added(g) for g in groups]) if groups else F.lit(None).cast("double")
    gaps = F.size(present(parts)) < len(parts)
    stated = F.when(gaps, fields[whole]) if whole else F.lit(None).cast("double")
    return F.when(own.isNull(), other).otherwise(F.coalesce(stated, F.when((own == 0) & (other > 0), other), own))


def versioned_totals(rows: DataFrame, fields: str = "fields", version: str = "schema_version") -> DataFrame:
    """``rows`` with applied, admitted and first_year_enrolled, computed by the row's schema version; null for other versions.

    ``fields`` is a map from field to number; fields that didn't parse are absent or null.
    """
    for name in ("applied", "admitted", "first_year_enrolled"):
        out = F.lit(None).cast("double")
        for v, parts in PARTS.items():
            out = F.when(F.col(version) == v, total(F.col(fields), parts[name], TOTALS.get(v, {}).get(name), GROUPS.get(v, {}).get(name, ()))).otherwise(out)
        rows = rows.withColumn(name, out)
    return rows


def by_version(fields: Column, version: Column, ids: Mapping[str, str]) -> Column:
    """The value of the field that a schema version keeps a metric in: a pivot whose field depends on the version."""
    out = F.lit(None)
    for v, field in ids.items():
        out = F.when(version == v, fields[field]).otherwise(out)
    return out


def value_status(value: Column, least: float | None = None, most: float | None = None, whole: bool = False) -> Column:
    """reported, or parse_error for a value outside its bounds or with a fraction where it must be whole; missing for null."""
    tests = [t for t in (whole and (value != F.floor(value)), least is not None and (value < least), most is not None and (value > most)) if t is not False]
    wrong = reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    return F.when(value.isNull(), "missing").when(wrong, "parse_error").otherwise("reported")


def _yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def strategy(rows: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``rows`` with ed_inconsistent, wait_inconsistent, ed_effective, wait_effective and quality.

    Reads ed_offered, ed_applicants, ed_admitted, ea_offered, admitted, yield_rate,
    wait_policy, wait_offered, wait_accepted, wait_admitted and the columns ``factors``
    (weights in words). Counts are inconsistent if one is negative or exceeds the count that
    it is a part of. A plan counts as offered if that is said or if its counts show it.
    """
    c = F.col
    ed_known, ed_any = c("ed_applicants").isNotNull() & c("ed_admitted").isNotNull(), c("ed_applicants") > 0
    ed_wrong = ed_known & ((c("ed_applicants") < 0) | (c("ed_admitted") < 0) | (c("ed_admitted") > c("ed_applicants")) | ((c("admitted") > 0) & (c("ed_admitted") > c("admitted"))))
    first = (c("wait_offered") < 0) | (c("wait_accepted") < 0) | (c("wait_accepted") > c("wait_offered"))
    second = (c("wait_admitted") < 0) | (c("wait_admitted") > c("wait_accepted"))
    wait_wrong = (c("wait_offered").isNotNull() & c("wait_accepted").isNotNull() & first) | (c("wait_accepted").isNotNull() & c("wait_admitted").isNotNull() & second)
    counts = c("wait_offered").isNotNull() & c("wait_accepted").isNotNull() & c("wait_admitted").isNotNull()
    out = rows.withColumns({"ed_inconsistent": _yes(ed_wrong), "wait_inconsistent": _yes(wait_wrong)})
    ed_shown, wait_shown = _yes(ed_any & ed_known & ~c("ed_inconsistent")), _yes(counts & ~c("wait_inconsistent"))
    weighty = reduce(lambda a, b: a | b, [_yes(F.lower(f).isin(*IMPORTANT)) for f in factors], F.lit(False))
    useful = ed_shown | c("yield_rate").isNotNull() | wait_shown | weighty | _yes(c("ea_offered"))
    quality = F.when(c("ed_inconsistent"), "ed_math_inconsistent").when(c("wait_inconsistent"), "wait_list_math_inconsistent").when(~useful, "insufficient_data").otherwise("ok")
    return out.withColumns({"ed_effective": _yes(c("ed_offered")) | ed_shown, "wait_effective": _yes(c("wait_policy")) | wait_shown, "quality": quality})


def _rate(part: Column, whole: Column) -> Column:
    """part / whole; null without both, for a whole of 0 or less and for a negative part."""
    return F.when((whole > 0) & (part >= 0), part / whole)


def funnel_rates(rows: DataFrame) -> DataFrame:
    """``rows`` with the rates of early admission, of all other applicants and of the waiting list.

    Reads applied, admitted, enrolled, ed_applicants, ed_admitted, wait_policy, wait_offered,
    wait_accepted, wait_admitted and quality. The early ones among those enrolled are taken to
    be as many as were admitted early, at most all. Rates of inconsistent counts are null.
    """
    c, none = F.col, F.lit(None)
    early = _yes((F.coalesce("quality", F.lit("")) != "ed_math_inconsistent") & (c("ed_applicants") > 0) & (c("ed_admitted") <= c("ed_applicants")))
    odd = (c("quality") == "wait_list_math_inconsistent") | (c("wait_accepted") > c("wait_offered")) | (c("wait_admitted") > c("wait_accepted"))
    counts = c("wait_offered").isNotNull() & c("wait_accepted").isNotNull() & c("wait_admitted").isNotNull()
    rows = rows.withColumns({"_early": early, "wait_anomalous": _yes(odd), "wait_counts_missing": _yes(c("wait_policy")) & ~counts})
    waiting = (_yes(c("wait_policy")) | counts) & ~c("wait_anomalous")
    rows = rows.withColumns({
        "ed_rate": F.when(c("_early"), _rate(c("ed_admitted"), c("ed_applicants"))),
        "other_rate": F.when(c("_early") & (c("applied") > c("ed_applicants")), _rate(c("admitted") - c("ed_admitted"), c("applied") - c("ed_applicants"))),
        "ed_share_of_admitted": F.when(c("_early"), _rate(c("ed_admitted"), c("admitted"))),
        "other_applicants": F.when(c("_early") & (c("applied") >= c("ed_applicants")), c("applied") - c("ed_applicants")),
        "other_admitted": F.when(c("_early") & (c("admitted") >= c("ed_admitted")), c("admitted") - c("ed_admitted")),
        "ed_enrolled": F.when(c("_early") & c("enrolled").isNotNull(), F.least("ed_admitted", "enrolled")),
        "wait_offer_rate": F.when(waiting, _rate(c("wait_offered"), c("applied"))),
        "wait_opt_in_rate": F.when(waiting, _rate(c("wait_accepted"), c("wait_offered"))),
        "wait_admit_rate": F.when(waiting, _rate(c("wait_admitted"), c("wait_accepted"))),
    })
    rows = rows.withColumn("other_enrolled", F.when(c("ed_enrolled").isNotNull(), F.greatest(c("enrolled") - c("ed_enrolled"), F.lit(0))))
    return rows.withColumns({
        "ed_share_of_class": F.when(c("ed_enrolled").isNotNull(), _rate(c("ed_enrolled"), c("enrolled"))),
        "other_yield": F.when(c("other_admitted").isNotNull(), _rate(c("other_enrolled"), c("other_admitted"))),
        "ed_multiple": F.when(c("other_rate") > 0, c("ed_rate") / c("other_rate")).otherwise(none),
        "high_ed_share": _yes(c("ed_share_of_admitted") >= HIGH_SHARE),
    }).drop("_early")


def renderable(flag: Column, quality: Column, signals: Sequence[Column]) -> Column:
    """Whether a card has something to show: its document isn't a hidden one, its data suffice, and any of ``signals`` holds."""
    some = reduce(lambda a, b: a | b, [_yes(s) for s in signals], F.lit(False))
    return ~_yes(flag.isin(*HIDDEN)) & (F.coalesce(quality, F.lit("")) != "insufficient_data") & some


def withheld(rows: DataFrame) -> DataFrame:
    """``rows`` with applied, admitted and enrolled null where more were admitted than applied or more enrolled than admitted."""
    bad = _yes(F.col("admitted") > F.col("applied")) | _yes(F.col("enrolled") > F.col("admitted"))
    return rows.withColumn("_bad", bad).withColumns({n: F.when(~F.col("_bad"), F.col(n)) for n in ("applied", "admitted", "enrolled")}).drop("_bad")


def waitlist_anomaly(base: Column, rate: Column, least: int = 100, share: float = 0.95) -> Column:
    """Whether a waiting-list rate is too high to be believed for so many people."""
    return _yes((base >= least) & (rate >= share))
