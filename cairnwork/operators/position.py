"""Where a student's scores stand at a school, and filters, deduplication and ranking of the schools matched."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwork.functions import scalars as X
from cairnwork.functions.parsing import normalised_name
from cairnwork.operators.places import Order
from cairnwork.operators.ranking import first_per_key

# Orders of the classes, and the classes of institution by code range.
FIT_ORDER = {"strong_academic_fit": 0, "above_range": 1, "in_range": 2, "below_range": 3, "unknown": 4}
OUTLOOK_ORDER = {"likely": 0, "possible": 1, "reach": 2, "high_reach": 3, "unknown": 4}
CARNEGIE = {"associates": (1, 14), "doctoral": (15, 17), "masters": (18, 20), "baccalaureate": (21, 23), "special_focus": (24, 32), "tribal": (33, 33)}
CONTROL = {1: "public", 2: "private_nonprofit", 3: "private_for_profit"}
#: Points above the 75th percentile that count as above the range, and valid scores.
TESTS = {"sat": (100, 400, 1600), "act": (2, 1, 36)}
LOW_SUBMIT, SUPPRESSED, STALE_YEARS = 0.5, 0.15, 3


def _choice(key: Column, values: Mapping) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def control_of(code: Column) -> Column:
    return F.coalesce(_choice(code, CONTROL), F.lit("unknown"))


def carnegie_bucket(code: Column) -> Column:
    out = F.lit("unknown")
    for name, (low, high) in CARNEGIE.items():
        out = F.when(code.between(low, high), name).otherwise(out)
    return out


def policy_signal(sat_rate: Column, act_rate: Column) -> Column:
    """What the greater of the shares of scores sent says about the test policy."""
    most = F.greatest(F.when(~F.isnan(sat_rate), sat_rate), F.when(~F.isnan(act_rate), act_rate))
    return F.when(most.isNull(), "unknown").when(most >= 0.85, "high_submit").when(most <= 0.1, "mostly_non_submitters").otherwise("effective_optional")


def tier(best: Column, rate: Column) -> Column:
    """A class of chance from the better percentile and the admission rate; unknown without either."""
    low = best < 25
    return (
        F.when(best.isNull() | rate.isNull(), "unknown").when((rate < 0.1) | (low & (rate < 0.25)), "long_shot").when(low, "unlikely")
        .when(rate >= 0.5, "likely").when(rate >= 0.25, "strong_fit").otherwise("possible")
    )


def positions(schools: DataFrame, sat: float | None, act: float | None, year: int, gpa: float | None = None) -> DataFrame:
    """``schools`` with sat_percentile, act_percentile, best_percentile, fit, outlook, tier, caveats and rank_score.

    Reads cds_year (text), acceptance_rate, sat_submit_rate, hs_gpa and p25, p50 and p75 of each
    test as sat_p25 and so on. A tier is withheld for scores in the middle half of a school that
    admits under 15%. ``caveats`` are in a fixed order.
    """
    made, anchored, fits = {}, {}, []
    for test, score in (("sat", sat), ("act", act)):
        above, low, high = TESTS[test]
        p25, p50, p75 = (F.col(f"{test}_p{p}").cast("double") for p in (25, 50, 75))
        valid = score is not None and low <= score <= high
        value = F.lit(float(score) if valid else None).cast("double")
        anchored[test] = F.coalesce((p25 <= p50) & (p50 <= p75) & (p25 < p75), F.lit(False))
        made[f"{test}_percentile"] = X.half_up(X.interpolated_percentile(value, p25, p50, p75)).cast("int")
        fits.append(F.when(anchored[test], X.academic_fit(value, p25, p75, above)))
    out = schools.withColumns(made)
    best = F.greatest("sat_percentile", "act_percentile")
    order = F.least(*[_choice(f, FIT_ORDER) for f in fits])
    rate = F.col("acceptance_rate")
    suppressed = F.coalesce((rate < SUPPRESSED) & best.between(25, 75), F.lit(False))
    start = F.regexp_extract("cds_year", "^\\s*(\\d+)", 1).try_cast("int")
    # The names of the caveats.
    notes = [
        F.when(F.lit(year) - start > STALE_YEARS, "stale_cds"),
        *[F.when(~anchored[t] & F.col(f"{t}_p50").isNull(), f"no_{t}_data") for t in anchored],
        F.when((~anchored["sat"] & F.col("sat_p50").isNotNull()) | (~anchored["act"] & F.col("act_p50").isNotNull()), "data_incomplete"),
        F.when(~anchored["sat"] & ~anchored["act"], "no_test_data"),
        F.when(F.coalesce("sat_submit_rate", F.lit(1.0)) < LOW_SUBMIT, "low_sat_submit_rate"),
        F.when(F.lit(all(s is None or not TESTS[t][1] <= s <= TESTS[t][2] for t, s in (("sat", sat), ("act", act)))), "student_not_submitting"),
        F.when(rate.isNull(), "no_admit_rate"),
        F.when(suppressed, "sub_15_admit_rate_suppression"),
    ]
    gap = F.coalesce(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.lit(gpa).cast("double") - F.col("hs_gpa")) * 2)), F.lit(0.0))
    return out.withColumns({
        "best_percentile": best,
        "fit": F.coalesce(_choice(order, {v: k for k, v in FIT_ORDER.items()}), F.lit("unknown")),
        "outlook": X.admissions_outlook(rate),
        "tier": F.when(suppressed, "unknown").otherwise(tier(best, rate)),
        "caveats": F.array_compact(F.array(*notes)),
        "rank_score": F.coalesce(best, F.lit(0)) + F.coalesce(rate, F.lit(0.0)) * 25 + gap,
    })


def admit_band(rate: Column, band: str) -> Column:
    """Whether a rate is in a band: under_25, 25_50 or 50_plus; any other band takes all."""
    tests = {"under_25": rate < 0.25, "25_50": (rate >= 0.25) & (rate < 0.5), "50_plus": rate >= 0.5}
    return F.coalesce(tests[band], F.lit(False)) if band in tests else F.lit(True)


def matching(schools: DataFrame, equal: Mapping[str, str], band: str = "all", current_only: bool = False) -> DataFrame:
    """Schools with test data that have the asked categories (the value all asks for nothing), rate band and, if asked, the latest year of all."""
    kept = schools.where("sat_p50 IS NOT NULL OR act_p50 IS NOT NULL")
    for name, value in equal.items():
        if value != "all":
            kept = kept.where(F.col(name) == value)
    kept = kept.where(admit_band(F.col("acceptance_rate"), band))
    if current_only:  # one row, broadcast
        kept = kept.join(F.broadcast(schools.agg(F.max("year_start").alias("_latest"))), F.expr("year_start = _latest")).drop("_latest")
    return kept


def collapse_aliases(schools: DataFrame, name: str, profile: Sequence[str], official: str, year: str, key: str) -> DataFrame:
    """One row for each school known under several ids: the same normalised name, the same profile and no two different official ids.

    Profiles are equal to six decimals. A row with an official id is preferred, then the later
    year, then the lesser key. Rows without an official id join the least official id of their
    profile; where there are several, that may differ from a pairwise collapse in input order.
    """
    same = [F.coalesce(F.round(F.col(c).cast("double"), 6).cast("string"), F.lit("")) for c in profile]
    keyed = schools.withColumn("_group", F.concat_ws("|", normalised_name(F.col(name)), *same))
    least = F.min(official).over(Window.partitionBy("_group"))
    keyed = keyed.withColumn("_official", F.coalesce(F.col(official), least))
    order = [F.col(official).isNull().asc(), F.desc_nulls_last(year), F.asc(key)]
    return first_per_key(keyed, ["_group", "_official"], order).drop("_group", "_official")


def match_order(sort: str = "fit") -> list[Order]:
    """The order of a match list: fit, then by the mode (admit_rate or name), outlook, selectivity, rank score and name; for ``ranked_overall``."""
    rate, name = F.col("acceptance_rate"), F.col("name").asc()
    first = [(_choice(F.col("fit"), FIT_ORDER), F.asc)]
    if sort == "name":
        return [*first, name]
    if sort == "admit_rate":
        first.append((F.coalesce(rate, F.lit(-1.0)), F.desc))
    return [*first, (_choice(F.col("outlook"), OUTLOOK_ORDER), F.asc), (F.coalesce(rate, F.lit(1.0)), F.asc), F.col("rank_score").desc(), name]
