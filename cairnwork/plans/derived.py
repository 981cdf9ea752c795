"""Queries of derived admissions figures and of positions and match lists. Inputs are made by expressions that both dialects read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.operators import admissions as M
from cairnwork.operators import filters as L
from cairnwork.operators import position as S
from cairnwork.plans.registry import query
from cairnwork.storage import load


def bound(df, columns):
    """The named columns of ``df``, each by an expression."""
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def sql(columns, table):
    return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table})"


# the fields C.101 to C.119 of a form, some absent
FIELDS = {f"C.{101 + i}": f"CASE WHEN (c_custkey + {i}) % {3 + i % 4} > 0 THEN CAST((c_custkey * {i + 3}) % 50 AS DOUBLE) END" for i in range(19)}
VERSION = "CASE c_custkey % 3 WHEN 0 THEN '2024-25' WHEN 1 THEN '2025-26' ELSE '2019-20' END"


def _total(parts, whole, groups):
    added = lambda names: " + ".join(f'coalesce("{n}", 0)' for n in names)
    none = lambda names: " AND ".join(f'"{n}" IS NULL' for n in names)
    some = " OR ".join(f'"{n}" IS NULL' for n in parts)
    other = "coalesce(" + ", ".join(f"CASE WHEN NOT ({none(g)}) THEN {added(g)} END" for g in groups) + ", NULL)" if groups else "NULL::DOUBLE"
    stated = f'WHEN ({some}) AND "{whole}" IS NOT NULL THEN "{whole}"' if whole else ""
    return f"CASE WHEN {none(parts)} THEN {other} {stated} WHEN {added(parts)} = 0 AND {other} > 0 THEN {other} ELSE {added(parts)} END"


def _totals_sql():
    made = ", ".join(f'{e} AS "{n}"' for n, e in FIELDS.items())
    out = ", ".join(
        "CASE v " + " ".join(f"WHEN '{v}' THEN {_total(p[name], M.TOTALS.get(v, {}).get(name), M.GROUPS.get(v, {}).get(name, ()))}" for v, p in M.PARTS.items()) + f" END AS {name}" for name in ("applied", "admitted", "first_year_enrolled")
    )
    return f"SELECT c_custkey, {out} FROM (SELECT c_custkey, {VERSION} AS v, {made} FROM customer)"


@query("D_01_versioned_totals", _totals_sql())
def _(s, d):
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.expr(e).alias("value")) for n, e in FIELDS.items()])
    rows = load(s, d, "customer").select("c_custkey", F.expr(VERSION).alias("schema_version"), F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull())).alias("fields"))
    return M.versioned_totals(rows).select("c_custkey", "applied", "admitted", "first_year_enrolled")


@query("A_04_pivot_by_version", f'SELECT c_custkey, CASE {VERSION} WHEN \'2024-25\' THEN "C.106" WHEN \'2025-26\' THEN "C.110" END AS early FROM (SELECT c_custkey, {", ".join(f"""{e} AS "{n}" """ for n, e in FIELDS.items())} FROM customer)')
def _(s, d):
    fields = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), F.expr(e).alias("value")) for n, e in FIELDS.items()]))
    return load(s, d, "customer").select("c_custkey", M.by_version(fields, F.expr(VERSION), {"2024-25": "C.106", "2025-26": "C.110"}).alias("early"))


@query("D_03_value_status", "SELECT p_partkey, CASE WHEN v IS NULL THEN 'missing' WHEN v <> floor(v) OR v < 400 OR v > 1600 THEN 'parse_error' ELSE 'reported' END AS status FROM (SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN p_partkey % 1500 + 300 + CASE WHEN p_size % 5 = 0 THEN 0.5 ELSE 0.0 END END AS v FROM part)")
def _(s, d):
    value = F.expr("CASE WHEN p_size % 7 > 0 THEN p_partkey % 1500 + 300 + CASE WHEN p_size % 5 = 0 THEN 0.5 ELSE 0.0 END END").cast("double")
    return load(s, d, "part").select("p_partkey", M.value_status(value, *M.BOUNDS["sat_composite"], whole=True).alias("status"))


CYCLE = {
    "id": "c_custkey", "applied": "CASE WHEN c_custkey % 11 > 0 THEN CAST(c_custkey % 900 + 100 AS DOUBLE) END", "admitted": "CASE WHEN c_custkey % 13 > 0 THEN CAST(c_custkey % 400 + 20 AS DOUBLE) END",
    "enrolled": "CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey % 150 AS DOUBLE) END", "ed_offered": "CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 END",
    "ed_applicants": "CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 300 - 5 AS DOUBLE) END", "ed_admitted": "CASE WHEN c_custkey % 6 > 0 THEN CAST(c_custkey % 170 AS DOUBLE) END",
    "ea_offered": "CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 8 = 0 END", "yield_rate": "CASE WHEN c_custkey % 9 = 0 THEN 0.5 END", "wait_policy": "CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 = 0 END",
    "wait_offered": "CASE WHEN c_custkey % 8 > 0 THEN CAST(c_custkey % 90 AS DOUBLE) END", "wait_accepted": "CASE WHEN c_custkey % 10 > 0 THEN CAST(c_custkey % 60 AS DOUBLE) END",
    "wait_admitted": "CASE WHEN c_custkey % 12 > 0 THEN CAST(c_custkey % 50 AS DOUBLE) END", "legacy": "CASE c_nationkey % 4 WHEN 0 THEN 'Important' WHEN 1 THEN 'Considered' WHEN 2 THEN 'Very Important' END",
}
STRATEGY_SQL = f"""
    SELECT *, coalesce(ed_offered, false) OR ed_shown AS ed_effective, coalesce(wait_policy, false) OR wait_shown AS wait_effective, CASE WHEN ed_bad THEN 'ed_math_inconsistent' WHEN wait_bad THEN 'wait_list_math_inconsistent'
        WHEN NOT (ed_shown OR yield_rate IS NOT NULL OR wait_shown OR coalesce(lower(legacy) IN ('important', 'very important'), false) OR coalesce(ea_offered, false)) THEN 'insufficient_data' ELSE 'ok' END AS quality
    FROM (SELECT *, coalesce(ed_applicants > 0 AND ed_admitted IS NOT NULL AND NOT ed_bad, false) AS ed_shown, wait_offered IS NOT NULL AND wait_accepted IS NOT NULL AND wait_admitted IS NOT NULL AND NOT wait_bad AS wait_shown FROM (
    SELECT *, coalesce(ed_applicants < 0 OR ed_admitted < 0 OR ed_admitted > ed_applicants OR (admitted > 0 AND ed_admitted > admitted), false) AND ed_applicants IS NOT NULL AND ed_admitted IS NOT NULL AS ed_bad,
        (wait_offered IS NOT NULL AND wait_accepted IS NOT NULL AND wait_accepted > wait_offered) OR (wait_accepted IS NOT NULL AND wait_admitted IS NOT NULL AND wait_admitted > wait_accepted) AS wait_bad FROM {sql(CYCLE, "customer")}))"""


@query("D_04_strategy", f"SELECT id, ed_bad AS ed_inconsistent, wait_bad AS wait_inconsistent, ed_effective, wait_effective, quality FROM ({STRATEGY_SQL})")
def _(s, d):
    return M.strategy(bound(load(s, d, "customer"), CYCLE), ["legacy"]).select("id", "ed_inconsistent", "wait_inconsistent", "ed_effective", "wait_effective", "quality")


@query("D_05_funnel_rates", f"""
    SELECT id, round(ed_rate, 9) AS ed_rate, round(other_rate, 9) AS other_rate, round(CASE WHEN other_rate > 0 THEN ed_rate / other_rate END, 6) AS ed_multiple, round(CASE WHEN e AND admitted > 0 AND ed_admitted >= 0 THEN ed_admitted / admitted END, 9) AS ed_share_of_admitted,
        round(CASE WHEN e AND enrolled > 0 THEN least(ed_admitted, enrolled) / enrolled END, 9) AS ed_share_of_class, round(CASE WHEN e AND enrolled IS NOT NULL AND admitted - ed_admitted > 0 THEN greatest(enrolled - least(ed_admitted, enrolled), 0) / (admitted - ed_admitted) END, 9) AS other_yield,
        round(CASE WHEN w AND applied > 0 THEN wait_offered / applied END, 9) AS wait_offer_rate, round(CASE WHEN w AND wait_offered > 0 THEN wait_accepted / wait_offered END, 9) AS wait_opt_in_rate, round(CASE WHEN w AND wait_accepted > 0 THEN wait_admitted / wait_accepted END, 9) AS wait_admit_rate,
        odd AS wait_anomalous, coalesce(wait_policy, false) AND NOT full_counts AS wait_counts_missing, coalesce(e AND admitted > 0 AND ed_admitted / admitted >= 0.1951, false) AS high_ed_share
    FROM (SELECT *, CASE WHEN e THEN ed_admitted / ed_applicants END AS ed_rate, CASE WHEN e AND applied > ed_applicants AND admitted >= ed_admitted THEN (admitted - ed_admitted) / (applied - ed_applicants) END AS other_rate, (coalesce(wait_policy, false) OR full_counts) AND NOT odd AS w FROM (
    SELECT *, coalesce(quality <> 'ed_math_inconsistent' AND ed_applicants > 0 AND ed_admitted <= ed_applicants, false) AS e, wait_offered IS NOT NULL AND wait_accepted IS NOT NULL AND wait_admitted IS NOT NULL AS full_counts,
        quality = 'wait_list_math_inconsistent' OR coalesce(wait_accepted > wait_offered, false) OR coalesce(wait_admitted > wait_accepted, false) AS odd FROM ({STRATEGY_SQL})))""")
def _(s, d):
    rows = M.funnel_rates(M.strategy(bound(load(s, d, "customer"), CYCLE), ["legacy"]))
    shares = ("ed_rate", "other_rate", "ed_share_of_admitted", "ed_share_of_class", "other_yield", "wait_offer_rate", "wait_opt_in_rate", "wait_admit_rate")
    return rows.select("id", *[F.round(c, 9).alias(c) for c in shares], F.round("ed_multiple", 6).alias("ed_multiple"), "wait_anomalous", "wait_counts_missing", "high_ed_share")


@query("F_14_withheld_counts", f"SELECT id, CASE WHEN NOT bad THEN applied END AS applied, CASE WHEN NOT bad THEN admitted END AS admitted, CASE WHEN NOT bad THEN enrolled END AS enrolled FROM (SELECT *, coalesce(admitted > applied, false) OR coalesce(enrolled > admitted, false) AS bad FROM {sql(CYCLE, 'customer')})")
def _(s, d):
    return M.withheld(bound(load(s, d, "customer"), CYCLE)).select("id", "applied", "admitted", "enrolled")


@query("D_25_waitlist_anomaly", f"SELECT id, coalesce(wait_offered >= 40 AND wait_accepted / wait_offered >= 0.95, false) AS odd FROM {sql(CYCLE, 'customer')}")
def _(s, d):
    return bound(load(s, d, "customer"), CYCLE).select("id", M.waitlist_anomaly(F.col("wait_offered"), F.try_divide("wait_accepted", "wait_offered"), 40).alias("odd"))


@query("A_12_first_wins_split", f"""
    SELECT k, count(*) FILTER (WHERE odd) AS anomalous, count(*) FILTER (WHERE NOT odd) AS usable FROM (SELECT id % 50 AS k, coalesce(wait_offered >= 40 AND wait_accepted / wait_offered >= 0.95, false) AS odd FROM {sql(CYCLE, 'customer')} QUALIFY row_number() OVER (PARTITION BY id % 50, enrolled ORDER BY id) = 1) GROUP BY 1""")
def _(s, d):
    from cairnwork.operators.ranking import first_per_key

    rows = bound(load(s, d, "customer"), CYCLE).withColumn("k", F.col("id") % 50)
    odd = M.waitlist_anomaly(F.col("wait_offered"), F.try_divide("wait_accepted", "wait_offered"), 40)
    return first_per_key(rows, ["k", "enrolled"], [F.asc("id")]).withColumn("odd", odd).groupBy("k").agg(F.count_if("odd").alias("anomalous"), F.count_if(~F.col("odd")).alias("usable"))


MERIT = "SELECT id, CASE WHEN applied > 0 AND wait_offered IS NOT NULL THEN round(wait_offered / applied, 9) END AS share, CASE WHEN n >= 4 AND enrolled IS NOT NULL THEN 'strong' WHEN n >= 3 THEN 'partial' WHEN n > 0 THEN 'limited' ELSE 'missing' END AS tier FROM (SELECT *, CAST(applied IS NOT NULL AS INTEGER) + CAST(admitted IS NOT NULL AND id % 2 = 0 AS INTEGER) + CAST(ed_admitted IS NOT NULL AND id % 2 = 0 AS INTEGER) + CAST(wait_offered IS NOT NULL AND id % 3 = 0 AS INTEGER) AS n FROM {})"


@query("D_09_merit_tier", MERIT.format(sql(CYCLE, "customer")))
def _(s, d):
    rows = bound(load(s, d, "customer"), CYCLE)
    known = [F.col("applied").isNotNull(), F.col("admitted").isNotNull() & (F.col("id") % 2 == 0), F.col("ed_admitted").isNotNull() & (F.col("id") % 2 == 0), F.col("wait_offered").isNotNull() & (F.col("id") % 3 == 0)]
    n = sum((k.cast("int") for k in known), F.lit(0))
    tier = L.first_reason([((n >= 4) & F.col("enrolled").isNotNull(), "strong"), (n >= 3, "partial"), (n > 0, "limited")], "missing")
    return rows.select("id", F.round(F.when(F.col("applied") > 0, F.col("wait_offered") / F.col("applied")), 9).alias("share"), tier.alias("tier"))


SCHOOL = {
    "id": "p_partkey", "name": "p_name", "official": "CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 40 END", "year_start": "CAST(2020 + p_partkey % 6 AS INTEGER)", "cds_year": "concat(CAST(2020 + p_partkey % 6 AS VARCHAR(10)), '-xx')",
    "acceptance_rate": "CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 64) / 64.0 END", "sat_submit_rate": "CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 32) / 32.0 END", "act_submit_rate": "CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 16) / 16.0 END",
    "hs_gpa": "CASE WHEN p_partkey % 2 = 0 THEN 3.0 + (p_partkey % 8) / 8.0 END", "sat_p25": "CASE WHEN p_size % 6 > 0 THEN 800.0 + p_size * 8 END", "sat_p50": "CASE WHEN p_size % 6 <> 1 THEN 900.0 + p_size * 8 - p_partkey % 4 * 40 END",
    "sat_p75": "CASE WHEN p_size % 8 > 0 THEN 1000.0 + p_size * 8 END", "act_p25": "CASE WHEN p_size % 4 > 0 THEN 18.0 + p_size % 5 END", "act_p50": "20.0 + p_size % 7", "act_p75": "CASE WHEN p_size % 9 > 0 THEN 24.0 + p_size % 8 END",
    "control": "CAST(p_partkey % 5 AS INTEGER)", "class": "CAST(p_partkey % 36 AS INTEGER)",
}


@query("D_15_buckets", f"""
    SELECT id, CASE control WHEN 1 THEN 'public' WHEN 2 THEN 'private_nonprofit' WHEN 3 THEN 'private_for_profit' ELSE 'unknown' END AS control, CASE WHEN class BETWEEN 15 AND 17 THEN 'doctoral' WHEN class BETWEEN 18 AND 20 THEN 'masters' WHEN class BETWEEN 21 AND 23 THEN 'baccalaureate' WHEN class BETWEEN 1 AND 14 THEN 'associates' WHEN class BETWEEN 24 AND 32 THEN 'special_focus' WHEN class = 33 THEN 'tribal' ELSE 'unknown' END AS class,
        CASE WHEN m IS NULL THEN 'unknown' WHEN m >= 0.85 THEN 'high_submit' WHEN m <= 0.1 THEN 'mostly_non_submitters' ELSE 'effective_optional' END AS policy FROM (SELECT *, greatest(sat_submit_rate, act_submit_rate) AS m FROM {sql(SCHOOL, 'part')})""")
def _(s, d):
    rows = bound(load(s, d, "part"), SCHOOL)
    return rows.select("id", S.control_of(F.col("control")).alias("control"), S.carnegie_bucket(F.col("class")).alias("class"), S.policy_signal(F.col("sat_submit_rate").cast("double"), F.col("act_submit_rate").cast("double")).alias("policy"))


def _pct(v, t):
    a, b, c = (f"{t}_p{p}" for p in (25, 50, 75))
    return f"CASE WHEN {a} <= {b} AND {b} <= {c} AND {a} < {c} THEN floor(CASE WHEN {v} <= {a} THEN greatest(5.0, 25 - ({a} - {v}) / greatest(1.0, {b} - {a}) * 25) WHEN {v} <= {b} THEN least(50.0, 25 + ({v} - {a}) / greatest(1.0, {b} - {a}) * 25) WHEN {v} <= {c} THEN least(75.0, 50 + ({v} - {b}) / greatest(1.0, {c} - {b}) * 25) ELSE least(95.0, 75 + ({v} - {c}) / greatest(1.0, {c} - {b}) * 25) END + 0.5) END"


def _fit(v, t, above):
    a, b, c = (f"{t}_p{p}" for p in (25, 50, 75))
    return f"CASE WHEN {a} <= {b} AND {b} <= {c} AND {a} < {c} THEN CASE WHEN {v} >= {c} + {above} THEN 1 WHEN {v} >= {c} THEN 0 WHEN {v} >= {a} THEN 2 ELSE 3 END END"


POSITION_SQL = f"""
    SELECT *, CASE WHEN low THEN 'unknown' WHEN best IS NULL OR r IS NULL THEN 'unknown' WHEN r < 0.1 OR (best < 25 AND r < 0.25) THEN 'long_shot' WHEN best < 25 THEN 'unlikely' WHEN r >= 0.5 THEN 'likely' WHEN r >= 0.25 THEN 'strong_fit' ELSE 'possible' END AS tier,
        coalesce(best, 0) + coalesce(r, 0) * 25 + coalesce(greatest(-2.0, least(2.0, (3.5 - hs_gpa) * 2)), 0) AS rank_score, CASE least(sf, af) WHEN 0 THEN 'strong_academic_fit' WHEN 1 THEN 'above_range' WHEN 2 THEN 'in_range' WHEN 3 THEN 'below_range' ELSE 'unknown' END AS fit,
        CASE WHEN r IS NULL THEN 'unknown' WHEN r < 0.1 THEN 'high_reach' WHEN r < 0.25 THEN 'reach' WHEN r < 0.5 THEN 'possible' ELSE 'likely' END AS outlook
    FROM (SELECT *, greatest(sp, ap) AS best, coalesce(r < 0.15 AND greatest(sp, ap) BETWEEN 25 AND 75, false) AS low FROM (SELECT *, acceptance_rate AS r, {_pct(1100.0, 'sat')} AS sp, {_pct(26.0, 'act')} AS ap, {_fit(1100.0, 'sat', 100)} AS sf, {_fit(26.0, 'act', 2)} AS af,
        coalesce(sat_p25 <= sat_p50 AND sat_p50 <= sat_p75 AND sat_p25 < sat_p75, false) AS sk, coalesce(act_p25 <= act_p50 AND act_p50 <= act_p75 AND act_p25 < act_p75, false) AS ak FROM {sql(SCHOOL, 'part')}))"""


@query("D_14_positions", f"""
    SELECT id, CAST(sp AS DOUBLE) AS sat_percentile, CAST(ap AS DOUBLE) AS act_percentile, tier, fit, outlook, array_to_string(list_filter([CASE WHEN 2026 - year_start > 3 THEN 'stale_cds' END, CASE WHEN NOT sk AND sat_p50 IS NULL THEN 'no_sat_data' END, CASE WHEN NOT ak AND act_p50 IS NULL THEN 'no_act_data' END,
        CASE WHEN (NOT sk AND sat_p50 IS NOT NULL) OR (NOT ak AND act_p50 IS NOT NULL) THEN 'data_incomplete' END, CASE WHEN NOT sk AND NOT ak THEN 'no_test_data' END, CASE WHEN sat_submit_rate < 0.5 THEN 'low_sat_submit_rate' END, CASE WHEN r IS NULL THEN 'no_admit_rate' END, CASE WHEN low THEN 'sub_15_admit_rate_suppression' END], lambda x: x IS NOT NULL), ',') AS caveats FROM ({POSITION_SQL})""")
def _(s, d):
    rows = S.positions(bound(load(s, d, "part"), SCHOOL), 1100, 26, 2026, 3.5)
    return rows.select("id", F.col("sat_percentile").cast("double").alias("sat_percentile"), F.col("act_percentile").cast("double").alias("act_percentile"), "tier", "fit", "outlook", F.array_join("caveats", ",").alias("caveats"))


@query("D_16_rank_score", f"SELECT id, round(CAST(rank_score AS DOUBLE), 6) AS score FROM ({POSITION_SQL})")
def _(s, d):
    return S.positions(bound(load(s, d, "part"), SCHOOL), 1100, 26, 2026, 3.5).select("id", F.round(F.col("rank_score").cast("double"), 6).alias("score"))


@query("D_13_tier", f"SELECT tier, count(*) AS n FROM ({POSITION_SQL}) GROUP BY 1")
def _(s, d):
    return S.positions(bound(load(s, d, "part"), SCHOOL), 1100, 26, 2026, 3.5).groupBy("tier").agg(F.count("*").alias("n"))


@query("F_10_match_filters", f"""
    SELECT id FROM {sql(SCHOOL, 'part')} WHERE (sat_p50 IS NOT NULL OR act_p50 IS NOT NULL) AND control = 1 AND acceptance_rate >= 0.25 AND acceptance_rate < 0.5 AND year_start = (SELECT max(year_start) FROM {sql(SCHOOL, 'part')})""")
def _(s, d):
    return S.matching(bound(load(s, d, "part"), SCHOOL), {"control": 1, "class": "all"}, "25_50", current_only=True).select("id")


@query("W_23_collapsed_aliases", f"""
    WITH k AS (SELECT *, lower(name) AS g, round(CAST(acceptance_rate AS DOUBLE), 6) AS a FROM (SELECT id, official, year_start, name, CASE WHEN year_start > 2022 THEN 0.5 ELSE 0.25 END AS acceptance_rate FROM {sql(SCHOOL, 'part')}))
    SELECT id FROM (SELECT *, coalesce(official, min(official) OVER (PARTITION BY g, a)) AS o FROM k) QUALIFY row_number() OVER (PARTITION BY g, a, o ORDER BY official IS NULL, year_start DESC, id) = 1""")
def _(s, d):
    rows = bound(load(s, d, "part"), SCHOOL).withColumn("acceptance_rate", F.when(F.col("year_start") > 2022, 0.5).otherwise(0.25))
    return S.collapse_aliases(rows, "name", ["acceptance_rate"], "official", "year_start", "id").select("id")


ORDER_SQL = "CASE fit WHEN 'strong_academic_fit' THEN 0 WHEN 'above_range' THEN 1 WHEN 'in_range' THEN 2 WHEN 'below_range' THEN 3 ELSE 4 END, {}CASE outlook WHEN 'likely' THEN 0 WHEN 'possible' THEN 1 WHEN 'reach' THEN 2 WHEN 'high_reach' THEN 3 ELSE 4 END, coalesce(r, 1), rank_score DESC, name, id"


@query("L_05_match_order", f"SELECT id, row_number() OVER (ORDER BY {ORDER_SQL.format('coalesce(r, -1) DESC, ')}) AS place FROM ({POSITION_SQL})")
def _(s, d):
    from cairnwork.operators.ranking import ranked_overall

    rows = S.positions(bound(load(s, d, "part"), SCHOOL), 1100, 26, 2026, 3.5)
    return ranked_overall(rows, [*S.match_order("admit_rate"), F.asc("id")], "place").select("id", "place")


@query("F_04_search_fields", "SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND p_name <> ''")
def _(s, d):
    search = L.Search(load(s, d, "part"), ["p_partkey", "p_name", "p_size"])
    return search.rows([("p_size", ">", 10), ("p_name", "is not blank", None)], ["p_partkey", "p_name"])


@query("F_06_required_funnel", f"""
    SELECT count(*) AS in_scope, count(*) FILTER (WHERE sat_p50 IS NOT NULL AND acceptance_rate IS NOT NULL) AS with_required, count(*) FILTER (WHERE sat_p50 IS NOT NULL AND acceptance_rate IS NOT NULL AND NOT (sat_p50 > 1000 AND acceptance_rate <= 0.5 AND act_p25 IS NULL)) AS failing,
        count(*) FILTER (WHERE sat_p50 > 1000 AND acceptance_rate <= 0.5 AND act_p25 IS NULL) AS passing FROM {sql(SCHOOL, 'part')}""")
def _(s, d):
    search = L.Search(bound(load(s, d, "part"), SCHOOL), list(SCHOOL))
    return search.counts([("sat_p50", ">", 1000), ("acceptance_rate", "<=", 0.5), ("act_p25", "is blank", None)])


@query("F_08_companion_counts", f"""
    SELECT 'sat_p50' AS field, 'sat_submit_rate' AS companion, true AS compared, count(*) AS with_value, count(sat_submit_rate) AS with_companion, count(*) - count(sat_submit_rate) AS without_companion FROM {sql(SCHOOL, 'part')} WHERE sat_p50 IS NOT NULL AND act_p75 IS NOT NULL
    UNION ALL SELECT 'act_p75', 'act_submit_rate', false, count(*), count(act_submit_rate), count(*) - count(act_submit_rate) FROM {sql(SCHOOL, 'part')} WHERE sat_p50 IS NOT NULL AND act_p75 IS NOT NULL""")
def _(s, d):
    search = L.Search(bound(load(s, d, "part"), SCHOOL), list(SCHOOL), {"sat_p50": "sat_submit_rate", "act_p75": "act_submit_rate"})
    return search.companion_counts([("sat_p50", ">=", 900), ("act_p75", "is not blank", None)])
