"""Queries of the recommender: users answer through their events, suppliers are the schools."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.operators import recommend as R
from cairnwork.operators.lookups import mapped
from cairnwork.plans.registry import query
from cairnwork.storage import load

WEIGHTS = {"purchase": 2, "click": 1, "view": -1, "error": -2, "signup": 0}
CARDS = [(i, [f"k{i % 4}", f"k{i % 3 + 4}"]) for i in range(10)]
CARDS_SQL = "(VALUES " + ", ".join(f"({i}, {keys})" for i, keys in CARDS) + ") c(card_id, keys)"
CARD_SQL = f"""SELECT user_id AS session, 'card:' || c.card_id || ':' || k AS signal_id, k AS key, w > 0 AS seeks, abs(w) AS magnitude, abs(w) >= 2 AS essential FROM (SELECT user_id, card_id, w, unnest(keys) AS k FROM
    (SELECT user_id, event_id % 10 AS card, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'view' THEN -1 WHEN 'error' THEN -2 ELSE 0 END AS w FROM events) e JOIN {CARDS_SQL} ON c.card_id = e.card WHERE w <> 0) c"""
REACTION_SQL = """SELECT user_id AS session, 'reaction:' || school || ':' || key AS signal_id, key, reaction = 'more_like_this' AS seeks, 1 AS magnitude, false AS essential FROM (
    SELECT user_id, event_id % 7 AS school, 'k' || event_id % 5 AS key, CASE event_type WHEN 'purchase' THEN 'more_like_this' WHEN 'error' THEN 'not_for_me' ELSE 'research_next' END AS reaction, ts, event_id FROM events)
    WHERE reaction <> 'research_next' QUALIFY row_number() OVER (PARTITION BY user_id, school, key ORDER BY ts DESC, event_id DESC) = 1"""
TOTALS_SQL = f"SELECT session, key, CASE WHEN bool_or(seeks) AND NOT bool_and(seeks) THEN 0 ELSE CAST(greatest(-4, least(4, sum(CASE WHEN seeks THEN magnitude ELSE -magnitude END))) AS INTEGER) END AS total, bool_or(seeks) AND NOT bool_and(seeks) AS conflicted FROM ({CARD_SQL} UNION ALL {REACTION_SQL}) GROUP BY 1, 2"


def _cards(s, d):
    responses = load(s, d, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 10).cast("int").alias("card_id"), F.col("event_type").alias("bucket"))
    return R.card_signals(responses, s.createDataFrame(CARDS, "card_id int, keys array<string>"), WEIGHTS)


def _reactions(s, d):
    kind = F.coalesce(mapped(F.col("event_type"), {"purchase": "more_like_this", "error": "not_for_me"}), F.lit("research_next"))
    k = F.col("event_id")
    return load(s, d, "events").select(F.col("user_id").alias("session"), (k % 7).alias("school_id"), F.concat(F.lit("k"), (k % 5).cast("string")).alias("key"), kind.alias("reaction"), F.struct("ts", "event_id").alias("at"))


def _totals(s, d):
    return R.totals(_cards(s, d).unionByName(R.reaction_signals(_reactions(s, d))))


@query("P_01_card_signals", CARD_SQL)
def _(s, d):
    return _cards(s, d)


@query("P_02_reaction_signals", REACTION_SQL)
def _(s, d):
    return R.reaction_signals(_reactions(s, d))


@query("P_03_totals", TOTALS_SQL)
def _(s, d):
    return _totals(s, d)


POLICY = {
    "k0": {"kind": "numeric_band", "evidence": ["balance"], "seek": {"gte": 5000.0}, "opposite": {"lt": 0.0}},
    "k1": {"kind": "category_set", "evidence": ["control"], "seek": [1], "opposite": [2, 3]},
    "k2": {"kind": "offering_any", "evidence": ["open", "large"]},
    "k3": {"kind": "checklist", "evidence": ["options"], "members": ["a", "b", "c"], "least": 2},
    "k4": {"kind": "numeric_band", "evidence": ["balance", "other"], "greatest": True, "seek": {"gt": 2000.0, "lte": 8000.0}},
}
SCHOOLS_SQL = """SELECT *, CASE WHEN balance >= 5000 THEN 1 WHEN balance < 0 THEN -1 ELSE 0 END AS k0, CASE WHEN control = 1 THEN 1 WHEN control IN (2, 3) THEN -1 ELSE 0 END AS k1, CASE WHEN open OR large THEN 1 ELSE 0 END AS k2, CASE WHEN id % 6 >= 2 THEN 1 ELSE 0 END AS k3,
    CASE WHEN greatest(balance, other) > 2000 AND greatest(balance, other) <= 8000 THEN 1 ELSE 0 END AS k4
    FROM (SELECT s_suppkey AS id, s_nationkey AS state, CAST(s_suppkey % 5 AS INTEGER) AS control, s_acctbal AS balance, s_acctbal / 2 + 1000 AS other, s_suppkey % 9 = 0 AS open, s_nationkey > 20 AS large, CASE WHEN s_suppkey % 8 > 0 THEN CAST(s_suppkey % 50 AS DOUBLE) END AS lat, CAST(s_nationkey AS DOUBLE) AS lon,
    CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS price FROM supplier)"""


def _schools(s, d):
    k, nation, balance = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal")
    rows = load(s, d, "supplier").select(
        k.alias("id"), nation.alias("state"), (k % 5).cast("int").alias("control"), balance.alias("balance"), (balance / 2 + 1000).alias("other"), (k % 9 == 0).alias("open"), (nation > 20).alias("large"),
        F.when(k % 8 > 0, (k % 50).cast("double")).alias("lat"), nation.cast("double").alias("lon"), F.when(k % 4 > 0, balance).alias("price"),
        F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("x"), F.lit("c")), F.lit(1), (k % 6).cast("int")).alias("options"),
    )
    return R.with_matches(rows, POLICY)


@query("P_04_matches", f"SELECT id, k0, k1, k2, k3, k4, abs(k0) + abs(k1) + k2 + k3 + k4 AS dimensions FROM ({SCHOOLS_SQL})")
def _(s, d):
    found = [F.coalesce(F.col("matches")[k], F.lit(0)).alias(k) for k in POLICY]
    return _schools(s, d).select("id", *found, F.col("dimensions").cast("int").alias("dimensions"))


@query("P_07_dimensions", f"SELECT dims AS dimensions, count(*) AS n FROM (SELECT abs(k0) + abs(k1) + k2 + k3 + k4 AS dims FROM ({SCHOOLS_SQL})) GROUP BY 1")
def _(s, d):
    return _schools(s, d).groupBy(F.col("dimensions").cast("int").alias("dimensions")).agg(F.count("*").alias("n"))


EDGES = [("c0", 0, "direct"), ("c0", 1, "adjacent"), ("c1", 1, "direct"), ("c1", 2, "adjacent"), ("c2", 3, "direct"), ("c2", 0, "adjacent"), ("c3", 4, "adjacent"), ("c3", 5, "other")]
EDGES_SQL = "(VALUES " + ", ".join(map(str, EDGES)) + ") e(concept, code, relationship)"
CONCEPTS_SQL = "SELECT n_nationkey AS session, 'c' || n_nationkey % 4 AS concept FROM nation UNION ALL SELECT n_nationkey, 'c' || n_nationkey % 3 FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 4 <> n_nationkey % 3"
WANTED_SQL = f"SELECT session, code, bool_or(relationship = 'direct') AS direct FROM ({CONCEPTS_SQL}) c JOIN {EDGES_SQL} ON e.concept = c.concept WHERE relationship <> 'other' GROUP BY 1, 2"


def _wanted(s, d):
    k = F.col("n_nationkey")
    nations = load(s, d, "nation")
    first = nations.select(k.alias("session"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("concept"))
    more = nations.where("n_nationkey % 2 = 0 AND n_nationkey % 4 <> n_nationkey % 3").select(k.alias("session"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("concept"))
    return R.edge_sets(s.createDataFrame(EDGES, "concept string, code int, relationship string"), first.union(more))


@query("P_05_edge_sets", WANTED_SQL)
def _(s, d):
    return _wanted(s, d)


CODES_SQL = "SELECT s_suppkey AS id, CAST(s_suppkey % 6 AS INTEGER) AS code, true AS own FROM supplier UNION ALL SELECT s_suppkey, CAST(s_suppkey // 2 % 5 AS INTEGER), false FROM supplier"
SESSIONS_SQL = "SELECT n_nationkey AS session, 20.0::DOUBLE AS o_lat, CAST(n_nationkey AS DOUBLE) AS o_lon, CASE WHEN n_nationkey % 3 = 0 THEN 1500.0::DOUBLE END AS most_miles, CASE WHEN n_nationkey % 2 = 0 THEN 600.0::DOUBLE END AS preferred_miles, n_nationkey % 4 = 0 AS wildcards, CAST(n_nationkey % 7 - 3 AS INTEGER) AS t0, CAST(n_nationkey % 5 - 2 AS INTEGER) AS t1, 1 AS t4 FROM nation"
CANDIDATES_SQL = f"""
    SELECT *, CASE WHEN is_direct THEN 3.0 ELSE 1.5 END + t0 * k0 + t1 * k1 + t4 * k4 + CASE WHEN coalesce(distance <= preferred_miles, false) THEN 0.5 ELSE 0 END AS score,
        NOT ((t0 * k0 < 0 AND abs(t0) >= 2) OR (t1 * k1 < 0 AND abs(t1) >= 2)) AND CAST(t0 * k0 < 0 AS INTEGER) + CAST(t1 * k1 < 0 AS INTEGER) + CAST(t4 * k4 < 0 AS INTEGER) = 1 AS contrast
    FROM (SELECT m.*, s.*, p.* EXCLUDE (session), CASE WHEN p.most_miles IS NOT NULL OR p.preferred_miles IS NOT NULL THEN 2 * 3958.8 * asin(sqrt(pow(sin(radians(lat - o_lat) / 2), 2) + cos(radians(o_lat)) * cos(radians(lat)) * pow(sin(radians(lon - o_lon) / 2), 2))) END AS distance
    FROM (SELECT session, c.id AS sid, bool_or(own AND direct) AS is_direct, count(*) AS related FROM ({CODES_SQL}) c JOIN ({WANTED_SQL}) w ON w.code = c.code GROUP BY 1, 2 HAVING bool_or(own AND direct) OR bool_or(NOT direct)) m JOIN ({SCHOOLS_SQL}) s ON s.id = m.sid JOIN ({SESSIONS_SQL}) p ON p.session = m.session)
    WHERE most_miles IS NULL OR distance <= most_miles"""


def _candidates(s, d):
    k = F.col("s_suppkey")
    suppliers = load(s, d, "supplier")
    codes = suppliers.select(k.alias("id"), (k % 6).cast("int").alias("code"), F.lit(True).alias("own")).union(suppliers.select(k, F.expr("CAST(s_suppkey DIV 2 % 5 AS INT)"), F.lit(False)))
    n = F.col("n_nationkey")
    sums = F.create_map(F.lit("k0"), (n % 7 - 3).cast("int"), F.lit("k1"), (n % 5 - 2).cast("int"), F.lit("k4"), F.lit(1), F.lit("unknown"), F.lit(2))
    sessions = load(s, d, "nation").select(
        n.alias("session"), F.lit(20.0).alias("lat"), n.cast("double").alias("lon"), F.when(n % 3 == 0, 1500.0).alias("most_miles"), F.when(n % 2 == 0, 600.0).alias("preferred_miles"), (n % 4 == 0).alias("wildcards"), sums.alias("totals")
    )
    return R.candidates(_schools(s, d), codes, sessions, _wanted(s, d))


@query("P_06_candidates", f"SELECT session, id, round(CAST(score AS DOUBLE), 6) AS score, is_direct, related FROM ({CANDIDATES_SQL})")
def _(s, d):
    return _candidates(s, d).select("session", "id", F.round("score", 6).alias("score"), "is_direct", "related")


@query("P_09_contrasts", f"SELECT session, count(*) AS n, count(*) FILTER (WHERE contrast) AS contrasts FROM ({CANDIDATES_SQL}) GROUP BY 1")
def _(s, d):
    return _candidates(s, d).groupBy("session").agg(F.count("*").alias("n"), F.count_if("contrast").alias("contrasts"))


@query("P_08_rounds", None)
def _(s, d):
    return R.rounds(_candidates(s, d))


HISTORY_SQL = "SELECT user_id AS session, event_id % 6 AS round_index, event_id % 20 AS id, event_id AS position FROM events"


def _history(s, d):
    k = F.col("event_id")
    return load(s, d, "events").select(F.col("user_id").alias("session"), (k % 6).alias("round_index"), (k % 20).alias("id"), k.alias("position"))


@query("P_11_exclusions", f"""
    WITH h AS ({HISTORY_SQL}), never AS (SELECT DISTINCT user_id AS session, event_id % 7 AS id FROM events WHERE event_type <> 'purchase') SELECT session, id, 'never' AS kind FROM never
    UNION ALL SELECT DISTINCT session, id, 'cooldown' FROM (SELECT *, max(round_index) OVER (PARTITION BY session) + 1 AS nxt FROM h) x WHERE nxt - round_index <= 2 AND NOT EXISTS (SELECT 1 FROM never n WHERE n.session = x.session AND n.id = x.id)""")
def _(s, d):
    return R.exclusions(_history(s, d), _reactions(s, d), 2)


@query("P_11_readmission", f"""
    SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY f) AS place FROM (SELECT session, id, min((round_index, position)) AS f FROM ({HISTORY_SQL}) h WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = h.session AND e.event_id % 7 = h.id) GROUP BY 1, 2)""")
def _(s, d):
    return R.readmission(_history(s, d), _reactions(s, d))


@query("P_12_reasons", """
    SELECT session, id, array_to_string(list_filter([CASE WHEN c_nationkey > 3 THEN c_name || ' is near' END, CASE WHEN c_acctbal > 0 THEN 'costs ' || c_nationkey END], lambda x: x IS NOT NULL), '|') AS reasons FROM (SELECT c_nationkey AS session, c_custkey AS id, * FROM customer) WHERE c_nationkey > 3 OR c_acctbal > 0""")
def _(s, d):
    place = F.when(F.col("c_nationkey") > 3, F.col("c_name")).otherwise("{left_over}")
    variables = F.create_map(F.lit("near"), F.create_map(F.lit("place"), place), F.lit("cost"), F.create_map(F.lit("price"), F.col("c_nationkey").cast("string")))
    kinds = F.array_compact(F.array(F.lit("near"), F.when(F.col("c_acctbal") > 0, "cost"), F.lit("untold")))
    rows = load(s, d, "customer").select(F.col("c_nationkey").alias("session"), F.col("c_custkey").alias("id"), kinds.alias("kinds"), variables.alias("vars"))
    templates = s.createDataFrame([("near", "{place} is near", "as of today"), ("cost", "costs {price}", "list price"), ("untold", "never shown", None)], "kind string, text string, limitation string")
    return R.rendered_reasons(rows, templates).select("session", "id", F.array_join("reasons", "|").alias("reasons"))


@query("P_14_strip", f"""
    SELECT session, key, class, CAST(place AS INTEGER) AS place, spot AND r <= 3 AS inline FROM (SELECT *, row_number() OVER (PARTITION BY session, class ORDER BY CASE WHEN class = 'away' THEN total ELSE -total END, key) AS place, row_number() OVER (PARTITION BY session, spot ORDER BY class <> 'strong', CASE WHEN class = 'away' THEN total ELSE -total END, key) AS r FROM (
    SELECT *, class IN ('strong', 'gentle') AS spot FROM (SELECT *, CASE WHEN conflicted THEN 'tension' WHEN key NOT IN ('k0', 'k1', 'k2', 'k4') THEN 'recorded' WHEN total >= 2 THEN 'strong' WHEN total > 0 THEN 'gentle' WHEN total < 0 THEN 'away' END AS class FROM ({TOTALS_SQL}) WHERE key <> 'k6') WHERE class IS NOT NULL))""")
def _(s, d):
    captions = s.createDataFrame([(f"k{i}", f"statement {i}") for i in range(6)], "key string, statement string")
    return R.strip_entries(_totals(s, d), captions, ["k0", "k1", "k2", "k4"]).select("session", "key", "class", F.col("place").cast("int").alias("place"), "inline")


@query("P_14_spotlights", "SELECT user_id AS session, k AS key, count(*) AS reasons, count(DISTINCT id) AS schools FROM (SELECT user_id, event_id % 5 AS id, unnest(['k' || event_id % 3, 'k' || event_id % 2]) AS k FROM events) GROUP BY 1, 2")
def _(s, d):
    k = F.col("event_id")
    keys = F.array(F.concat(F.lit("k"), (k % 3).cast("string")), F.concat(F.lit("k"), (k % 2).cast("string")))
    return R.spotlight_counts(load(s, d, "events").select(F.col("user_id").alias("session"), (k % 5).alias("id"), keys.alias("keys")))
