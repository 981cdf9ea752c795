"""Queries of the record operators: coverage, changes, facts, selection, matching, reshaping and parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnwork.functions import scalars as X
from cairnwork.operators import aggregates as A
from cairnwork.operators import changes, coverage, facts, matching, selection
from cairnwork.operators import filters as L
from cairnwork.operators import ranking as W
from cairnwork.plans.registry import query
from cairnwork.sources import readers
from cairnwork.storage import load

OUTCOMES = {"BUILDING": "inserted", "AUTOMOBILE": "marked_removed", "MACHINERY": "auth_walled_okta", "HOUSEHOLD": "dead_url"}


def _choice(column, choices):
    return F.element_at(F.create_map(*[F.lit(x) for pair in choices.items() for x in pair]), column)


@query("D_06_coverage_status", """
    WITH o AS (SELECT o_custkey, max(year(o_orderdate)) FILTER (WHERE o_orderstatus = 'F') AS e, max(year(o_orderdate)) AS f, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY 1),
    i AS (SELECT c_custkey, c_acctbal > -500 AS scope, c_mktsegment AS m, e, f, CASE s WHEN 'F' THEN 'extracted' WHEN 'O' THEN 'discovered' WHEN 'P' THEN 'failed' END AS s FROM customer LEFT JOIN o ON o_custkey = c_custkey)
    SELECT c_custkey, CASE WHEN NOT scope THEN 'out_of_scope'
        WHEN m = 'BUILDING' THEN CASE WHEN e >= f THEN 'cds_available_current' WHEN s = 'failed' AND f > e THEN 'latest_found_extract_failed_with_prior_available' WHEN s = 'failed' THEN 'extract_failed' WHEN s = 'discovered' THEN 'cds_found_processing' ELSE 'cds_available_current' END
        WHEN m IN ('AUTOMOBILE', 'HOUSEHOLD', 'MACHINERY') THEN CASE WHEN e IS NOT NULL THEN 'cds_available_stale' WHEN s = 'failed' THEN 'extract_failed' WHEN s = 'discovered' THEN 'cds_found_processing' WHEN m = 'MACHINERY' THEN 'source_not_automatically_accessible' ELSE 'no_public_cds_found' END
        WHEN e >= f THEN 'cds_available_current' WHEN s = 'discovered' AND e IS NULL THEN 'cds_found_processing' WHEN s = 'failed' AND f > e THEN 'latest_found_extract_failed_with_prior_available' WHEN s = 'failed' THEN 'extract_failed' ELSE 'not_checked' END AS status FROM i""")
def _(s, d):
    year = F.year("o_orderdate")
    found = load(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.when(F.col("o_orderstatus") == "F", year)).alias("e"), F.max(year).alias("f"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s")
    )
    state = _choice(F.col("s"), {"F": "extracted", "O": "discovered", "P": "failed"})
    status = coverage.coverage_status(F.col("c_acctbal") > -500, F.col("e"), F.col("f"), state, _choice(F.col("c_mktsegment"), OUTCOMES))
    return load(s, d, "customer").join(found, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query("D_17_change_events", """
    WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, count(*) AS n, min(o_orderstatus) AS flag, min(o_orderpriority) AS p FROM orders GROUP BY 1, 2),
    t AS (SELECT k, max(n) FILTER (WHERE y = 1996) AS old, max(n) FILTER (WHERE y = 1997) AS new, coalesce(max(flag) FILTER (WHERE y = 1996) = 'P', false) AS ob, coalesce(max(flag) FILTER (WHERE y = 1997) = 'P', false) AS nb,
        coalesce(max(p) FILTER (WHERE y = 1996), '') AS op, coalesce(max(p) FILTER (WHERE y = 1997), '') AS np, bool_or(y < 1996) AS earlier FROM y GROUP BY 1),
    e AS (SELECT *, CASE WHEN old IS NULL AND new IS NULL THEN NULL WHEN nb AND NOT ob THEN 'quality_regression' WHEN ob AND NOT nb AND new IS NOT NULL THEN 'quality_recovered' WHEN ob OR nb THEN NULL
        WHEN new IS NULL THEN CASE WHEN op = np THEN 'newly_missing' ELSE 'producer_changed' END WHEN old IS NULL THEN CASE WHEN earlier THEN 'reappeared' ELSE 'newly_reported' END WHEN old <> new THEN 'material_delta' END AS event FROM t)
    SELECT k, event, CASE WHEN event = 'newly_missing' THEN 'notable' WHEN event <> 'material_delta' THEN 'watch' WHEN abs(new - old) >= 4 OR (old >= 2 AND abs(new - old) / old >= 1.5) THEN 'major' WHEN abs(new - old) >= 2 OR (old >= 2 AND abs(new - old) / old >= 0.5) THEN 'notable' ELSE 'watch' END AS severity FROM e WHERE event IS NOT NULL""")
def _(s, d):
    years = load(s, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.min("o_orderstatus").alias("flag"), F.min("o_orderpriority").alias("p"))

    def at(value, year):
        return F.max(F.when(F.col("y") == year, value))

    none = F.lit(None).cast("string")
    pairs = years.groupBy("k").agg(
        *[at(F.col("n"), y).alias(c) for c, y in (("old", 1996), ("new", 1997))],
        *[at(F.when(F.col("flag") == "P", "wrong_file"), y).alias(c) for c, y in (("old_flag", 1996), ("new_flag", 1997))],
        *[at(F.col("p"), y).alias(c) for c, y in (("old_version", 1996), ("new_version", 1997))],
        F.bool_or(F.col("y") < 1996).alias("earlier"),
    ).withColumns({f"{side}_{c}": none for side in ("old", "new") for c in ("producer", "format", "source")})
    weighed = changes.severity(F.col("old"), F.col("new"), {"absolute": F.lit(2), "relative": F.lit(0.5)}, {"absolute": F.lit(4), "relative": F.lit(1.5)}, F.lit(2))
    return changes.change_events(pairs, F.lit(True), weighed).select("k", "event", "severity")


@query("D_20_typed_facts", """
    SELECT event_id, CASE WHEN v >= 0 AND event_type <> 'view' THEN v END AS number, CASE WHEN event_type = 'view' THEN raw END AS text,
        CASE WHEN v < 0 THEN 'Not applicable' WHEN event_type = 'view' THEN raw END AS label, CASE WHEN v < 0 THEN 'not_applicable' WHEN event_type = 'signup' THEN 'imputed' ELSE 'reported' END AS quality
    FROM (SELECT event_id, event_type, CAST(raw AS DOUBLE) AS v, raw FROM (SELECT *, CASE WHEN event_type = 'error' THEN '-2' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS raw FROM events))""")
def _(s, d):
    raw = F.when(F.col("event_type") == "error", "-2").otherwise(F.floor("value").cast("string"))
    kind = F.when(F.col("event_type") == "view", "label").otherwise("number")
    values = load(s, d, "events").select("event_id", F.lit("v").alias("var"), kind.alias("kind"), raw.alias("raw"), F.when(F.col("event_type") == "signup", "L").otherwise("R").alias("mark"))
    labels = s.createDataFrame([("v", "-2", "Not applicable"), ("v", "L", "Imputed by a neighbour"), ("v", "R", "Reported")], "var string, code string, code_label string")
    return facts.typed_facts(values, labels, ["var"], ["event_id"]).drop("var", "raw")


@query("D_12_percentile_and_fit", """
    WITH t AS (SELECT p_partkey, CAST(p_partkey % 800 AS DOUBLE) AS v, p_size * 10.0 AS a, p_size * 10.0 + p_partkey % 7 * 15 AS b, p_size * 10.0 + p_partkey % 7 * 15 + p_partkey % 5 * 20 AS c FROM part)
    SELECT p_partkey, CASE WHEN a < c THEN round(CASE WHEN v <= a THEN greatest(5.0, 25 - (a - v) / greatest(1.0, b - a) * 25) WHEN v <= b THEN least(50.0, 25 + (v - a) / greatest(1.0, b - a) * 25) WHEN v <= c THEN least(75.0, 50 + (v - b) / greatest(1.0, c - b) * 25) ELSE least(95.0, 75 + (v - c) / greatest(1.0, c - b) * 25) END, 4) END AS pct,
        CASE WHEN a < c THEN CASE WHEN v >= c + 100 THEN 'above_range' WHEN v >= c THEN 'strong_academic_fit' WHEN v >= a THEN 'in_range' ELSE 'below_range' END END AS fit,
        CASE WHEN p_partkey % 800 < 80 THEN 'high_reach' WHEN p_partkey % 800 < 200 THEN 'reach' WHEN p_partkey % 800 < 400 THEN 'possible' ELSE 'likely' END AS outlook FROM t""")
def _(s, d):
    size, key = F.col("p_size") * 10.0, F.col("p_partkey")
    score, p50 = (key % 800).cast("double"), size + key % 7 * 15
    p75 = p50 + key % 5 * 20
    return load(s, d, "part").select("p_partkey", F.round(X.interpolated_percentile(score, size, p50, p75), 4).alias("pct"), X.academic_fit(score, size, p75, 100).alias("fit"), X.admissions_outlook(score / 800).alias("outlook"))


@query("F_12_selected", """
    SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'FURNITURE' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY c_acctbal DESC, c_name, c_custkey LIMIT 25""")
def _(s, d):
    return _selection(s, d)[0].select("c_custkey")


@query("F_12_skip_reasons", """
    WITH r AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 'below_min' WHEN c_mktsegment = 'FURNITURE' THEN 'segment' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'in_flight' END AS reason, row_number() OVER (ORDER BY c_acctbal DESC, c_name, c_custkey) AS place FROM customer),
    bound AS (SELECT max(place) AS place, count(*) AS n FROM (SELECT place FROM r WHERE reason IS NULL ORDER BY place LIMIT 25))
    SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL AND (place < (SELECT place FROM bound) OR (SELECT n FROM bound) < 25) GROUP BY 1""")
def _(s, d):
    return _selection(s, d)[1]


def _selection(s, d):
    busy = load(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("busy", F.lit(True))
    reason = F.when(F.col("c_acctbal") < 0, "below_min").when(F.col("c_mktsegment") == "FURNITURE", "segment").when(F.col("busy"), "in_flight")
    order = [F.col("c_acctbal").isNull(), -F.col("c_acctbal"), F.col("c_name"), F.col("c_custkey")]
    return selection.select_in_order(load(s, d, "customer").join(busy, "c_custkey", "left"), reason, order, 25)


@query("F_13_cooldown", """
    SELECT event_id FROM events WHERE NOT coalesce(date_diff('second', ts, TIMESTAMP '2024-01-31') < CASE event_type WHEN 'error' THEN 14 WHEN 'view' THEN 7 END * 86400, false)""")
def _(s, d):
    outcome = _choice(F.col("event_type"), {"error": "dead_url", "view": "bot_challenge", "click": "inserted"})
    return load(s, d, "events").where(~selection.cooling(outcome, F.col("ts"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"))).select("event_id")


@query("A_25_signed_totals", """
    SELECT user_id, CASE WHEN bool_or(k) AND NOT bool_and(k) THEN 0 ELSE CAST(greatest(-4, least(4, sum(CASE WHEN k THEN n ELSE -n END))) AS BIGINT) END AS total, bool_or(k) AND NOT bool_and(k) AS conflicted
    FROM (SELECT user_id, event_type = 'purchase' AS k, CAST(floor(value) AS BIGINT) % 3 + 1 AS n FROM events WHERE event_type IN ('purchase', 'error') AND ts < TIMESTAMP '2024-01-04') GROUP BY 1""")
def _(s, d):
    active = load(s, d, "events").where("event_type IN ('purchase', 'error') AND ts < TIMESTAMP_NTZ '2024-01-04 00:00:00'")
    return A.signed_totals(active, "user_id", F.col("event_type") == "purchase", F.floor("value") % 3 + 1, -4, 4)


@query("A_11_bucket_summary", """
    SELECT l.bucket, coalesce(n, 0) AS n, coalesce(keys, 0) AS keys, mid FROM (SELECT unnest(['short', 'medium', 'long', 'huge']) AS bucket) l LEFT JOIN
    (SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' WHEN n_chars < 10000000 THEN 'long' ELSE 'huge' END AS bucket, count(*) AS n, count(DISTINCT source) AS keys, median(n_chars) AS mid FROM documents GROUP BY 1) s ON l.bucket = s.bucket""")
def _(s, d):
    names = ["short", "medium", "long", "huge"]
    rows = load(s, d, "documents").select(A.bucket(F.col("n_chars"), [500, 2000, 10_000_000], names).alias("bucket"), "source", F.col("n_chars").cast("double").alias("n_chars"))
    summary = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("source").alias("keys"))
    middle = A.ranked_quantiles(rows, ["bucket"], "n_chars", [0.5], None).withColumnRenamed("p50", "mid")
    return A.with_all_labels(summary.join(middle, "bucket", "left"), "bucket", names, ["n", "keys"])


@query("A_16_answerability", """
    SELECT metric, count(*) AS rows_in, count(v) AS answered FROM (SELECT unnest(['click', 'error', 'purchase']) AS metric, unnest([c, e, p]) AS v FROM
    (SELECT user_id, max(value) FILTER (WHERE event_type = 'click' AND value > 150) AS c, max(value) FILTER (WHERE event_type = 'error' AND value > 250) AS e, max(value) FILTER (WHERE event_type = 'purchase' AND value > 300) AS p FROM events GROUP BY 1)) GROUP BY 1""")
def _(s, d):
    least = {"click": 150, "error": 250, "purchase": 300}
    wide = load(s, d, "events").groupBy("user_id").agg(*[F.max(F.when((F.col("event_type") == m) & (F.col("value") > n), F.col("value"))).alias(m) for m, n in least.items()])
    return wide.unpivot(["user_id"], list(least), "metric", "v").groupBy("metric").agg(F.count("*").alias("rows_in"), F.count("v").alias("answered"))


@query("A_21_status_delta", """
    SELECT o_orderpriority, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS before, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS after, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') - count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS delta FROM orders GROUP BY 1""")
def _(s, d):
    cut = F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return A.counts_around(load(s, d, "orders"), "o_orderpriority", F.col("o_orderdate") < cut, F.col("o_orderdate") >= cut)


@query("A_24_action_by_priority", "SELECT user_id, arg_min(event_type, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 4 END) AS action FROM events GROUP BY 1")
def _(s, d):
    rank = F.coalesce(_choice(F.col("event_type"), {"purchase": 0, "signup": 1, "error": 2, "click": 3}), F.lit(4))
    return load(s, d, "events").groupBy("user_id").agg(F.min_by("event_type", rank).alias("action"))


@query("A_26_class_pivot", "SELECT p_brand, count(*) FILTER (WHERE p_type = 'ECONOMY') AS economy, count(*) FILTER (WHERE p_type = 'PROMO') AS promo, count(*) AS total FROM part GROUP BY 1")
def _(s, d):
    return load(s, d, "part").groupBy("p_brand").agg(F.count_if(F.col("p_type") == "ECONOMY").alias("economy"), F.count_if(F.col("p_type") == "PROMO").alias("promo"), F.count("*").alias("total"))


@query("A_31_majority", "SELECT source, CASE WHEN 2 * max(n) > sum(n) THEN arg_max(lang, n) ELSE 'mixed' END AS main FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    counts = load(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.when(2 * F.max("n") > F.sum("n"), F.max_by("lang", "n")).otherwise("mixed").alias("main"))


@query("A_35_non_null_count", "SELECT c_custkey, CAST(c_name IS NOT NULL AS INTEGER) + CAST(c_acctbal IS NOT NULL AS INTEGER) + CAST(o_orderkey IS NOT NULL AS INTEGER) AS n FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(s, d):
    latest = load(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return load(s, d, "customer").join(latest, "c_custkey", "left").select("c_custkey", A.non_null_count(["c_name", "c_acctbal", "o_orderkey"]).alias("n"))


@query("J_14_unique_signature", """
    WITH a AS (SELECT c_nationkey AS k, floor(c_acctbal / 500) AS b, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2 HAVING count(*) = 1), s AS (SELECT s_nationkey AS k, floor(s_acctbal / 500) AS b, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT c_custkey, s_suppkey FROM a JOIN s USING (k, b)""")
def _(s, d):
    a = load(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.floor(F.col("c_acctbal") / 500).alias("b"), "c_custkey")
    b = load(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.floor(F.col("s_acctbal") / 500).alias("b"), "s_suppkey")
    return matching.unique_matches(a, b, ["k", "b"]).select("c_custkey", "s_suppkey")


@query("J_17_best_names", None)
def _(s, d):
    names = load(s, d, "part").select("p_name")
    return matching.best_names(names, names.withColumnRenamed("p_name", "other"), "p_name", "other", 0.7, F.col("p_name") != F.col("other"))


@query("L_02_pinned", "SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_partkey = 7 THEN -1 WHEN lower(p_name) = 'cold widget' THEN 0 WHEN starts_with(lower(p_name), 'cold') THEN 1 ELSE 2 END AS tier FROM part) WHERE tier < 2 ORDER BY tier, p_partkey LIMIT 25")
def _(s, d):
    name = F.lower("p_name")
    tier = F.when(F.col("p_partkey") == 7, -1).when(name == "cold widget", 0).when(name.startswith("cold"), 1).otherwise(2)
    return load(s, d, "part").withColumn("tier", tier).where("tier < 2").orderBy("tier", "p_partkey").limit(25).select("p_partkey")


@query("R_01_explode_map", "SELECT event_id, key AS field, CAST(json_extract_string(props, '$.' || key) AS INTEGER) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def _(s, d):
    return load(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("field", "value"))


@query("R_03_compare_matrix", """
    SELECT position, user_id, coalesce(max(n) FILTER (WHERE event_type = 'click'), 'n/a') AS click, coalesce(max(n) FILTER (WHERE event_type = 'refund'), 'n/a') AS refund
    FROM (VALUES (0, 9), (1, 3), (2, 9999999), (3, 5)) w(position, user_id) LEFT JOIN (SELECT user_id, event_type, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY 1, 2) e USING (user_id) GROUP BY 1, 2""")
def _(s, d):
    counts = load(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return A.compare_matrix(counts, [9, 3, 9, 9999999, 5], "user_id", "event_type", "n", ["click", "refund"], "n/a")


@query("R_04_json_rows", "SELECT lang, n, longest FROM (SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY 1)")
def _(s, d):
    packed = load(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest")).select(F.to_json(F.array(F.struct("lang", "n", "longest"))).alias("j"))
    return packed.select(F.inline(F.from_json("j", "array<struct<lang string, n bigint, longest bigint>>")))


@query("S_04_last_by_key", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(s, d):
    return W.first_per_key(load(s, d, "events"), ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("SNK_15_archive_action", "SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'inserted' WHEN a.h = b.h THEN 'unchanged_verified' ELSE 'refreshed' END AS action FROM (SELECT doc_id, sha256(text) AS h FROM documents) a LEFT JOIN (SELECT item_id AS doc_id, sha256(text) AS h FROM benchmark) b USING (doc_id)")
def _(s, d):
    stored = load(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.sha2("text", 256).alias("stored"))
    fresh = load(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return fresh.join(stored, "doc_id", "left").select("doc_id", L.first_reason([(F.col("stored").isNull(), "inserted"), (F.col("stored") == F.col("h"), "unchanged_verified")], "refreshed").alias("action"))


@query("SRC_21_anchors", r"""SELECT page_id, CAST(position - 1 AS INTEGER) AS position, href, trim(regexp_replace(label, '<[^>]*>', '', 'g')) AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1), 1) AS position FROM pages)""")
def _(s, d):
    return readers.anchors(load(s, d, "pages"))


@query("SRC_18_format", "SELECT page_id, CASE WHEN starts_with(lower(html), '<!doctype html') OR starts_with(lower(html), '<html') THEN 'html' ELSE 'other' END AS format FROM pages")
def _(s, d):
    return load(s, d, "pages").select("page_id", readers.format_of(F.col("html").cast("binary")).alias("format"))


@query("X_16_academic_year", "SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 1999 THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || right(CAST(year(o_orderdate) + 1 AS VARCHAR), 2) END AS span FROM orders")
def _(s, d):
    y = F.year("o_orderdate")
    short = F.lpad(((y + 1) % 100).cast("string"), 2, "0")
    text = F.when(y < 1999, F.concat(F.lit("form "), y.cast("string"), F.lit("_"), short, F.lit(".pdf")))
    text = F.coalesce(text, F.concat(F.lit("of "), F.lpad((y % 100).cast("string"), 2, "0"), F.lit(" - "), short))
    return load(s, d, "orders").select("o_orderkey", X.academic_year(text).alias("span"))


@query("X_28_domains", r"SELECT page_id, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages)")
def _(s, d):
    return load(s, d, "pages").select("page_id", X.host(F.col("url")).alias("host"), X.registrable_domain(F.col("url")).alias("domain"))


@query("X_42_natural_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY CAST(regexp_extract(p_brand, '\\d+') AS INTEGER), p_partkey) AS place FROM part")
def _(s, d):
    order = Window.partitionBy("p_type").orderBy(X.natural_key(F.col("p_brand")), "p_partkey")
    return load(s, d, "part").select("p_partkey", F.row_number().over(order).alias("place"))


@query("W_04_precedence_of_five", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P', o_orderpriority <> '1-URGENT', o_totalprice < 1000, year(o_orderdate) DESC, o_orderkey DESC) = 1")
def _(s, d):
    order = [(F.col("o_orderstatus") == "P").asc(), (F.col("o_orderpriority") != "1-URGENT").asc(), (F.col("o_totalprice") < 1000).asc(), F.year("o_orderdate").desc(), F.desc("o_orderkey")]
    return W.first_per_key(load(s, d, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey")


@query("W_06_latest_with_required", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 100 AND event_type <> 'error' THEN 0 ELSE 1 END, ts DESC, event_id) = 1")
def _(s, d):
    has = L.passing([L.condition("value", ">", 100, True), L.condition("event_type", "!=", "error")])
    return W.first_per_key(load(s, d, "events"), ["user_id"], [has.desc(), F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id")


@query("D_17_selectivity_bands", "SELECT p_partkey, CASE WHEN r IS NULL THEN 'unknown_selectivity' WHEN r < 0.2 THEN 'high_selectivity' WHEN r < 0.5 THEN 'selective' ELSE 'broad_access' END AS band FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 64) / 64.0 END AS r FROM part)")
def _(s, d):
    rate = F.when(F.col("p_partkey") % 7 > 0, (F.col("p_partkey") % 64) / F.lit(64.0))
    return load(s, d, "part").select("p_partkey", changes.selectivity_band(rate).alias("band"))


@query("D_17_card_changes", """
    SELECT o_custkey, CASE WHEN a = 'ok' THEN 'notable' ELSE 'watch' END AS severity FROM (SELECT o_custkey, CASE WHEN min(o_totalprice) FILTER (WHERE year(o_orderdate) = 1996) > 2000 THEN 'ok' ELSE 'thin' END AS a, CASE WHEN min(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997) > 2000 THEN 'ok' ELSE 'thin' END AS b FROM orders GROUP BY 1) WHERE a <> b""")
def _(s, d):
    least = lambda y: F.min(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")))
    pairs = load(s, d, "orders").groupBy("o_custkey").agg(*[F.when(least(y) > 2000, "ok").otherwise("thin").alias(n) for y, n in ((1996, "old_quality"), (1997, "new_quality"))])
    return changes.card_changes(pairs).select("o_custkey", "severity")
