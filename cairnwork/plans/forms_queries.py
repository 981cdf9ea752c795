"""Queries of form tables and resolvers over forms made of table columns, and of audits and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnwork.operators import forms as T
from cairnwork.operators.lines import spread
from cairnwork.operators.lookups import mapped
from cairnwork.plans.registry import query
from cairnwork.storage import load, materialize

FORM = """concat('## C2 waiting list
| Waiting list | Total |
|---|---|
| Number of qualified applicants offered a place | ', CAST(p_size * 100 AS VARCHAR(20)), ' |
| Number accepting a place | |
| on the list | 1,', CAST(100 + p_partkey % 900 AS VARCHAR(20)), ' |
| | 8 |
', p_name, '
## C7
| Academic | Very Important | Important | Considered | Not Considered |
|---|---|---|---|---|
| Class rank |', CASE p_partkey % 3 WHEN 0 THEN ' X | | |' WHEN 1 THEN ' | | x |' ELSE ' | | |' END, ' |
| Interview | | ✓ | | |
## B2
| Race | First-time, first-year | Total Undergraduates |
|---|---|---|
| Asian, non-Hispanic | ', CAST(p_size AS VARCHAR(20)), ' | ', CASE WHEN p_partkey % 2 = 0 THEN 'n/a' ELSE CAST(p_partkey AS VARCHAR(20)) END, ' |
## C9
| Test | 25th percentile | 75th percentile |
|---|---|---|
| SAT Math (200-800) | ', CAST(p_size * 20 AS VARCHAR(20)), ' | 700 |
')"""


def _rows(s, d):
    return T.pipe_tables(load(s, d, "part").select("p_partkey", F.expr(FORM).alias("text")), "p_partkey", "text")


@query("T_01_form_rows", """
    SELECT p_partkey, section, label, vals FROM (SELECT p_partkey, unnest([{'section': 'C2 waiting list', 'label': 'Number of qualified applicants offered a place', 'vals': CAST(p_size * 100 AS VARCHAR)}, {'section': 'C2 waiting list', 'label': 'Number accepting a place on the list', 'vals': '1,' || (100 + p_partkey % 900)},
        {'section': 'C2 waiting list', 'label': 'Number accepting a place on the list', 'vals': '8'}, {'section': 'C7', 'label': CASE WHEN p_partkey % 3 = 2 THEN 'Class rank Interview' ELSE 'Class rank' END, 'vals': CASE p_partkey % 3 WHEN 0 THEN 'X~~~' WHEN 1 THEN '~~x~' ELSE '~✓~~' END}, {'section': CASE WHEN p_partkey % 3 < 2 THEN 'C7' END, 'label': 'Interview', 'vals': '~✓~~'},
        {'section': 'B2', 'label': 'Asian, non-Hispanic', 'vals': p_size || '~' || CASE WHEN p_partkey % 2 = 0 THEN 'n/a' ELSE CAST(p_partkey AS VARCHAR) END}, {'section': 'C9', 'label': 'SAT Math (200-800)', 'vals': p_size * 20 || '~700'}], recursive := true) FROM part) WHERE section IS NOT NULL""")
def _(s, d):
    return _rows(s, d).select("p_partkey", "section", "label", F.array_join("values", "~").alias("vals"))


@query("T_04_waiting_list", "SELECT p_partkey, 'C.202' AS field, CAST(p_size * 100 AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'C.203', '1' || (100 + p_partkey % 900) FROM part UNION ALL SELECT p_partkey, 'C.203', '8' FROM part")
def _(s, d):
    return T.waiting_list(_rows(s, d), "p_partkey").select("p_partkey", "field", "value")


def _basis(s, rows):
    fields = s.createDataFrame([("Academic Factors", "Class rank", "C.702"), ("Nonacademic Factors", "Interview", "C.707")], "category string, question string, field string")
    return T.selection_basis(rows, "p_partkey", fields)


@query("T_04_selection_basis", "SELECT p_partkey, 'C.702' AS field, CASE p_partkey % 3 WHEN 0 THEN 'Very Important' WHEN 1 THEN 'Considered' ELSE 'Important' END AS value FROM part UNION ALL SELECT p_partkey, 'C.707', 'Important' FROM part WHERE p_partkey % 3 < 2")
def _(s, d):
    return _basis(s, _rows(s, d)).select("p_partkey", "field", "value")


@query("T_04_enrollment_by_race", "SELECT p_partkey, 'B.202' AS field, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'B.222', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 2 = 1")
def _(s, d):
    fields = s.createDataFrame([("First-time, first-year", "Degree-seeking", "Asian, non-Hispanic", "B.202"), ("All", "All", "Asian, non-Hispanic", "B.222")], "cohort string, category string, question string, field string")
    return T.enrollment_by_race(_rows(s, d), "p_partkey", fields).select("p_partkey", "field", "value")


@query("T_04_score_percentiles", "SELECT p_partkey, 'C.911' AS field, CAST(p_size * 20 AS VARCHAR) AS value FROM part WHERE p_size * 20 BETWEEN 200 AND 800 UNION ALL SELECT p_partkey, 'C.913', '700' FROM part")
def _(s, d):
    return T.score_percentiles(_rows(s, d), "p_partkey").select("p_partkey", "field", "value")


@query("T_02_cleaned", """
    SELECT p_partkey, 'C.202' AS field, CAST(p_size * 100 AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'C.203', '1' || (100 + p_partkey % 900) FROM part UNION ALL SELECT p_partkey, 'C.702', CASE p_partkey % 3 WHEN 0 THEN 'Very Important' WHEN 1 THEN 'Considered' ELSE 'Important' END FROM part UNION ALL SELECT p_partkey, 'C.707', 'Important' FROM part WHERE p_partkey % 3 < 2
    UNION ALL SELECT p_partkey, 'C.911', CAST(p_size * 20 AS VARCHAR) FROM part WHERE p_size * 20 BETWEEN 200 AND 800 UNION ALL SELECT p_partkey, 'C.913', '700' FROM part""")
def _(s, d):
    rows = spread(materialize(_rows(s, d), "rows"), "p_partkey")
    return T.cleaned([T.waiting_list(rows, "p_partkey"), _basis(s, rows), T.score_percentiles(rows, "p_partkey")], "p_partkey").select("p_partkey", "field", "value")


@query("A_07_directory_cards", """
    SELECT o_custkey, count(*) AS n, max(year(o_orderdate)) AS latest, bool_or(o_orderstatus = 'F') AS extracted, (SELECT string_agg(p, ',' ORDER BY f) FROM (SELECT o_orderpriority AS p, min((o_orderdate, o_orderkey)) AS f FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY 1)) AS formats FROM orders o GROUP BY 1""")
def _(s, d):
    orders = load(s, d, "orders")
    kinds = orders.groupBy("o_custkey", "o_orderpriority").agg(
        F.count("*").alias("n"), F.max(F.year("o_orderdate")).alias("latest"), F.bool_or(F.col("o_orderstatus") == "F").alias("extracted"), F.min(F.struct("o_orderdate", "o_orderkey")).alias("first")
    )
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "o_orderpriority"))), lambda x: x["o_orderpriority"]), ",")
    return kinds.groupBy("o_custkey").agg(F.sum("n").alias("n"), F.max("latest").cast("bigint").alias("latest"), F.bool_or("extracted").alias("extracted"), ordered.alias("formats"))


@query("A_08_corpus_summary", "SELECT count(DISTINCT o_custkey) AS schools, count(*) AS documents, min(year(o_orderdate)) FILTER (WHERE o_orderstatus <> 'P') AS first_year, max(year(o_orderdate)) FILTER (WHERE o_orderstatus <> 'P') AS last_year, count(*) FILTER (WHERE o_orderstatus = 'F') AS extracted FROM orders")
def _(s, d):
    year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).cast("bigint")
    return load(s, d, "orders").agg(F.count_distinct("o_custkey").alias("schools"), F.count("*").alias("documents"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_if(F.col("o_orderstatus") == "F").alias("extracted"))


@query("F_15_year_inside_aggregate", "SELECT c_mktsegment, min(y) FILTER (WHERE regexp_matches(y, '^[0-9]{4}')) AS first, max(y) FILTER (WHERE regexp_matches(y, '^[0-9]{4}')) AS last FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE CAST(1990 + c_nationkey AS VARCHAR) || '-x' END AS y FROM customer) GROUP BY 1")
def _(s, d):
    span = F.when(F.col("c_custkey") % 4 == 0, "unknown").otherwise(F.concat((1990 + F.col("c_nationkey")).cast("string"), F.lit("-x")))
    named = F.when(span.rlike("^[0-9]{4}"), span)
    return load(s, d, "customer").groupBy("c_mktsegment").agg(F.min(named).alias("first"), F.max(named).alias("last"))


@query("A_15_year_by_producer", "SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(s, d):
    return load(s, d, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y"), "o_orderpriority").agg(F.count("*").alias("n"))


@query("A_17_availability", """
    SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) FILTER (WHERE answered) / count(*), 1) AS pct, count(*) FILTER (WHERE top AND answered) AS top_answered FROM (SELECT o_orderpriority, o_totalprice > 2000 AS answered, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 200 AS top FROM orders) GROUP BY 1""")
def _(s, d):
    orders = load(s, d, "orders")
    top = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", F.lit(True).alias("top"))
    answered = F.col("o_totalprice") > 2000
    return orders.join(F.broadcast(top), "o_orderkey", "left").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(100 * F.count_if(answered) / F.count("*"), 1).alias("pct"), F.count_if(F.col("top") & answered).alias("top_answered")
    )


@query("A_18_audit_by_metric", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value < 5) AS low, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events GROUP BY 1")
def _(s, d):
    return load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") < 5).alias("low"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"))


@query("A_19_group_counts", "SELECT 'lang' AS what, lang AS name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def _(s, d):
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("name")) for c in ("lang", "source")]))
    return load(s, d, "documents").select(each).groupBy("what", "name").agg(F.count("*").alias("n"))


@query("A_20_queue_health", "SELECT event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1")
def _(s, d):
    return load(s, d, "events").where(F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'")).groupBy("event_type").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("A_23_pair_coverage", """
    SELECT count(*) AS schools, count(*) FILTER (WHERE p) AS with_prior, count(*) FILTER (WHERE l) AS with_latest, count(*) FILTER (WHERE p AND l) AS pairable, round(count(*) FILTER (WHERE p AND l) * 1.0 / count(*), 6) AS share FROM (SELECT o_custkey, bool_or(year(o_orderdate) = 1996) AS p, bool_or(year(o_orderdate) = 1997) AS l FROM orders GROUP BY 1)""")
def _(s, d):
    year = F.year("o_orderdate")
    flags = load(s, d, "orders").groupBy("o_custkey").agg(F.bool_or(year == 1996).alias("p"), F.bool_or(year == 1997).alias("l"))
    both = F.col("p") & F.col("l")
    return flags.agg(F.count("*").alias("schools"), F.count_if("p").alias("with_prior"), F.count_if("l").alias("with_latest"), F.count_if(both).alias("pairable"), F.round(F.count_if(both) / F.count("*"), 6).alias("share"))


@query("A_29_field_coverage", "SELECT event_type AS field, count(DISTINCT user_id) FILTER (WHERE value > 50) AS now, count(DISTINCT user_id) AS stored, count(DISTINCT user_id) FILTER (WHERE value > 50) - count(DISTINCT user_id) AS delta FROM events GROUP BY 1")
def _(s, d):
    pairs = load(s, d, "events").groupBy("event_type", "user_id").agg(F.bool_or(F.col("value") > 50).alias("now"))
    counts = pairs.groupBy(F.col("event_type").alias("field")).agg(F.count_if("now").alias("now"), F.count("*").alias("stored"))
    return counts.withColumn("delta", F.col("now") - F.col("stored"))


@query("A_34_latest_quality", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_kind FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(s, d):
    return load(s, d, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_kind"))


@query("A_14_share_of_corpus", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) AS total, round(100.0 * count(*) / (SELECT count(*) FROM orders), 1) AS pct FROM orders GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), 100.0 FROM orders")
def _(s, d):
    from cairnwork.operators.aggregates import with_total

    orders = load(s, d, "orders")
    counts = with_total(orders.withColumn("y", F.year("o_orderdate").cast("string")), "y", [F.count("*").alias("total")])
    whole = F.max(F.when(F.col("y") == "TOTAL", F.col("total"))).over(Window.partitionBy())  # over the few rows of years
    return counts.select("y", "total", F.round(100 * F.col("total") / whole, 1).alias("pct"))


@query("A_11_waiting_summary", """
    SELECT b AS bucket, count(*) AS n, count(DISTINCT l_partkey) AS keys, round(sum(l_quantity) / sum(l_linenumber), 6) AS ratio, count(*) FILTER (WHERE l_discount < 0.02) AS low, median(l_linenumber) AS mid_base FROM (SELECT *, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS b FROM lineitem) GROUP BY 1""")
def _(s, d):
    from cairnwork.operators.aggregates import bucket

    return load(s, d, "lineitem").groupBy(bucket(F.col("l_quantity"), [10, 30], ["small", "medium", "large"]).alias("bucket")).agg(
        F.count("*").alias("n"), F.count_distinct("l_partkey").alias("keys"), F.round(F.sum("l_quantity") / F.sum("l_linenumber"), 6).alias("ratio"), F.count_if(F.col("l_discount") < 0.02).alias("low"), F.median("l_linenumber").alias("mid_base")
    )


@query("R_08_workbook_rows", "SELECT p_brand AS section, p_name AS field, string_agg(p_type || '=' || p_size, '; ' ORDER BY p_type, p_size, p_partkey) AS answers, count(DISTINCT p_type) > 1 AS variants FROM part GROUP BY 1, 2")
def _(s, d):
    cells = F.transform(F.array_sort(F.collect_list(F.struct("p_type", "p_size", "p_partkey"))), lambda x: F.concat_ws("=", x["p_type"], x["p_size"].cast("string")))
    return load(s, d, "part").groupBy(F.col("p_brand").alias("section"), F.col("p_name").alias("field")).agg(F.array_join(cells, "; ").alias("answers"), (F.count_distinct("p_type") > 1).alias("variants"))


@query("D_19_evidence_json", """SELECT o_orderkey, '{"from":{"num":' || o_custkey || ',"status":"reported"},"delta":' || CASE WHEN o_orderkey % 2 = 0 THEN '5' ELSE 'null' END || ',"same":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || '}' AS evidence FROM orders""")
def _(s, d):
    made = F.struct(F.struct(F.col("o_custkey").alias("num"), F.lit("reported").alias("status")).alias("from"), F.when(F.col("o_orderkey") % 2 == 0, 5).alias("delta"), (F.col("o_orderstatus") == "F").alias("same"))
    return load(s, d, "orders").select("o_orderkey", F.to_json(made, {"ignoreNullFields": "false"}).alias("evidence"))


@query("SNK_07_update_from_constants", "SELECT doc_id, CASE WHEN doc_id IN (1, 2) THEN 0 ELSE quality END AS quality FROM labels UNION ALL SELECT x, 0 FROM (VALUES (1), (2), (9999999)) v(x) WHERE x NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    from cairnwork.operators.upserts import last_write_wins

    stored = load(s, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    constants = s.createDataFrame([(1, 0), (2, 0), (9999999, 0)], f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, quality int")
    return last_write_wins(stored, constants, ["doc_id"], [F.asc("quality")])


@query("SNK_09_refreshed_view", "SELECT count(*) AS n, sum(total) AS orders FROM (SELECT o_custkey, count(*) AS total FROM orders GROUP BY 1)")
def _(s, d):
    from cairnwork.storage import materialize

    view = materialize(load(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total")), "view")
    return view.agg(F.count("*").alias("n"), F.sum("total").cast("double").alias("orders"))


@query("SRC_08_coalesced_columns", "SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal END, CASE WHEN c_nationkey % 3 = 0 THEN -c_acctbal END) AS cost, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_mktsegment END AS kind FROM customer")
def _(s, d):
    from cairnwork.sources.readers import mapped_columns

    wide = load(s, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_acctbal").cast("string")).otherwise("NULL").alias("COST_PUB"), F.when(F.col("c_nationkey") % 3 == 0, (-F.col("c_acctbal")).cast("string")).otherwise("PrivacySuppressed").alias("COST_PRIV"),
                                         F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "NULL").otherwise(F.col("c_mktsegment")).alias("KIND"))
    return mapped_columns(wide, ["c_custkey"], {"cost": (("COST_PUB", "COST_PRIV"), "double"), "kind": (("KIND",), "string")})


@query("A_33_backlog_lists", """
    SELECT 'format' AS list, o_orderpriority AS name, CAST(count(*) AS VARCHAR) AS value FROM orders WHERE o_orderstatus <> 'F' GROUP BY 2 UNION ALL (SELECT 'key', CAST(o_custkey AS VARCHAR), CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderstatus <> 'F' GROUP BY 2, o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 10)
    UNION ALL (SELECT 'oldest', CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate, o_orderkey LIMIT 15)""")
def _(s, d):
    left = load(s, d, "orders").where("o_orderstatus <> 'F'")
    by_format = left.groupBy("o_orderpriority").agg(F.count("*").alias("n")).select(F.lit("format").alias("list"), F.col("o_orderpriority").alias("name"), F.col("n").cast("string").alias("value"))
    keys = left.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10).select(F.lit("key"), F.col("o_custkey").cast("string"), F.col("n").cast("string"))
    oldest = left.orderBy("o_orderdate", "o_orderkey").limit(15).select(F.lit("oldest"), F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return by_format.union(keys).union(oldest)


@query("A_22_run_gate", "SELECT round(count(*) FILTER (WHERE event_type = 'view') * 1.0 / count(*), 4) AS transient, round(count(*) FILTER (WHERE event_type = 'error') * 1.0 / count(*), 4) AS permanent, count(*) FILTER (WHERE event_type = 'error') * 1.0 / count(*) > 0.1 AS stopped FROM events")
def _(s, d):
    kind = mapped(F.col("event_type"), {"view": "transient", "error": "permanent"})
    share = lambda k: F.count_if(kind == k) / F.count("*")
    return load(s, d, "events").agg(F.round(share("transient"), 4).alias("transient"), F.round(share("permanent"), 4).alias("permanent"), (share("permanent") > 0.1).alias("stopped"))


@query("L_02_clamped", "SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_partkey = 7 THEN -1 WHEN lower(p_name) = 'cold widget' THEN 0 WHEN starts_with(lower(p_name), 'cold') THEN 1 ELSE 2 END AS tier FROM part) WHERE tier < 2 ORDER BY tier, p_partkey LIMIT 25")
def _(s, d):
    from cairnwork.operators.ranking import pinned

    return pinned(load(s, d, "part"), "p_partkey", " 7 ", F.col("p_name"), "Cold Widget", 400, [F.asc("p_partkey")], prefix="cold").select("p_partkey")


@query("J_19_rules", """
    WITH y AS (SELECT user_id, event_type, max(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS old, max(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS new FROM events GROUP BY 1, 2) SELECT user_id, event_type, CASE WHEN abs(new - old) >= t THEN 'over' ELSE 'under' END AS verdict FROM y JOIN (VALUES ('click', 100), ('purchase', 50)) r(k, t) ON k = event_type WHERE old IS NOT NULL AND new IS NOT NULL""")
def _(s, d):
    cut = F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    rules = s.createDataFrame([("click", 100.0), ("purchase", 50.0)], "event_type string, least double")
    sides = load(s, d, "events").groupBy("user_id", "event_type").agg(F.max(F.when(F.col("ts") < cut, F.col("value"))).alias("old"), F.max(F.when(F.col("ts") >= cut, F.col("value"))).alias("new"))
    pairs = sides.where("old IS NOT NULL AND new IS NOT NULL").join(rules, "event_type")
    return pairs.select("user_id", "event_type", F.when(F.abs(F.col("new") - F.col("old")) >= F.col("least"), "over").otherwise("under").alias("verdict"))


@query("SNK_14_report_rows", "SELECT '| ' || user_id || ' | ' || event_id || ' | ' || event_type || ' |' AS line FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 20")
def _(s, d):
    from cairnwork.sinks.files import report_lines

    top = first_n(load(s, d, "events"))
    return report_lines(top.select("user_id", "event_id", "event_type"), ["user_id", "event_id", "event_type"])


def first_n(events):
    from cairnwork.operators.ranking import ranked

    return ranked(events, ["event_type"], [F.desc("value"), F.asc("event_id")]).where("rank <= 20")



LINK = "concat('https://x.edu/', CASE event_id % 3 WHEN 0 THEN '2021-2022/' ELSE 'files/' END, CASE event_id % 4 WHEN 0 THEN 'cds_2023-24' WHEN 1 THEN 'Section_C' WHEN 2 THEN 'draft-form' ELSE 'about' END, CASE WHEN event_id % 4 < 3 THEN '.pdf' ELSE '' END, '?v=1')"


@query("SRC_21_described", """
    SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 'document' ELSE 'subpage' END AS kind, CASE WHEN event_id % 4 = 0 THEN '2023-24' WHEN event_id % 3 = 0 THEN '2021-22' WHEN event_id % 5 = 0 THEN '2019-20' END AS "year",
        CASE WHEN event_id % 4 = 0 THEN 'filename' WHEN event_id % 3 = 0 THEN 'url_path' WHEN event_id % 5 = 0 THEN 'link_text' ELSE 'unknown' END AS year_source, CASE WHEN event_id % 4 = 1 THEN 'C' END AS section, event_id % 4 = 2 AS is_test FROM events""")
def _(s, d):
    from cairnwork.sources.readers import described_anchors

    label = F.when(F.col("event_id") % 5 == 0, "form for 2019-20").otherwise("form")
    return described_anchors(load(s, d, "events").select("event_id", F.expr(LINK).alias("href"), label.alias("label"))).select("event_id", "kind", "year", "year_source", "section", "is_test")
