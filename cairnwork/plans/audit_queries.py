"""Queries of audits, typed rows, the directory and snapshots, and of a few operators over rows with nulls and ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.functions import scalars as X
from cairnwork.operators import audits as A
from cairnwork.operators import filters as L
from cairnwork.operators import joins as J
from cairnwork.operators import queue as Q
from cairnwork.plans.registry import query
from cairnwork.sinks import snapshots
from cairnwork.sources import directory
from cairnwork.sources.readers import page_links
from cairnwork.storage import load


def _answers(s, d):
    """Orders as documents: their priority as producer, their key as what they answer."""
    k = F.col("o_orderkey")
    return load(s, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("producer"), (k % 3 == 0).alias("answerable"), F.when(k % 7 > 0, k % 2 == 0).alias("ed_offered"), (k % 5 == 0).alias("ea_offered"), (k % 11 == 0).alias("second_deadline"),
        F.when(k % 13 > 0, F.floor("o_totalprice").cast("int")).alias("applied"), (k % 17).cast("int").alias("admitted"), F.when(k % 4 > 0, (k % 17 * (k % 10)).cast("int")).alias("ed_admitted"),
    )


MARKED = """SELECT o_orderkey, o_orderpriority AS producer, o_orderkey % 3 = 0 AS ok, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 2 = 0 END AS ed, o_orderkey % 5 = 0 AS ea, o_orderkey % 11 = 0 AS two,
    CASE WHEN o_orderkey % 13 > 0 THEN CAST(floor(o_totalprice) AS INTEGER) END AS applied, o_orderkey % 17 AS admitted, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 17 * (o_orderkey % 10) END AS early FROM orders"""
RATES = """count(*) AS "rows", count(*) FILTER (WHERE ok) AS answerable, count(*) FILTER (WHERE ed) AS ed_offered, count(*) FILTER (WHERE ed AND ok) AS ed_offered_answerable, count(*) FILTER (WHERE ea) AS ea_offered, count(*) FILTER (WHERE coalesce(ed, false) OR ea) AS early_offered,
    count(*) FILTER (WHERE (coalesce(ed, false) OR ea) AND ok) AS early_offered_answerable, count(*) FILTER (WHERE two) AS second_deadline, round(count(*) FILTER (WHERE ok) * 100.0 / count(*), 1) AS answerable_pct,
    round(count(*) FILTER (WHERE ed AND ok) * 100.0 / count(*) FILTER (WHERE ed), 1) AS ed_offered_answerable_pct, round(count(*) FILTER (WHERE (coalesce(ed, false) OR ea) AND ok) * 100.0 / count(*) FILTER (WHERE coalesce(ed, false) OR ea), 1) AS early_offered_answerable_pct, round(count(*) FILTER (WHERE two) * 100.0 / count(*), 1) AS second_deadline_pct"""


@query("A_17_answer_rates", f"WITH m AS ({MARKED}) SELECT 'all' AS slice, {RATES} FROM m UNION ALL SELECT 'top_200', {RATES} FROM (SELECT * FROM m ORDER BY coalesce(applied, 0) DESC, o_orderkey LIMIT 200)")
def _(s, d):
    return A.answer_rates(_answers(s, d), "o_orderkey")


@query("A_17_answers_by_producer", f"SELECT producer, count(*) AS total, count(*) FILTER (WHERE ok) AS answerable, round(count(*) FILTER (WHERE ok) * 100.0 / count(*), 1) AS pct FROM ({MARKED}) GROUP BY 1")
def _(s, d):
    return A.answers_by(_answers(s, d), "producer")


@query("A_17_early_shares", f"SELECT count(*) AS count, round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75, round(quantile_cont(x, 0.9), 4) AS p90 FROM (SELECT early / admitted AS x FROM ({MARKED}) WHERE ok AND early IS NOT NULL AND admitted > 0)")
def _(s, d):
    return A.early_shares(_answers(s, d))


def _queue(s, d):
    e = load(s, d, "events")
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "ready").otherwise("processing")
    return e.select("event_id", status.alias("status"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("last_outcome"), F.when(F.col("user_id") % 2 == 0, "auto").otherwise("hand").alias("source"), F.col("ts").alias("processed_at"),
                    F.col("ts").alias("enqueued_at"), F.when(F.col("event_type") == "click", F.col("ts")).alias("claimed_at"), F.col("props").alias("last_error"))


@query("A_20_queue_recent", """
    SELECT status, coalesce(last_outcome, '(null)') AS last_outcome, source, count(*) AS n, max(ts) AS last_processed FROM (SELECT CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'ready' ELSE 'processing' END AS status,
    CASE WHEN event_id % 3 > 0 THEN event_type END AS last_outcome, CASE WHEN user_id % 2 = 0 THEN 'auto' ELSE 'hand' END AS source, ts FROM events) WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 72 HOUR GROUP BY 1, 2, 3""")
def _(s, d):
    return A.queue_recent(_queue(s, d), F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'"), 72)


@query("A_20_queue_open", "SELECT event_id, left(props, 240) AS last_error FROM events WHERE event_type NOT IN ('purchase', 'error') ORDER BY ts, event_id LIMIT 30")
def _(s, d):
    return A.queue_open(_queue(s, d), "event_id").select("event_id", "last_error")


@query("A_21_status_deltas", "WITH b AS (SELECT o_orderstatus AS status, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS before, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS after FROM orders GROUP BY 1) SELECT *, after - before AS delta, abs(after - before) <= (SELECT sum(before) FROM b) * 0.01 AS plausible FROM b")
def _(s, d):
    rows = load(s, d, "orders").withColumnRenamed("o_orderstatus", "status")
    return A.status_deltas(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), 0.01)


@query("A_26_rollup", """
    SELECT sub, count(*) FILTER (WHERE k = 0) AS unchanged, count(*) FILTER (WHERE k = 1) AS added, count(*) FILTER (WHERE k = 2) AS removed FROM (SELECT p_brand || p_type AS sub, p_partkey % 40 AS k FROM part) GROUP BY 1 HAVING count(*) FILTER (WHERE k IN (1, 2)) > 0""")
def _(s, d):
    rows = load(s, d, "part").select(F.concat("p_brand", "p_type").alias("sub"), (F.col("p_partkey") % 40).alias("k"))
    return A.rolled_up({n: rows.where(F.col("k") == i) for i, n in enumerate(("unchanged", "added", "removed"))}, "sub")


@query("A_33_pending_lists", """
    WITH p AS (SELECT o_orderkey AS id, o_custkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS format, CASE WHEN o_orderkey % 2 = 0 THEN 'school' END AS provenance, round(date_diff('second', o_orderdate, TIMESTAMP '2002-01-01') / 3600.0, 2) AS age, CAST(floor(o_totalprice) AS INTEGER) AS size FROM orders WHERE o_orderstatus <> 'F')
    SELECT 'format' AS list, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS place, name, value FROM (SELECT coalesce(format, 'unknown') AS name, CAST(count(*) AS VARCHAR) AS value FROM p GROUP BY 1)
    UNION ALL SELECT 'provenance', row_number() OVER (ORDER BY name), name, value FROM (SELECT coalesce(provenance, 'unknown') AS name, CAST(count(*) AS VARCHAR) AS value FROM p GROUP BY 1)
    UNION ALL (SELECT 'o_custkey', row_number() OVER (ORDER BY n DESC, name) AS place, name, CAST(n AS VARCHAR) FROM (SELECT CAST(o_custkey AS VARCHAR) AS name, count(*) AS n FROM p GROUP BY 1) ORDER BY place LIMIT 10)
    UNION ALL (SELECT 'oldest', row_number() OVER (ORDER BY age DESC, id) AS place, CAST(id AS VARCHAR), CAST(CAST(age AS DOUBLE) AS VARCHAR) FROM p ORDER BY place LIMIT 15)
    UNION ALL (SELECT 'largest', row_number() OVER (ORDER BY size DESC, age DESC, id) AS place, CAST(id AS VARCHAR), CAST(size AS VARCHAR) FROM p WHERE size >= 100000 ORDER BY place LIMIT 15)""")
def _(s, d):
    k = F.col("o_orderkey")
    rows = load(s, d, "orders").where("o_orderstatus <> 'F'").select(k.alias("id"), "o_custkey", F.when(k % 5 > 0, F.col("o_orderpriority")).alias("source_format"), F.when(k % 2 == 0, "school").alias("source_provenance"), F.col("o_orderdate").alias("created_at"), F.floor("o_totalprice").cast("int").alias("size"))
    return A.backlog(rows, "id", "o_custkey", F.expr("TIMESTAMP_NTZ '2002-01-01 00:00:00'"), large=100_000)[1]


@query("A_34_completeness", """
    WITH q AS (SELECT l_orderkey % 5000 AS id, arg_max(l_linenumber % 8, (l_shipdate, l_shipmode)) AS fields FROM (SELECT l_orderkey, l_linenumber, l_shipdate, CAST(l_linenumber % 8 AS VARCHAR) AS l_shipmode FROM lineitem) GROUP BY 1),
    y AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderkey AS id, o_orderstatus AS st FROM orders)
    SELECT y.year, 9 AS corpus, count(*) AS discovered, count(*) FILTER (WHERE st = 'O') AS published, count(*) FILTER (WHERE st = 'P') AS verified_absent, count(*) FILTER (WHERE id % 2 = 0) AS archived, count(*) FILTER (WHERE id % 3 = 0) AS pending, count(*) FILTER (WHERE id % 3 = 1) AS extracted,
        count(*) FILTER (WHERE id % 3 = 2) AS failed, count(fields) AS canonical, count(*) FILTER (WHERE fields >= 5) AS high_quality, count(*) FILTER (WHERE fields BETWEEN 1 AND 4) AS low_quality, count(*) FILTER (WHERE fields = 0) AS blank
    FROM y LEFT JOIN q USING (id) WHERE y.year IN ('1996', '1997') GROUP BY 1 UNION ALL SELECT '2050', 9, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0""")
def _(s, d):
    lines = load(s, d, "lineitem")
    n = F.col("l_linenumber") % 8
    artifacts = lines.select((F.col("l_orderkey") % 5000).alias("document_id"), F.lit("canonical").alias("kind"), n.cast("string").alias("producer"), F.col("l_shipdate").alias("created_at"), n.alias("populated"), F.lit(None).cast("map<string,string>").alias("values"))
    k = F.col("o_orderkey")
    docs = load(s, d, "orders").select(k.alias("document_id"), F.year("o_orderdate").cast("string").alias("year"), F.when(F.col("o_orderstatus") == "O", "published").when(F.col("o_orderstatus") == "P", "verified_absent").alias("participation_status"),
                                       F.when(k % 3 == 0, "extraction_pending").when(k % 3 == 1, "extracted").otherwise("failed").alias("extraction_status"), F.when(k % 2 == 0, "h").alias("source_sha256"))
    return A.completeness(docs, A.canonical_quality(artifacts), ["1996", "1997", "2050"], 9)


@query("R_01_typed_fields", """
    SELECT event_id, field, text AS value_text, CASE WHEN field = 'amount' THEN TRY_CAST(replace(replace(text, '$', ''), ',', '') AS DOUBLE) END AS value_num, CASE WHEN field = 'flag' THEN CASE text WHEN '☒' THEN true WHEN 'No' THEN false END END AS value_bool,
        CASE field WHEN 'amount' THEN 'number' WHEN 'flag' THEN 'boolean' ELSE 'text' END AS value_kind, CASE WHEN field = 'amount' AND text = 'n/a' THEN 'parse_error' WHEN field = 'flag' AND text = 'maybe' THEN 'parse_error' ELSE 'reported' END AS value_status
    FROM (SELECT event_id, 'amount' AS field, CASE event_id % 3 WHEN 0 THEN 'n/a' ELSE '$1,' || (100 + event_id % 900) END AS text FROM events UNION ALL SELECT event_id, 'flag', CASE event_id % 4 WHEN 0 THEN '☒' WHEN 1 THEN 'No' ELSE 'maybe' END FROM events UNION ALL SELECT event_id, 'kind', event_type FROM events)""")
def _(s, d):
    k = F.col("event_id")
    payload = F.create_map(
        F.lit("amount"), F.when(k % 3 == 0, "n/a").otherwise(F.concat(F.lit("$1,"), (100 + k % 900).cast("string"))), F.lit("flag"), F.when(k % 4 == 0, " ☒ ").when(k % 4 == 1, "No").otherwise("maybe"), F.lit("kind"), F.col("event_type"),
    )
    kinds = s.createDataFrame([("amount", "number"), ("flag", "boolean")], "field string, kind string")
    return A.typed_fields(load(s, d, "events").select("event_id", payload.alias("payload")), "event_id", "payload", kinds)


@query("SRC_09_directory", """
    WITH w AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS n, c_custkey % 3 AS lvl, c_custkey % 5 AS deg, c_custkey % 7 = 0 AS shut FROM customer)
    SELECT CASE WHEN k < 1000000 THEN lpad(CAST(k AS VARCHAR), 6, '0') ELSE CAST(k AS VARCHAR) END AS ipeds_id, c_name AS school_name, CAST(n AS DOUBLE) AS undergraduate_enrollment, NOT shut AS currently_operating,
        CASE WHEN shut THEN 'closed' WHEN coalesce(n, 0) <= 0 THEN 'no_undergraduate_enrollment' WHEN lvl NOT IN (1, 2) THEN 'not_two_or_four_year' WHEN deg NOT IN (2, 3, 4) THEN 'non_degree_predominant' END AS exclusion_reason FROM w WHERE k > 0""")
def _(s, d):
    k = F.col("c_custkey")
    wide = load(s, d, "customer").select(F.concat(k.cast("string"), F.lit(".0")).alias("UNITID"), F.col("c_name").alias("INSTNM"), F.when(k % 4 > 0, F.concat(F.col("c_nationkey").cast("string"), F.lit(".0"))).otherwise("PrivacySuppressed").alias("UGDS"), (k % 3).alias("ICLEVEL"), (k % 5).alias("PREDDEG"), F.when(k % 7 == 0, 0).otherwise(1).alias("CURROPER"))
    return directory.directory_rows(wide, "2023").select("ipeds_id", "school_name", F.col("undergraduate_enrollment").cast("double").alias("undergraduate_enrollment"), "currently_operating", "exclusion_reason")


@query("SNK_12_latest_facts", """
    WITH l AS (SELECT * FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderkey, o_orderstatus FROM orders) WHERE y >= 1996 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC, o_orderkey) = 1)
    SELECT o_custkey, y, 'key' AS key, CAST(o_orderkey AS VARCHAR) AS value FROM l UNION ALL SELECT o_custkey, y, 'status', '"' || o_orderstatus || '"' FROM l""")
def _(s, d):
    rows = load(s, d, "orders").select(F.col("o_custkey").cast("string").alias("school"), F.year("o_orderdate").alias("y"), "o_orderkey", "o_orderstatus")
    facts = snapshots.latest_facts(rows, "school", "y", [("key", "Key", "o_orderkey", "a"), ("status", "Status", "o_orderstatus", "b")], ["school", "y", "o_orderkey"], 1996)
    return facts.select(F.col("school").cast("bigint").alias("o_custkey"), "y", "key", "value")


@query("J_09_missing_null_safe", """
    WITH a AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey END AS k FROM supplier), b AS (SELECT DISTINCT CASE WHEN c_custkey % 9 > 0 THEN c_nationkey END AS k FROM customer WHERE c_acctbal > 9900)
    SELECT s_suppkey FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.k IS NOT DISTINCT FROM b.k)""")
def _(s, d):
    ours = load(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 > 0, F.col("s_nationkey")).alias("k"))
    theirs = load(s, d, "customer").where("c_acctbal > 9900").select(F.when(F.col("c_custkey") % 9 > 0, F.col("c_nationkey")).alias("k"))
    return J.missing(ours, theirs, ["k"]).select("s_suppkey")


@query("Q_05_entered_rows", """
    WITH active AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'), batch AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')
    SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM batch WHERE o_custkey NOT IN (SELECT o_custkey FROM active) GROUP BY 1""")
def _(s, d):
    orders = load(s, d, "orders")
    queue = orders.select("o_custkey", F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    batch = orders.where("o_orderdate >= TIMESTAMP_NTZ '2000-01-01 00:00:00'").select("o_custkey", "o_orderkey")
    return Q.enqueued(queue, batch, "o_custkey", [F.asc("o_orderkey")])


@query("X_05_fractions", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value / 100 WHEN value > 1 THEN value / 100 ELSE value END AS f FROM events")
def _(s, d):
    text = F.when(F.col("event_id") % 3 == 0, "5 %").otherwise("5")
    return load(s, d, "events").select("event_id", X.fraction(F.col("value"), text).alias("f"))


@query("X_06_truth", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true END AS t FROM events")
def _(s, d):
    words = F.element_at(F.array(*map(F.lit, (" Yes", "☐", "☑", "N", "x", "perhaps"))), (F.col("event_id") % 6 + 1).cast("int"))
    return load(s, d, "events").select("event_id", X.truth(words).alias("t"))


@query("D_29_run_ids", "SELECT DISTINCT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS run_id FROM (SELECT sha256('daily-' || strftime(ts, '%Y-%m-%d')) AS h FROM events)")
def _(s, d):
    return load(s, d, "events").select(X.shaped_uuid(F.concat(F.lit("daily-"), F.date_format("ts", "yyyy-MM-dd"))).alias("run_id")).distinct()


@query("F_11_policy_rows", """
    SELECT 'public' AS role, doc_id FROM labels WHERE quality = 1 AND toxic = 0 UNION ALL SELECT 'reviewer', doc_id FROM labels WHERE (quality = 1 AND toxic = 0) OR CASE WHEN doc_id % 3 > 0 THEN toxic = 1 END""")
def _(s, d):
    open_rows = (F.col("quality") == 1) & (F.col("toxic") == 0)
    policies = {"public": [open_rows], "reviewer": [open_rows, F.when(F.col("doc_id") % 3 > 0, F.col("toxic") == 1)]}
    seen = [L.under_policy(load(s, d, "labels"), policies, role).select(F.lit(role).alias("role"), "doc_id") for role in ("public", "reviewer", "stranger")]
    return seen[0].union(seen[1]).union(seen[2])


@query("SRC_21_links_by_tags", r"""
    WITH m AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages)
    SELECT page_id, CAST(p - 1 AS INTEGER) AS position, h[p] AS href, trim(regexp_replace(t[p], '<[^>]*>', '', 'g')) AS label FROM (SELECT page_id, h, t, unnest(range(1, len(h) + 1)) AS p FROM m)""")
def _(s, d):
    return page_links(load(s, d, "pages"))
