"""Queries of the text, queue and display operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnwork.functions import scalars as X
from cairnwork.operators import filters as L
from cairnwork.operators import joins as J
from cairnwork.operators import lines as T
from cairnwork.operators import queue as Q
from cairnwork.operators import ranking as W
from cairnwork.plans.registry import query
from cairnwork.storage import load


@query("T_01_table_rows", r"""
    WITH d AS (SELECT doc_id, '| ' || replace(replace(text, '. ', chr(10) || '| '), ',', ' |') AS text FROM documents),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM d),
    p AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM l WHERE starts_with(ltrim(line), '|')),
    b AS (SELECT doc_id, min(place) OVER (PARTITION BY doc_id, run) AS start, place, regexp_replace(trim(line), '^\||\|$', '', 'g') AS body FROM p)
    SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(place AS INTEGER) AS "at", array_to_string(list_transform(string_split(body, '|'), lambda x: trim(x)), '~') AS cells FROM b WHERE NOT regexp_matches(body, '^[\s:|-]*-[\s:|-]*$')""")
def _(s, d):
    # sentences as rows and their parts as cells; the documents hold few tables of their own
    table = F.concat(F.lit("| "), F.replace(F.replace("text", F.lit(". "), F.lit("\n| ")), F.lit(","), F.lit(" |")))
    rows = T.with_sections(T.lines(load(s, d, "documents").select("doc_id", table.alias("text")), "doc_id", "text"), "doc_id")
    return T.table_rows(rows, "doc_id").select("doc_id", "start", "at", F.array_join("cells", "~").alias("cells"))


@query("T_05_sections", """
    WITH l AS (SELECT conv_id * 1000 + turn AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM conversations)
    SELECT id, section, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM (SELECT *, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY id ORDER BY place) AS section FROM l) GROUP BY 1, 2""")
def _(s, d):
    texts = load(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    rows = T.with_sections(T.lines(texts, "id", "text"), "id", F.when(F.length("line") < 40, F.col("line")))
    return rows.groupBy("id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def _queue(s, d):
    status = F.when(F.col("o_orderstatus") == "O", "in_work").when(F.col("o_orderstatus") == "P", "pending").otherwise("done")
    return load(s, d, "orders").select("o_orderkey", status.alias("status"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")).alias("claimed_at"), F.lit(1).alias("attempts"), "o_totalprice")


def _claim(s, d):
    now = F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return Q.claim(_queue(s, d), "o_orderkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], now, 600, 200)


@query("Q_claim", """
    WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-12-31 23:50:00') ORDER BY o_totalprice DESC, o_orderkey LIMIT 200)
    SELECT o_orderkey, CASE WHEN o_orderkey IN (FROM p) OR o_orderstatus = 'O' THEN 'in_work' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'done' END AS status, CASE WHEN o_orderkey IN (FROM p) THEN 2 ELSE 1 END AS attempts FROM orders""")
def _(s, d):
    return _claim(s, d)[0].select("o_orderkey", "status", "attempts")


@query("Q_timed_out", """
    SELECT o_orderkey, 'timed_out' AS outcome FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-12-31 23:50:00') ORDER BY o_totalprice DESC, o_orderkey LIMIT 200) WHERE o_orderstatus = 'O'""")
def _(s, d):
    return _claim(s, d)[1].select("o_orderkey", "outcome")


@query("J_06_latest_overlay", """
    SELECT c_custkey, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND (o_totalprice > 20 * c_acctbal OR (o_orderstatus = 'F' AND c_mktsegment = 'BUILDING')) GROUP BY 1""")
def _(s, d):
    orders = load(s, d, "orders").withColumn("c_custkey", F.col("o_custkey"))
    fits = "e.o_totalprice > 20 * b.c_acctbal OR (e.o_orderstatus = 'F' AND b.c_mktsegment = 'BUILDING')"
    order = [-F.unix_micros(F.col("e.o_orderdate").cast("timestamp")), -F.col("e.o_orderkey")]
    return J.latest_overlay(load(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), orders, ["c_custkey"], fits, order, ["o_orderkey"]).select("c_custkey", F.col("o_orderkey").cast("string").alias("o_orderkey"))


@query("J_26_radius", "SELECT c_custkey FROM (SELECT c_custkey, radians(c_custkey % 90) AS a, radians(c_acctbal / 100) AS b FROM customer) WHERE 2 * 3958.8 * asin(sqrt(pow(sin((a - radians(40)) / 2), 2) + cos(radians(40)) * cos(a) * pow(sin((b - radians(10)) / 2), 2))) <= 1500")
def _(s, d):
    miles = X.haversine_miles(F.lit(40.0), F.lit(10.0), (F.col("c_custkey") % 90).cast("double"), F.col("c_acctbal") / 100)
    return load(s, d, "customer").where(miles <= 1500).select("c_custkey")


@query("F_08_companions", "SELECT count(*) FILTER (WHERE c_acctbal > 0) AS passing, count(*) FILTER (WHERE c_acctbal > 0 AND n > 0) AS with_companion FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(s, d):
    counts = load(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    ok = L.condition("c_acctbal", ">", 0, True)
    return load(s, d, "customer").join(counts, "c_custkey", "left").agg(F.count_if(ok).alias("passing"), F.count_if(ok & F.col("n").isNotNull()).alias("with_companion"))


@query("F_14_coherence", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > l_discount THEN NULL ELSE l_tax END AS tax FROM lineitem")
def _(s, d):
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(~(F.col("l_tax") > F.col("l_discount")), F.col("l_tax")).alias("tax"))


@query("F_17_categories", "SELECT page_id, CASE WHEN url ILIKE '%blog%' THEN 'blog' WHEN url ILIKE '%/EN/%' THEN 'english' WHEN url ILIKE '%?%' THEN 'query' ELSE 'other' END AS kind FROM pages")
def _(s, d):
    url = F.col("url")
    return load(s, d, "pages").select("page_id", L.first_reason([(url.ilike("%blog%"), "blog"), (url.ilike("%/EN/%"), "english"), (url.ilike("%?%"), "query")], "other").alias("kind"))


@query("A_02_any_where", "SELECT user_id, bool_or(value > 400) FILTER (WHERE event_type = 'purchase') AS large, bool_or(value < 5) FILTER (WHERE event_type = 'click') AS small FROM events GROUP BY 1")
def _(s, d):
    return load(s, d, "events").groupBy("user_id").agg(F.expr("bool_or(value > 400) FILTER (WHERE event_type = 'purchase')").alias("large"), F.expr("bool_or(value < 5) FILTER (WHERE event_type = 'click')").alias("small"))


@query("A_03_distinct_answers", "SELECT o_custkey, count(DISTINCT CASE WHEN o_totalprice > 1000 THEN o_orderpriority END) AS answers FROM orders GROUP BY 1")
def _(s, d):
    return load(s, d, "orders").groupBy("o_custkey").agg(F.count_distinct(F.when(F.col("o_totalprice") > 1000, F.col("o_orderpriority"))).alias("answers"))


@query("A_33_backlog", "SELECT o_orderpriority, count(*) AS n, max(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01')) AS oldest_days FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def _(s, d):
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")).cast("bigint")
    return load(s, d, "orders").where("o_orderstatus <> 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max(age).alias("oldest_days"))


@query("L_04_blanks_last", "SELECT c_custkey FROM (SELECT c_custkey, c_name, max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) ORDER BY top DESC NULLS LAST, c_name LIMIT 100")
def _(s, d):
    top = load(s, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return load(s, d, "customer").join(top, "c_custkey", "left").orderBy(F.desc_nulls_last("top"), "c_name").limit(100).select("c_custkey")


@query("L_04_all_blanks_last", "SELECT c_custkey, c_name, max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY top DESC NULLS LAST, c_name, c_custkey")
def _(s, d):
    top = load(s, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return load(s, d, "customer").join(top, "c_custkey", "left").orderBy(F.desc_nulls_last("top"), "c_name", "c_custkey").select("c_custkey", "c_name", "top")


@query("R_06_grouped", "SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    counts = load(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat_ws(":", x["event_type"], x["n"].cast("string"))), ",").alias("kinds"))


@query("S_06_merged_maps", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, event_type AS t FROM events")
def _(s, d):
    base = F.from_json("props", "map<string,string>")
    over = F.when(F.col("event_type") == "error", F.create_map(F.lit("k"), F.lit("0"), F.lit("t"), F.col("event_type"))).otherwise(F.create_map(F.lit("t"), F.col("event_type")))
    merged = load(s, d, "events").select("event_id", X.merged_maps(base, over).alias("m"))
    return merged.select("event_id", F.col("m")["k"].cast("int").alias("k"), F.col("m")["t"].alias("t"))


@query("W_07_first_matching", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' AND o_totalprice > 2000 THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END, year(o_orderdate) DESC, o_orderkey) = 1")
def _(s, d):
    done = F.col("o_orderstatus") == "F"
    return W.first_per_key(load(s, d, "orders"), ["o_custkey"], [F.when(done & (F.col("o_totalprice") > 2000), 0).when(done, 1).otherwise(2), F.year("o_orderdate").desc(), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SNK_16_without_lower_ranked", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1")
def _(s, d):
    rows = load(s, d, "events").withColumn("day", F.col("ts").cast("date"))
    return W.first_per_key(rows, ["user_id", "event_type", "day"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("T_11_reconciled", "SELECT doc_id, count(*) AS copies, max(doc_id) OVER (PARTITION BY sha256(text)) AS newest FROM documents GROUP BY doc_id, text")
def _(s, d):
    counts = load(s, d, "documents").groupBy("doc_id", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("copies"))
    return counts.select("doc_id", "copies", F.max("doc_id").over(Window.partitionBy("h")).alias("newest"))


@query("T_14_captures", "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page FROM pages")
def _(s, d):
    return load(s, d, "pages").select("page_id", F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.nullif(F.regexp_extract("url", "[?&]page=([0-9]+)", 1), F.lit("")).alias("page"))
