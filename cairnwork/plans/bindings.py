"""Queries of the relational operators over a data directory, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnwork.functions import scalars as X
from cairnwork.operators import aggregates as A
from cairnwork.operators import filters as L
from cairnwork.operators import joins as J
from cairnwork.operators import ranking as W
from cairnwork.operators import upserts as U
from cairnwork.plans.registry import query
from cairnwork.storage import load
from cairnwork.streaming import usage


@query("W_01_latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(s, d):
    return W.first_per_key(load(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("W_03_precedence_pick", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) = 1")
def _(s, d):
    order = [F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2), F.desc("o_orderdate"), F.asc("o_orderkey")]
    return W.first_per_key(load(s, d, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("W_08_attribute_latest", "SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS last_purchase, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS last_click FROM events GROUP BY user_id")
def _(s, d):
    def last(kind):
        return F.max_by("value", F.when(F.col("event_type") == kind, F.struct("ts", "event_id")))

    return load(s, d, "events").groupBy("user_id").agg(last("purchase").alias("last_purchase"), last("click").alias("last_click"))


@query("W_12_collision_count", "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS n FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", "p_name", F.count("*").over(Window.partitionBy("p_name")).alias("n"))


@query("W_13_any_earlier", "SELECT event_id, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS had_error FROM events")
def _(s, d):
    return W.any_earlier(load(s, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "error", "had_error").select("event_id", "had_error")


@query("W_15_top_by_metric", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 200")
def _(s, d):
    return load(s, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(200).select("c_custkey", "c_acctbal")


@query("F_01_filter_engine", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_discount < 0.05 AND l_returnflag <> 'R' AND l_returnflag <> ''")
def _(s, d):
    fields = ["l_quantity", "l_discount", "l_returnflag", "l_orderkey", "l_linenumber"]
    tests = [("l_quantity", ">=", 10), ("l_discount", "<", 0.05), ("l_returnflag", "!=", "R"), ("l_returnflag", "is not blank", None)]
    return L.Search(load(s, d, "lineitem"), fields).rows(tests, ["l_orderkey", "l_linenumber", "l_quantity"])


@query("F_07_funnel", "SELECT count(*) AS in_scope, count(*) FILTER (WHERE text <> '') AS with_required, count(*) FILTER (WHERE text <> '' AND NOT n_chars >= 1000) AS failing, count(*) FILTER (WHERE text <> '' AND n_chars >= 1000) AS passing FROM documents")
def _(s, d):
    return L.funnel(load(s, d, "documents"), ["text"], [L.condition("n_chars", ">=", 1000, True)])


@query("F_09_first_reason", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice < 1000 THEN 'small' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'old' ELSE 'in scope' END AS reason FROM orders")
def _(s, d):
    old = F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")
    reason = L.first_reason([(F.col("o_orderstatus") == "P", "pending"), (F.col("o_totalprice") < 1000, "small"), (old, "old")], "in scope")
    return load(s, d, "orders").select("o_orderkey", reason.alias("reason"))


@query("F_18_semi_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(s, d):
    wanted = load(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return load(s, d, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@query("L_01_tiered_search", "SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'green' THEN 0 WHEN starts_with(lower(p_name), 'green') THEN 1 WHEN contains(lower(p_name), 'green') THEN 2 ELSE 3 END AS tier FROM part ORDER BY tier, p_retailprice DESC, p_partkey LIMIT 25")
def _(s, d):
    return load(s, d, "part").withColumn("tier", W.match_tier(F.col("p_name"), "green")).orderBy("tier", F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey", "p_name", "tier")


@query("L_03_page", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(s, d):
    return L.page(load(s, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 50).select("o_orderkey")


@query("J_02_inner_in_scope", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def _(s, d):
    return load(s, d, "orders").join(load(s, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("J_03_star", "SELECT c_custkey, n_name, r_name, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def _(s, d):
    counts = load(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    out = load(s, d, "customer").join(load(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.join(counts, "c_custkey", "left").select("c_custkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("J_08_exists_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def _(s, d):
    orders = load(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.with_exists_flag(load(s, d, "customer").select("c_custkey"), orders, ["c_custkey"], "has_orders")


@query("J_15_key_classes", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN b.k IS NULL THEN 'removed' ELSE 'added' END AS class FROM (SELECT DISTINCT doc_id AS k FROM documents) a FULL JOIN (SELECT DISTINCT vec_id AS k FROM embeddings) b ON a.k = b.k")
def _(s, d):
    return J.classified(load(s, d, "documents").select(F.col("doc_id").alias("k")), load(s, d, "embeddings").select(F.col("vec_id").alias("k")), "k")


@query("J_19_year_pairs", "WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) SELECT a.o_custkey, a.n AS prior_value, b.n AS latest_value FROM y a JOIN y b USING (o_custkey) WHERE a.y = 1996 AND b.y = 1997")
def _(s, d):
    return J.paired_counts(load(s, d, "orders"), "o_custkey", "o_orderdate", 1996, 1997)


@query("J_23_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    return load(s, d, "documents").join(load(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("J_27_overlay", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(l.quality, d.n) AS score FROM (SELECT doc_id, CAST(n_chars AS INTEGER) AS n FROM documents) d FULL JOIN labels l ON d.doc_id = l.doc_id")
def _(s, d):
    return J.overlay(load(s, d, "documents").select("doc_id", F.col("n_chars").cast("int").alias("score")), load(s, d, "labels").select("doc_id", F.col("quality").cast("int").alias("score")), "doc_id", ["score"])


@query("A_01_conditional_pivot", "SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'view') AS viewed, max(value) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def _(s, d):
    return A.conditional_pivot(load(s, d, "events"), ["user_id"], "event_type", "value", {"click": "click", "viewed": "view", "purchase": "purchase"})


@query("A_05_corpus_stats", "SELECT count(DISTINCT source) AS sources, count(*) AS docs, min(n_chars) FILTER (WHERE lang = 'en') AS least_en, max(n_chars) FILTER (WHERE lang = 'en') AS most_en, round(100.0 * count(*) FILTER (WHERE lang = 'en') / count(*), 1) AS pct_en FROM documents")
def _(s, d):
    en = F.col("lang") == "en"
    return load(s, d, "documents").agg(
        F.count_distinct("source").alias("sources"), F.count("*").alias("docs"), F.min(F.when(en, F.col("n_chars"))).alias("least_en"), F.max(F.when(en, F.col("n_chars"))).alias("most_en"),
        F.round(F.lit(100.0) * F.count_if(en) / F.count("*"), 1).alias("pct_en"),
    )


@query("A_10_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def _(s, d):
    return A.ranked_quantiles(load(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75, 0.9])


@query("A_13_histogram", "SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    return load(s, d, "documents").groupBy(A.bucket(F.col("n_chars"), [500, 2000], ["short", "medium", "long"]).alias("bucket")).agg(F.count("*").alias("n"))


@query("A_14_year_stage", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) AS total FROM orders GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FILTER (WHERE o_orderstatus = 'F'), count(*) FILTER (WHERE o_orderstatus = 'O'), count(*) FROM orders")
def _(s, d):
    aggs = [F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.count("*").alias("total")]
    return A.with_total(load(s, d, "orders").withColumn("y", F.year("o_orderdate").cast("string")), "y", aggs)


@query("A_30_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return A.repeated_keys(load(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("S_03_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(s, d):
    return load(s, d, "documents").select("doc_id").intersect(load(s, d, "labels").select("doc_id"))


@query("R_02_unpivot", "SELECT l_orderkey, l_linenumber, l_partkey, field, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, unnest(['quantity', 'discount', 'tax']) AS field, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem)")
def _(s, d):
    wide = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return wide.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["quantity", "discount", "tax"], "field", "value")


@query("D_02_rate", "SELECT o_orderkey, CASE WHEN r <= 1 THEN round(r, 6) END AS rate FROM (SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN o_totalprice / c_acctbal END AS r FROM orders JOIN customer ON o_custkey = c_custkey)")
def _(s, d):
    return load(s, d, "orders").join(load(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", X.safe_rate(F.col("o_totalprice"), F.col("c_acctbal")).alias("rate"))


@query("D_28_event_id", "SELECT event_id, substr(sha256(CAST(event_id AS VARCHAR) || '|' || coalesce(event_type, '') || '|' || CAST(user_id AS VARCHAR)), 1, 32) AS id FROM events")
def _(s, d):
    return load(s, d, "events").select("event_id", X.event_id(F.col("event_id"), F.col("event_type"), F.col("user_id")).alias("id"))


@query("X_10_slug", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("X_11_padded_id", "SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 6 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS id FROM customer")
def _(s, d):
    return load(s, d, "customer").select("c_custkey", X.padded_id(F.col("c_custkey")).alias("id"))


@query("W_05_latest_metric", "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(s, d):
    return W.first_per_key(load(s, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value")


@query("W_09_latest_slice", "SELECT o_orderkey FROM orders QUALIFY year(o_orderdate) = max(year(o_orderdate)) OVER (PARTITION BY o_custkey)")
def _(s, d):
    orders = load(s, d, "orders").withColumn("y", F.year("o_orderdate"))
    return orders.withColumn("m", F.max("y").over(Window.partitionBy("o_custkey"))).where("y = m").select("o_orderkey")


@query("W_14_rank_by_metric", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS rank FROM supplier")
def _(s, d):
    return W.ranked_overall(load(s, d, "supplier").select("s_suppkey", "s_acctbal"), [F.desc_nulls_last("s_acctbal"), F.asc("s_suppkey")]).select("s_suppkey", "rank")


@query("J_07_latest_child", "SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    latest = load(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return load(s, d, "customer").select("c_custkey").join(latest, "c_custkey", "left")


@query("J_09_not_exists_null_safe", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey IS NOT DISTINCT FROM s_nationkey AND c_acctbal > 9000)")
def _(s, d):
    rich = load(s, d, "customer").where("c_acctbal > 9000").select("c_nationkey").distinct()
    return load(s, d, "supplier").join(rich, F.col("s_nationkey").eqNullSafe(F.col("c_nationkey")), "left_anti").select("s_suppkey")


@query("J_13_normalised_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND upper(trim(n_name)) <> ''")
def _(s, d):
    nations = load(s, d, "nation").where(F.upper(F.trim("n_name")) != "").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return load(s, d, "customer").join(nations, "c_nationkey", "left").select("c_custkey", "n_name")


@query("A_06_distinct_array", "SELECT lang, list_aggregate(list_sort(list(DISTINCT source) FILTER (WHERE n_chars > 100)), 'string_agg', ',') AS sources FROM documents GROUP BY lang")
def _(s, d):
    return load(s, d, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("n_chars") > 100, F.col("source")))), ",").alias("sources"))


@query("A_09_median", "SELECT event_type, median(value) AS mid FROM events GROUP BY 1")
def _(s, d):
    return A.ranked_quantiles(load(s, d, "events"), ["event_type"], "value", [0.5], None).withColumnRenamed("p50", "mid")


@query("A_22_run_summary", "SELECT round(count(*) FILTER (WHERE event_type = 'error') * 1.0 / count(*), 4) AS error_rate, count(DISTINCT user_id) AS users FROM events")
def _(s, d):
    return load(s, d, "events").agg(F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 4).alias("error_rate"), F.count_distinct("user_id").alias("users"))


@query("A_32_most_common", "SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS priority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    counts = load(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return counts.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("priority"))


@query("S_01_layers", "SELECT doc_id AS id, 'doc' AS layer FROM documents UNION ALL SELECT page_id, 'page' FROM pages")
def _(s, d):
    docs = load(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("layer"))
    return docs.unionByName(load(s, d, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("layer")))


@query("D_18_severity", "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'major' WHEN o_totalprice >= 150000 THEN 'notable' WHEN o_totalprice >= 50000 THEN 'watch' ELSE 'none' END AS severity FROM orders")
def _(s, d):
    price = F.col("o_totalprice")
    return load(s, d, "orders").select("o_orderkey", L.first_reason([(price >= 300000, "major"), (price >= 150000, "notable"), (price >= 50000, "watch")], "none").alias("severity"))


@query("SNK_03_last_write_wins", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT user_id FROM events) UNION ALL SELECT user_id, CAST(arg_max(floor(value), (ts, event_id)) AS INTEGER) FROM events GROUP BY 1")
def _(s, d):
    batch = load(s, d, "events").select(F.col("user_id").alias("doc_id"), F.floor("value").cast("int").alias("quality"), "ts", "event_id")
    return U.last_write_wins(load(s, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), batch, ["doc_id"], [F.desc("ts"), F.desc("event_id")])


@query("SNK_05_insert_ignore", "SELECT doc_id, min(lang) AS lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def _(s, d):
    return U.insert_ignore(load(s, d, "labels"), load(s, d, "documents").select("doc_id", "lang"), ["doc_id"], [F.asc("lang")])


@query("SNK_06_upsert_keeping_reviewed", "SELECT d.doc_id, d.n_chars AS size, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang = 'en' UNION ALL SELECT doc_id, CAST(quality AS BIGINT), toxic FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(s, d):
    stored = load(s, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("size"), "toxic")
    batch = load(s, d, "documents").where("lang = 'en'").select("doc_id", F.col("n_chars").alias("size"), F.lit(0).cast(stored.schema["toxic"].dataType).alias("toxic"))
    return U.upsert_keeping(stored, batch, "doc_id", ["toxic"], F.col("size") == 1)


@query("SNK_08_update_from", "SELECT s_suppkey, s_name, CASE WHEN n IS NOT NULL THEN n ELSE s_acctbal END AS s_acctbal FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_extendedprice) AS n FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R' GROUP BY 1) ON l_suppkey = s_suppkey")
def _(s, d):
    top = load(s, d, "lineitem").where("l_quantity > 49 AND l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_extendedprice").alias("s_acctbal"))
    return U.update_from(load(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), top, "s_suppkey", ["s_acctbal"])


@query("STR_usage_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    return usage.windowed_usage(load(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
