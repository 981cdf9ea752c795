"""Queries of lookups, picks and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.operators import lookups as K
from cairnwork.operators import picks as P
from cairnwork.operators.ranking import first_per_key, ranked_overall
from cairnwork.plans.derived import bound, sql
from cairnwork.plans.registry import query
from cairnwork.storage import load


@query("J_01_outcome_dimension", "SELECT o_orderkey, CAST(days AS DOUBLE) AS days FROM orders LEFT JOIN (VALUES ('F', 30), ('O', 14)) t(s, days) ON s = o_orderstatus")
def _(s, d):
    days = s.createDataFrame([("F", 30), ("O", 14)], "o_orderstatus string, days int")
    return load(s, d, "orders").join(days, "o_orderstatus", "left").select("o_orderkey", F.col("days").cast("double").alias("days"))


@query("J_04_latest_with_counts", """
    SELECT c_custkey, CAST(o_orderkey AS DOUBLE) AS o_orderkey, n, label FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) l ON l.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (VALUES ('F', 'filled'), ('O', 'open')) t(st, label) ON st = o_orderstatus""")
def _(s, d):
    orders = load(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    latest = first_per_key(orders, ["c_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("c_custkey", "o_orderkey", "o_orderstatus")
    counts = orders.where("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.count("*").cast("double").alias("n"))
    out = load(s, d, "customer").select("c_custkey").join(latest, "c_custkey", "left").join(counts, "c_custkey", "left")
    return out.select("c_custkey", F.col("o_orderkey").cast("double").alias("o_orderkey"), "n", K.mapped(F.col("o_orderstatus"), {"F": "filled", "O": "open"}).alias("label"))


@query("J_05_defined_fields", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand FROM lineitem JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') o ON o.o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey AND p_size = l_linenumber""")
def _(s, d):
    urgent = load(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    suppliers = load(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    parts = load(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("bigint").alias("size"), "p_brand")
    lines = load(s, d, "lineitem").withColumn("size", F.col("l_linenumber").cast("bigint"))
    return lines.join(urgent, "l_orderkey", "left_semi").join(suppliers, "l_suppkey").join(parts, ["l_partkey", "size"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand")


@query("J_10_one_row_totals", "SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT max(n_chars) FROM documents) AS longest, (SELECT r_name FROM region WHERE r_regionkey = 99) AS region")
def _(s, d):
    one = s.range(1).select(F.lit(1).alias("one"))
    frames = [load(s, d, "customer").agg(F.count("*").alias("customers")), load(s, d, "orders").agg(F.count("*").alias("orders")), load(s, d, "documents").agg(F.max("n_chars").alias("longest"))]
    for f in frames:  # one row each
        one = one.join(F.broadcast(f.withColumn("one", F.lit(1))), "one")
    region = load(s, d, "region").where("r_regionkey = 99").select(F.lit(1).alias("one"), F.col("r_name").alias("region"))
    return one.join(F.broadcast(region), "one", "left").drop("one")


@query("J_11_fan_out", "SELECT c_custkey, CAST(o_orderkey AS DOUBLE) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL OR o_orderstatus = 'P' OR c_acctbal < 0")
def _(s, d):
    orders = load(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    kept = F.col("o_orderkey").isNull() | (F.col("o_orderstatus") == "P") | (F.col("c_acctbal") < 0)
    return K.fan_out(load(s, d, "customer"), orders, "c_custkey", kept).select("c_custkey", F.col("o_orderkey").cast("double").alias("o_orderkey"))


@query("J_12_three_lookups", """
    SELECT o_orderkey, n_name, label, clicks FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (VALUES ('BUILDING', 'b'), ('MACHINERY', 'm')) t(m, label) ON m = c_mktsegment
    LEFT JOIN (SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY 1) e ON user_id = o_custkey""")
def _(s, d):
    clicks = load(s, d, "events").groupBy(F.col("user_id").alias("o_custkey")).agg(F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("clicks"))
    customers = load(s, d, "customer").join(load(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("o_custkey"), "n_name", "c_mktsegment")
    out = load(s, d, "orders").join(customers, "o_custkey", "left").join(clicks, "o_custkey", "left")
    return out.select("o_orderkey", "n_name", K.mapped(F.col("c_mktsegment"), {"BUILDING": "b", "MACHINERY": "m"}).alias("label"), "clicks")


@query("J_13_label_lookup", """
    SELECT l_orderkey, l_linenumber, l_partkey, label FROM lineitem LEFT JOIN (VALUES ('T', 'A', '1', 'one'), ('T', 'R', '2', 'two'), ('T', 'N', '3', 'three')) v(t, c, n, label) ON c = l_returnflag AND n = CAST(l_linenumber AS VARCHAR) AND l_suppkey % 2 = 0""")
def _(s, d):
    labels = s.createDataFrame([(" t", "a ", "1", "one"), ("T", "r", " 2 ", "two"), ("t ", "N", "3", "three"), ("T", "n ", "3", "unused")], "tab string, flag string, num string, label string")
    rows = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_suppkey") % 2 == 0, "T").otherwise("U").alias("tab"), F.concat(F.lit(" "), F.lower("l_returnflag")).alias("flag"), F.col("l_linenumber").alias("num"))
    return K.with_labels(rows, labels, ["tab", "flag", "num"], "label").select("l_orderkey", "l_linenumber", "l_partkey", "label")


@query("J_18_name_agreement", """
    SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'NOT_FOUND' WHEN p_size % 7 = 1 THEN 'EXACT' WHEN p_size % 7 IN (2, 3) THEN 'EXACT (suffix-stripped)' WHEN p_size % 7 = 4 THEN 'PARTIAL' ELSE 'MISMATCH' END AS agreement FROM part""")
def _(s, d):
    k = F.col("p_size") % 7
    official = F.when(k == 0, None).when(k == 1, F.upper("p_name")).when(k == 2, F.concat("p_name", F.lit(", main"))).when(k == 3, F.concat("p_name", F.lit("-north, main"))).when(k == 4, F.concat(F.lit("the "), "p_name")).when(k == 5, "").otherwise("something else")
    return load(s, d, "part").select("p_partkey", K.name_agreement(F.concat("p_name", F.lit(" ")), official).alias("agreement"))


@query("J_20_companions", """
    WITH v AS (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY 1, 2) SELECT a.user_id, a.event_type, a.value, b.event_type AS companion, b.value AS companion_value FROM v a LEFT JOIN v b ON b.user_id = a.user_id AND b.event_type = CASE a.event_type WHEN 'click' THEN 'view' ELSE 'signup' END
    WHERE a.event_type IN ('click', 'purchase') AND b.value IS NOT NULL UNION ALL SELECT a.user_id, a.event_type, a.value, CASE a.event_type WHEN 'click' THEN 'view' ELSE 'signup' END, NULL FROM v a WHERE a.event_type IN ('click', 'purchase') AND NOT EXISTS (SELECT 1 FROM v b WHERE b.user_id = a.user_id AND b.event_type = CASE a.event_type WHEN 'click' THEN 'view' ELSE 'signup' END)""")
def _(s, d):
    values = load(s, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return K.with_companion(values, ["user_id"], "event_type", "value", {"click": "view", "purchase": "signup"})


EXPECTED = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN concat(CAST(c_nationkey AS VARCHAR), '.0') ELSE 'other' END AS expected, c_custkey % 5 = 0 AS critical FROM customer"


@query("J_21_checked_values", f"""
    SELECT e.id, field, CASE WHEN field IS NULL THEN 'no id map entry' WHEN actual IS NULL THEN 'not in output' WHEN NOT coalesce(expected = actual OR CASE WHEN contains(expected, '.') THEN abs(TRY_CAST(expected AS DOUBLE) - TRY_CAST(actual AS DOUBLE)) < 0.005 ELSE CAST(TRY_CAST(actual AS DOUBLE) AS BIGINT) = CAST(TRY_CAST(expected AS DOUBLE) AS BIGINT) END, false) THEN 'value mismatch' END AS reason
    FROM ({EXPECTED}) e LEFT JOIN (SELECT c_custkey AS id, 'f' || c_custkey AS field FROM customer WHERE c_custkey % 7 > 0) m ON m.id = e.id LEFT JOIN (SELECT 'f' || c_custkey AS f, CAST(c_nationkey AS VARCHAR) AS actual FROM customer WHERE c_custkey % 11 > 0) o ON o.f = field""")
def _(s, d):
    return _checked(s, d).select("id", "field", "reason")


@query("A_27_accuracy", f"""
    WITH r AS (SELECT e.*, field, coalesce(expected = actual OR CASE WHEN contains(expected, '.') THEN abs(TRY_CAST(expected AS DOUBLE) - TRY_CAST(actual AS DOUBLE)) < 0.005 ELSE CAST(TRY_CAST(actual AS DOUBLE) AS BIGINT) = CAST(TRY_CAST(expected AS DOUBLE) AS BIGINT) END, false) AS ok
    FROM ({EXPECTED}) e LEFT JOIN (SELECT c_custkey AS id, 'f' || c_custkey AS field FROM customer WHERE c_custkey % 7 > 0) m ON m.id = e.id LEFT JOIN (SELECT 'f' || c_custkey AS f, CAST(c_nationkey AS VARCHAR) AS actual FROM customer WHERE c_custkey % 11 > 0) o ON o.f = field)
    SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS matched, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 1) AS pct, count(*) FILTER (WHERE critical) AS critical, count(*) FILTER (WHERE critical AND ok) AS critical_matched, round(100.0 * count(*) FILTER (WHERE critical AND ok) / count(*) FILTER (WHERE critical), 1) AS critical_pct, count(*) FILTER (WHERE field IS NULL) AS unmapped FROM r""")
def _(s, d):
    return K.accuracy(_checked(s, d))


def _checked(s, d):
    customers = load(s, d, "customer")
    nation, k = F.col("c_nationkey").cast("string"), F.col("c_custkey")
    expected = customers.select(k.alias("id"), F.when(k % 3 == 0, nation).when(k % 3 == 1, F.concat(nation, F.lit(".0"))).otherwise("other").alias("expected"), (k % 5 == 0).alias("critical"))
    name = F.concat(F.lit("f"), k.cast("string")).alias("field")
    return K.checked(expected, customers.where("c_custkey % 7 > 0").select(k.alias("id"), name), customers.where("c_custkey % 11 > 0").select(name, nation.alias("actual")))


DOCS = "SELECT s_suppkey AS id, s_suppkey % 40 AS official, CASE WHEN s_suppkey % 3 = 0 THEN 'c' || s_suppkey % 40 ELSE 'x' || s_suppkey % 6 END AS school, CASE WHEN s_nationkey % 4 > 0 THEN s_nationkey % 4 END AS sub FROM supplier"
CANDIDATES = f"SELECT * FROM (SELECT *, 'c' || official AS canonical, count(*) OVER (PARTITION BY official, sub) AS n FROM ({DOCS}) WHERE official < 30 AND school <> 'c' || official)"


@query("J_22_canonicalised", f"""
    WITH docs AS ({DOCS}), u AS (SELECT c.id, c.canonical FROM ({CANDIDATES}) c WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM docs e WHERE e.school = c.canonical AND e.sub IS NOT DISTINCT FROM c.sub)) SELECT docs.id, coalesce(u.canonical, docs.school) AS school FROM docs LEFT JOIN u ON u.id = docs.id""")
def _(s, d):
    return _canonical(s, d)[0].select("id", "school")


@query("J_22_redirects", f"SELECT DISTINCT official, canonical, school AS alias FROM ({CANDIDATES})")
def _(s, d):
    return _canonical(s, d)[1]


def _canonical(s, d):
    k = F.col("s_suppkey")
    official, nation = k % 40, F.col("s_nationkey") % 4
    school = F.when(k % 3 == 0, F.concat(F.lit("c"), official.cast("string"))).otherwise(F.concat(F.lit("x"), (k % 6).cast("string")))
    docs = load(s, d, "supplier").select(k.alias("id"), official.alias("official"), school.alias("school"), F.when(nation > 0, nation).alias("sub"))
    walk = s.range(30).select(F.col("id").cast(docs.schema["official"].dataType).alias("official"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("canonical"))
    return K.canonicalised(docs, walk, "id", "official", "school", ["sub"])


@query("J_24_stale_ids", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') AND toxic = 0")
def _(s, d):
    current = load(s, d, "documents").where("lang = 'en'").select("doc_id")
    return load(s, d, "labels").where("toxic = 0").join(current, "doc_id", "left_anti").select("doc_id")


@query("J_25_prefix_points", """
    SELECT c_custkey, lat FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE lpad(CAST(c_custkey % 900 + 100 AS VARCHAR), 3, '0') || '07' END AS zip FROM customer) LEFT JOIN (SELECT CAST(n_nationkey * 9 + 100 AS VARCHAR) AS p, n_nationkey * 1.5::DOUBLE AS lat FROM nation) ON p = CASE WHEN length(zip) = 5 THEN substr(zip, 1, 3) END""")
def _(s, d):
    points = load(s, d, "nation").select((F.col("n_nationkey") * 9 + 100).cast("string").alias("p"), (F.col("n_nationkey") * F.lit(1.5)).alias("lat"))
    k = F.col("c_custkey")
    rows = load(s, d, "customer").select(k, F.when(k % 4 == 0, "x").otherwise(F.concat(F.lpad((k % 900 + 100).cast("string"), 3, "0"), F.lit("07 "))).alias("zip"))
    return K.by_prefix(rows, points, "zip", "p").select("c_custkey", "lat")


@query("D_07_coverage_copy", """
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'CDS available' WHEN 1 THEN 'Older CDS available' WHEN 2 THEN 'Not checked yet' ELSE 'Out of scope' END AS label, CASE c_custkey % 4 WHEN 0 THEN 'We have a CDS for ' || c_name || CASE WHEN c_nationkey > 9 THEN ' from ' || CAST(c_nationkey + 2000 AS VARCHAR) ELSE '' END || '.'
        WHEN 1 THEN 'We have an older CDS for ' || c_name || CASE WHEN c_nationkey > 9 THEN ' from ' || CAST(c_nationkey + 2000 AS VARCHAR) ELSE '' END || CASE WHEN c_acctbal > 0 THEN '. We found a possible newer source but it could not be accessed automatically.' ELSE '; we could not find a newer one in our latest scan.' END
        WHEN 2 THEN c_name || ' is in our institution directory, but we have not completed a public CDS scan for it yet.' ELSE '' END AS summary FROM customer""")
def _(s, d):
    status = K.mapped(F.col("c_custkey") % 4, {0: "cds_available_current", 1: "cds_available_stale", 2: "not_checked", 3: "out_of_scope"})
    year = F.when(F.col("c_nationkey") > 9, (F.col("c_nationkey") + 2000).cast("string"))
    return load(s, d, "customer").select("c_custkey", K.mapped(status, K.COVERAGE_LABELS).alias("label"), K.coverage_summary(F.col("c_name"), status, year, F.col("c_acctbal") > 0, F.lit(None).cast("string")).alias("summary"))


@query("D_08_search_text", "SELECT c_custkey, lower(c_name || ' ' || coalesce(array_to_string(CASE WHEN c_nationkey > 5 THEN [c_mktsegment, n_name] END, ' '), '') || ' ' || coalesce(nullif(n_name, 'FRANCE'), '')) AS search FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(s, d):
    aliases = F.when(F.col("c_nationkey") > 5, F.array_join(F.array("c_mktsegment", "n_name"), " "))
    rows = load(s, d, "customer").join(load(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", K.search_text(F.col("c_name"), aliases, F.nullif(F.col("n_name"), F.lit("FRANCE"))).alias("search"))


@query("D_21_public_flags", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN 'admissions' WHEN 1 THEN 'cost' WHEN 2 THEN 'outcomes' ELSE 'identity' END AS category, CASE WHEN l_returnflag = 'A' THEN 'imputed' WHEN l_suppkey % 3 = 0 THEN 'definition_mismatch' WHEN l_linenumber = 2 THEN 'provisional' WHEN l_returnflag = 'R' THEN 'reported' ELSE 'not_available' END AS flag FROM lineitem""")
def _(s, d):
    text = K.mapped(F.col("l_partkey") % 4, {0: "Admissions Costs", 1: "Net price", 2: "Graduation rates", 3: "Other"})
    quality = K.mapped(F.col("l_returnflag"), {"A": "imputed", "R": "reported", "N": "x"})
    alignment, release = F.when(F.col("l_suppkey") % 3 == 0, "near").otherwise("same"), F.when(F.col("l_linenumber") == 2, "provisional").otherwise("final")
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", K.fact_category(text).alias("category"), K.fact_flag(quality, F.lit(None).cast("string"), alignment, release).alias("flag"))


@query("D_22_static_facts", """
    SELECT c_custkey, u.key, u.value, u.shown, CASE WHEN u.value IS NULL THEN 'not_available' ELSE 'reported' END AS flag FROM (SELECT c_custkey, unnest([{'key': 'name', 'value': c_name, 'shown': c_name}, {'key': 'open', 'value': CASE WHEN c_nationkey > 9 THEN 'true' ELSE 'false' END, 'shown': CASE WHEN c_nationkey > 9 THEN 'Yes' ELSE 'No' END},
        {'key': 'share', 'value': CASE WHEN c_custkey % 3 > 0 THEN CAST((c_custkey % 3) / 4.0::DOUBLE AS VARCHAR) END, 'shown': CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 3 * 25 AS VARCHAR) || '%' ELSE 'Not available' END}, {'key': 'cost', 'value': CAST(CAST(c_custkey * 1000 AS DOUBLE) AS VARCHAR), 'shown': '$' || format('{:,}', c_custkey * 1000)}]) AS u FROM customer)""")
def _(s, d):
    k = F.col("c_custkey")
    rows = load(s, d, "customer").select(k, "c_name", (F.col("c_nationkey") > 9).alias("open"), F.when(k % 3 > 0, F.concat(((k % 3) * 25).cast("string"), F.lit("%"))).alias("share"), F.concat(F.lit("$"), (k * 1000).cast("string")).alias("cost"))
    out = K.unpivoted_facts(rows, ["c_custkey"], {"name": ("c_name", "string"), "open": ("open", "boolean"), "share": ("share", "percent"), "cost": ("cost", "money")})
    number = F.col("value").try_cast("double")
    return out.withColumn("value", F.when(F.col("key") == "cost", F.concat(number.cast("bigint").cast("string"), F.lit(".0"))).otherwise(F.col("value")))


@query("D_26_diagnosis", """
    SELECT c_custkey, coalesce(nullif(array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 AND NOT c_nationkey > 9 THEN 'theirs_not_ours' END, CASE WHEN c_custkey % 3 = 0 AND c_acctbal < 0 THEN 'counts_missing' END, CASE WHEN c_nationkey > 9 AND c_custkey % 2 = 1 THEN 'ours_not_theirs' END], lambda x: x IS NOT NULL), ','), ''), 'aligned') AS issues FROM customer""")
def _(s, d):
    theirs, ours = F.col("c_custkey") % 2 == 0, F.col("c_nationkey") > 9
    return load(s, d, "customer").select("c_custkey", K.issue_list([(theirs & ~ours, "theirs_not_ours"), ((F.col("c_custkey") % 3 == 0) & (F.col("c_acctbal") < 0), "counts_missing"), (ours & ~theirs, "ours_not_theirs")]).alias("issues"))


@query("D_27_source_mode", "SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS baseline, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'with_baseline' ELSE 'own_only' END AS mode FROM documents d")
def _(s, d):
    from cairnwork.operators.joins import with_exists_flag

    flagged = with_exists_flag(load(s, d, "documents").select("doc_id"), load(s, d, "labels"), ["doc_id"], "baseline")
    return flagged.withColumn("mode", F.when(F.col("baseline"), "with_baseline").otherwise("own_only"))


@query("W_02_latest_since", """
    SELECT user_id, event_id, event_type FROM events WHERE event_type IN ('purchase', 'error') AND ts >= TIMESTAMP '2024-01-10' AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(s, d):
    status = K.mapped(F.col("event_type"), {"purchase": "done", "error": "failed_permanent"})
    queue = load(s, d, "events").select("user_id", F.col("event_id").alias("id"), F.coalesce(status, F.lit("ready")).alias("status"), F.col("ts").alias("processed_at"), F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("last_outcome"))
    keys = load(s, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("user_id"))
    out = P.latest_outcomes(queue, "user_id", keys, F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    return out.select("user_id", F.split_part("last_outcome", F.lit("|"), F.lit(1)).cast("bigint").alias("event_id"), F.split_part("last_outcome", F.lit("|"), F.lit(2)).alias("event_type"))


@query("W_10_primary_rows", """
    SELECT o_custkey, y, o_orderkey FROM (SELECT *, year(o_orderdate) AS y FROM orders WHERE o_orderpriority <> '5-LOW') QUALIFY row_number() OVER (PARTITION BY o_custkey, y ORDER BY o_orderstatus = 'P', o_orderpriority <> '1-URGENT', CAST(o_orderkey AS VARCHAR)) = 1""")
def _(s, d):
    orders = load(s, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "x").alias("sub"),
                                         F.when(F.col("o_orderstatus") == "P", "wrong_file").alias("flag"), F.when(F.col("o_orderpriority") == "1-URGENT", "school_direct").alias("src"))
    return P.primary_rows(orders, ["o_custkey", "y"], "sub", "flag", "src", "o_orderkey").select("o_custkey", F.col("y").cast("bigint").alias("y"), "o_orderkey")


@query("W_11_redundant_work", """
    SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'click', ts, event_id) AS r FROM events WHERE event_type IN ('click', 'view')) WHERE r > 1 AND event_type = 'view'""")
def _(s, d):
    status = K.mapped(F.col("event_type"), {"click": "processing", "view": "ready"})
    queue = load(s, d, "events").select("user_id", F.col("event_id").alias("id"), F.coalesce(status, F.lit("done")).alias("status"), F.col("ts").alias("enqueued_at"))
    return P.redundant_work(queue, "user_id").select(F.col("id").alias("event_id"))


@query("W_16_latest_scan", "SELECT user_id, min(event_id) AS event_id FROM (SELECT * FROM events QUALIFY CAST(ts AS DATE) = max(CAST(ts AS DATE)) OVER (PARTITION BY user_id)) GROUP BY 1")
def _(s, d):
    rows = load(s, d, "events").withColumn("day", F.col("ts").cast("date"))
    return first_per_key(rows, ["user_id"], [F.desc("day"), F.asc("event_id")]).select("user_id", "event_id")


@query("W_17_latest_run", "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def _(s, d):
    return load(s, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("W_18_document_of_year", """
    SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority <> '1-URGENT', o_totalprice < 1000, o_orderdate, o_orderkey) = 1""")
def _(s, d):
    docs = load(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", K.mapped(F.col("o_orderstatus"), {"P": "extraction_pending", "O": "failed", "F": "extracted"}).alias("st"),
                                       F.when(F.col("o_orderpriority") == "1-URGENT", P.REDRAIN_FORMATS[0]).otherwise("xlsx").alias("fmt"), F.when(F.col("o_totalprice") < 1000, "low_coverage").alias("flag"))
    return P.document_of_year(docs, ["o_custkey"], "st", "fmt", "flag", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


ANCHORS = """SELECT user_id, event_id AS position, 'u' || event_id % 50 || CASE WHEN event_id % 3 = 0 THEN '#p' ELSE '' END AS url, CASE WHEN event_type <> 'error' THEN 'document' ELSE 'subpage' END AS kind, event_type = 'view' AS is_section, event_id % 11 = 0 AS is_reference, event_type = 'purchase' AS is_test,
    CASE WHEN event_id % 4 > 0 THEN CAST(2020 + event_id % 4 AS VARCHAR) END AS year, CASE WHEN event_type = 'view' THEN substr('ABCD', CAST(event_id % 4 + 1 AS INTEGER), 1) END AS section FROM events"""


def _anchors(s, d):
    k = F.col("event_id")
    return load(s, d, "events").select(
        "user_id", k.alias("position"), F.concat(F.lit("u"), (k % 50).cast("string"), F.when(k % 3 == 0, "#p").otherwise("")).alias("url"), F.when(F.col("event_type") != "error", "document").otherwise("subpage").alias("kind"),
        (F.col("event_type") == "view").alias("is_section"), (k % 11 == 0).alias("is_reference"), (F.col("event_type") == "purchase").alias("is_test"), F.when(k % 4 > 0, (2020 + k % 4).cast("string")).alias("year"),
        F.when(F.col("event_type") == "view", F.substring(F.lit("ABCD"), (k % 4 + 1).cast("int"), F.lit(1))).alias("section"),
    )


@query("W_20_best_anchor", f"SELECT user_id, position FROM ({ANCHORS}) WHERE kind = 'document' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY is_section, is_reference, is_test, year IS NULL, year DESC, position) = 1")
def _(s, d):
    return P.best_anchor(_anchors(s, d), "user_id").select("user_id", "position")


@query("W_19_yearly_candidates", f"""
    WITH a AS (SELECT *, split_part(url, '#', 1) AS u FROM ({ANCHORS}) WHERE NOT is_reference QUALIFY row_number() OVER (PARTITION BY user_id, u ORDER BY position) = 1),
    y AS (SELECT user_id, year, arg_min(url, position) FILTER (WHERE NOT is_section AND NOT is_test) AS clean, arg_min(url, position) FILTER (WHERE NOT is_section AND is_test) AS test, string_agg(url, ' ' ORDER BY section, position) FILTER (WHERE section IS NOT NULL) AS parts, count(section) AS n, arg_min(url, position) FILTER (WHERE section = 'C') AS c FROM a WHERE year IS NOT NULL GROUP BY 1, 2)
    SELECT user_id, year, CASE WHEN clean IS NOT NULL THEN 'document' WHEN test IS NOT NULL THEN 'test' WHEN n >= 2 THEN 'package' ELSE 'section_c' END AS kind, coalesce(clean, test, CASE WHEN n >= 2 THEN parts END, c) AS urls FROM y WHERE coalesce(clean, test, CASE WHEN n >= 2 THEN parts END, c) IS NOT NULL
    UNION ALL SELECT user_id, NULL, 'undated', min(url) FROM a GROUP BY 1 HAVING count(*) = 1 AND count(year) = 0""")
def _(s, d):
    return P.yearly_candidates(_anchors(s, d), "user_id")


@query("W_21_pending_order", "SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(CASE WHEN o_orderkey % 5 > 0 THEN year(o_orderdate) END, -1) DESC, o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'")
def _(s, d):
    rows = load(s, d, "orders").where("o_orderstatus = 'P'").withColumn("span", F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise("unknown"))
    return ranked_overall(rows.select("o_orderkey", "span", "o_orderdate"), P.pending_order("span", "o_orderdate", "o_orderkey"), "place").select("o_orderkey", "place")


@query("W_22_name_winner", "SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) = 1 AS wins FROM part")
def _(s, d):
    return P.claimed_names(load(s, d, "part"), "p_name", "p_size", "p_partkey").select("p_partkey", "wins")


SLUGS = "SELECT p_partkey, p_name AS a, p_name || '-' || p_brand AS b, p_name || '-' || p_brand || '-' || p_partkey AS c FROM part"


@query("X_10_assigned_slugs", f"""
    WITH r AS ({SLUGS}), t1 AS (SELECT p_partkey, a AS slug FROM r WHERE a <> 'red widget' QUALIFY count(*) OVER (PARTITION BY a) = 1), r2 AS (SELECT * FROM r WHERE p_partkey NOT IN (SELECT p_partkey FROM t1)), t2 AS (SELECT p_partkey, b AS slug FROM r2 QUALIFY count(*) OVER (PARTITION BY b) = 1)
    SELECT p_partkey, slug, 'a' AS tier FROM t1 UNION ALL SELECT p_partkey, slug, 'b' FROM t2 UNION ALL SELECT p_partkey, c, 'c' FROM r2 WHERE p_partkey NOT IN (SELECT p_partkey FROM t2)""")
def _(s, d):
    rows = load(s, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat_ws("-", "p_name", "p_brand").alias("b"), F.concat_ws("-", "p_name", "p_brand", F.col("p_partkey").cast("string")).alias("c"))
    return P.assigned_slugs(rows, ["a", "b", "c"], s.createDataFrame([("red widget",)], "slug string"), "p_partkey")


@query("L_07_severity_order", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 9 END, o_orderkey) AS place FROM orders")
def _(s, d):
    rows = load(s, d, "orders").select("o_orderkey", K.mapped(F.col("o_orderstatus"), {"P": "major", "O": "notable"}).alias("severity"))
    return ranked_overall(rows, P.severity_order("severity", "o_orderkey"), "place").select("o_orderkey", "place")


@query("L_08_alphabetic_severity", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'major' WHEN 'O' THEN 'notable' ELSE 'watch' END AS severity FROM orders) ORDER BY severity, o_orderkey LIMIT 5")
def _(s, d):
    rows = load(s, d, "orders").select("o_orderkey", F.coalesce(K.mapped(F.col("o_orderstatus"), {"P": "major", "O": "notable"}), F.lit("watch")).alias("severity"))
    return rows.orderBy("severity", "o_orderkey").limit(5).select("o_orderkey")


@query("L_06_collated_order", "SELECT p_partkey, row_number() OVER (ORDER BY lower(n), CASE WHEN n = lower(n) THEN 0 ELSE 1 END, p_partkey) AS place FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE lower(p_name) END AS n FROM part)")
def _(s, d):
    rows = load(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.lower("p_name")).alias("n"))
    return ranked_overall(rows, [P.collated("n"), F.asc("p_partkey")], "place").select("p_partkey", "place")


@query("L_09_top_of_each", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 5")
def _(s, d):
    from cairnwork.operators.ranking import ranked

    return ranked(load(s, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")]).where("rank <= 5").select("p_brand", "p_partkey")


@query("L_10_candidate_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY -floor(value), event_type <> 'purchase', -length(props), event_id) AS place FROM events")
def _(s, d):
    from cairnwork.operators.recommend import candidate_order
    from cairnwork.operators.ranking import ranked

    rows = load(s, d, "events").select("user_id", F.col("event_id").alias("id"), F.floor("value").alias("score"), (F.col("event_type") == "purchase").alias("direct"), F.length("props").alias("dimensions"))
    return ranked(rows, ["user_id"], candidate_order(), "place").select("user_id", F.col("id").alias("event_id"), "place")


@query("L_11_asked_ids", "SELECT position, c_custkey, c_name FROM (VALUES (0, 9), (1, 3), (2, 77)) w(position, id) JOIN customer ON c_custkey = id")
def _(s, d):
    return P.asked_ids(load(s, d, "customer"), [" 9", "3", "", "9", "77 ", "no number"], "c_custkey").select("position", "c_custkey", "c_name")


@query("S_05_two_kinds_of_signals", "SELECT user_id AS k, event_type AS signal, 1 AS strength FROM events WHERE event_type = 'click' UNION ALL SELECT doc_id, 'quality', CASE WHEN quality = 1 THEN 2 ELSE -2 END FROM labels")
def _(s, d):
    cards = load(s, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("k"), F.col("event_type").alias("signal"), F.lit(1).alias("strength"))
    reactions = load(s, d, "labels").select(F.col("doc_id").alias("k"), F.lit("quality").alias("signal"), F.when(F.col("quality") == 1, 2).otherwise(-2).alias("strength"))
    return cards.unionByName(reactions)
