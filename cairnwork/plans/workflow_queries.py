"""Queries of queues, document workflow and form schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.operators import documents as D
from cairnwork.operators import queue as Q
from cairnwork.operators import schemas as S
from cairnwork.operators.lookups import mapped
from cairnwork.plans.registry import query
from cairnwork.storage import load


def _work(s, d):
    status = mapped(F.col("o_orderstatus"), {"O": "in_work", "P": "pending", "F": "done"})
    return load(s, d, "orders").select("o_orderkey", status.alias("status"), (F.col("o_orderkey") % 7).cast("int").alias("attempts"), F.col("o_orderdate").alias("claimed_at"))


def _reports(s, d):
    k = F.col("o_orderkey")
    return load(s, d, "orders").where("o_orderstatus <> 'P'").select(
        "o_orderkey", (k % 7 + F.when(k % 3 == 0, 1).otherwise(0)).cast("int").alias("attempts"), F.col("o_orderdate").alias("claimed_at"), F.when(k % 2 == 0, "inserted").otherwise("dead_url").alias("outcome"), (k % 2 == 1).alias("failed")
    )


@query("Q_03_completed", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 2 = 1 THEN 'failed_permanent' ELSE 'done' END WHEN o_orderstatus = 'O' THEN 'in_work' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'done' END AS status, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'inserted' ELSE 'dead_url' END END AS outcome FROM orders")
def _(s, d):
    return Q.complete(_work(s, d), _reports(s, d), "o_orderkey")[0].select("o_orderkey", "status", "outcome")


@query("Q_03_refused", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 3 = 0)")
def _(s, d):
    return Q.complete(_work(s, d), _reports(s, d), "o_orderkey")[1].select("o_orderkey")


@query("Q_04_attempt_budget", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 7 > 4 THEN 'failed_permanent' WHEN o_orderstatus = 'O' THEN 'in_work' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'done' END AS status, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 7 > 4 THEN 'exhausted 4 attempts before processing (claimed ' || o_orderkey % 7 || ' times without a result)' END AS last_error FROM orders")
def _(s, d):
    return Q.over_budget(_work(s, d), 4, F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'")).select("o_orderkey", "status", "last_error")


@query("Q_05_one_active_row", "SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY 1")
def _(s, d):
    events = load(s, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "pending").otherwise("done").alias("status"), "event_type")
    return Q.enqueued(events, events.where("event_type = 'click'").select("user_id", "event_id"), "user_id", [F.asc("event_id")])


@query("Q_06_scheduled", """
    SELECT user_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS run_id FROM (SELECT user_id, sha256('daily-2024-01-31') AS h FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, max(ts) AS seen FROM events GROUP BY 1)
    WHERE NOT coalesce(date_diff('second', seen, TIMESTAMP '2024-01-31') < CASE t WHEN 'error' THEN 14 WHEN 'view' THEN 7 END * 86400, false))""")
def _(s, d):
    from cairnwork.functions.scalars import shaped_uuid
    from cairnwork.operators.selection import cooling

    last = load(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("t"), F.max("ts").alias("at"))
    outcome = mapped(F.col("t"), {"error": "dead_url", "view": "bot_challenge"})
    due = last.where(~cooling(outcome, F.col("at"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")))
    return due.select("user_id", shaped_uuid(F.lit("daily-2024-01-31")).alias("run_id"))


@query("Q_09_next_state", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'bought' WHEN bool_or(event_type = 'click') THEN 'looking' ELSE 'new' END AS state FROM events GROUP BY 1")
def _(s, d):
    log = load(s, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("event"))
    moves = {("new", "click"): "looking", ("new", "purchase"): "bought", ("looking", "purchase"): "bought"}
    return Q.next_state(log, "user_id", ["ts", "event_id"], moves, "new")


@query("T_08_routes", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'tier1' WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 'tier4' ELSE 'tier2' END WHEN 2 THEN 'tier4' WHEN 3 THEN 'tier6' ELSE 'failed' END AS route FROM pages")
def _(s, d):
    kind = mapped(F.col("page_id") % 5, {0: "xlsx", 1: "pdf_fillable", 2: "pdf_scanned", 3: "html"})
    return D.routed(load(s, d, "pages").select("page_id", kind.alias("source_format"), (F.col("page_id") % 2).alias("form_fields"))).select("page_id", "route")


@query("F_20_quality_flag", """
    SELECT doc_id, CASE WHEN doc_id % 200 = 0 THEN 'blank_template' WHEN doc_id % 200 < 25 OR (doc_id % 40 >= 20 AND doc_id % 200 < 100) OR (doc_id % 200 < 150 AND doc_id % 3 = 0 AND doc_id % 4 > 0) THEN 'low_coverage' END AS flag FROM documents""")
def _(s, d):
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.concat("text", F.lit(" C9. Percent and Number "))).otherwise("text")
    found = F.when(k % 4 == 0, F.array(F.lit("C.905"))).otherwise(F.array(F.lit("A.1")))
    return load(s, d, "documents").select("doc_id", D.quality_flag(k % 200, k % 40, text, found, F.lit("short")).alias("flag"))


@query("T_10_to_extract", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 1)")
def _(s, d):
    docs = load(s, d, "documents").select("doc_id", F.lit("tier4").alias("producer"), F.lit("1.2").alias("version"))
    made = load(s, d, "labels").select("doc_id", F.lit("tier4").alias("producer"), F.when(F.col("quality") == 1, "1.2").otherwise("1.1").alias("version"), F.lit("canonical").alias("kind"))
    return D.to_extract(docs, made, ["doc_id", "producer", "version"]).select("doc_id")


ARTIFACTS = "SELECT user_id AS doc, CASE WHEN event_type = 'purchase' THEN 'canonical' ELSE 'source' END AS kind, 's' || event_id % 3 AS sha, ts AS created_at FROM events"


@query("T_11_current_bytes", f"""
    WITH a AS ({ARTIFACTS}) SELECT c_custkey AS doc, coalesce((SELECT max(created_at) FROM a WHERE kind = 'canonical' AND doc = c_custkey) >= (SELECT min(created_at) FROM a WHERE kind = 'source' AND doc = c_custkey AND sha = 's' || c_custkey % 4), false) AS current FROM customer""")
def _(s, d):
    made = load(s, d, "events").select(F.col("user_id").alias("doc"), F.when(F.col("event_type") == "purchase", "canonical").otherwise("source").alias("kind"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("sha"), F.col("ts").alias("created_at"))
    docs = load(s, d, "customer").select(F.col("c_custkey").alias("doc"), F.concat(F.lit("s"), (F.col("c_custkey") % 4).cast("string")).alias("sha"))
    return D.on_current_bytes(docs, made, "doc").select("doc", "current")


def _archive(s, d):
    fresh = load(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.lit("new").alias("url"))
    k = F.col("doc_id")
    stored = load(s, d, "labels").join(load(s, d, "documents").select("doc_id", "text"), "doc_id").select(
        k, F.when(k % 3 == 0, "other").otherwise(F.sha2("text", 256)).alias("sha"), F.lit("old").alias("url"), (k % 2 == 0).alias("file_there"), F.lit(1).alias("verified")
    )
    return D.archive_actions(fresh, stored, "doc_id")


@query("SNK_15_archive_actions", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'inserted' WHEN d.doc_id % 3 = 0 THEN 'refreshed' WHEN d.doc_id % 2 = 1 THEN 'unchanged_repaired' ELSE 'unchanged_verified' END AS action FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(s, d):
    return _archive(s, d)[0]


@query("SNK_15_archive_after", "SELECT d.doc_id, true AS file_there, CASE WHEN l.doc_id IS NULL OR d.doc_id % 3 = 0 THEN 0 ELSE 2 END AS verified FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(s, d):
    return _archive(s, d)[1].select("doc_id", "file_there", "verified")


@query("T_06_validated", """
    SELECT c_custkey AS doc, CASE WHEN c_custkey % 9 = 0 THEN 'already_extracted' WHEN c_custkey % 7 = 0 THEN 'outside_scope' WHEN c_custkey % 5 = 0 THEN 'type_check_failed' WHEN c_nationkey % 4 = 0 THEN 'evidence_not_in_text' WHEN c_nationkey % 4 = 1 THEN 'value_not_in_evidence' WHEN c_custkey > 100 THEN 'sanity_failed' WHEN c_nationkey % 4 = 2 THEN 'row_merge_suspected' END AS reason FROM customer""")
def _(s, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 4
    number = k.cast("string")
    customers = load(s, d, "customer")
    labels = "Percent of students who applied; percent of students admitted"
    text = F.concat(F.lit(f"{labels} "), number, F.lit(" end"))
    evidence = F.when(n == 0, "words of another text").when(n == 1, "percent of students").when(n == 2, text).otherwise(F.concat(number, F.lit("   end")))
    values = customers.select(k.alias("doc"), F.when(k % 7 == 0, "f2").otherwise("f1").alias("field"), F.when(k % 5 == 0, "none").otherwise(number).alias("raw"), evidence.alias("evidence"))
    fields = s.createDataFrame([("f1", "Number", "percent applied")], "field string, kind string, question string")
    known = customers.where("c_custkey % 9 = 0").select(k.alias("doc"), F.when(k % 7 == 0, "f2").otherwise("f1").alias("field"))
    out = D.validated(values, fields, customers.select(k.alias("doc"), text.alias("text")), known, ["percent of students who applied", "percent of students admitted"])
    return out.select("doc", "reason")


@query("T_07_cached_answers", """
    WITH c AS (SELECT user_id, arg_max(event_type, ts) AS answer, max(ts) AS seen FROM events GROUP BY 1 HAVING count(DISTINCT ts) = count(*)) SELECT c_custkey, CASE WHEN seen IS NULL THEN 'miss' WHEN date_diff('second', seen, TIMESTAMP '2024-02-01') // 86400 > 5 THEN 'stale' ELSE 'hit' END AS state, CASE WHEN date_diff('second', seen, TIMESTAMP '2024-02-01') // 86400 <= 5 THEN answer END AS answer
    FROM customer LEFT JOIN c ON c.user_id = c_custkey WHERE seen IS NOT NULL OR NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""")
def _(s, d):
    cache = load(s, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("answer"), F.col("ts").alias("written_at"))
    single = cache.groupBy("c_custkey").agg(F.count_distinct("written_at").alias("a"), F.count("*").alias("b")).where("a <> b").select("c_custkey")
    asked = load(s, d, "customer").select("c_custkey").join(single, "c_custkey", "left_anti")
    return D.from_cache(asked, cache, "c_custkey", F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"), 5).select("c_custkey", "state", "answer")


@query("T_07_cache_key", "SELECT c_custkey, sha256(c_name || chr(10) || c_nationkey || chr(10) || sha256('a' || chr(10) || 'b')) AS k FROM customer")
def _(s, d):
    return load(s, d, "customer").select("c_custkey", D.cache_key(["c_name", "c_nationkey"], F.array(F.lit("b"), F.lit("a"))).alias("k"))


@query("T_13_compared", """
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.v IS NULL THEN 'native_only' WHEN a.v IS NULL THEN 'cleaner_only' WHEN a.v = b.v OR coalesce(abs(TRY_CAST(a.v AS DOUBLE) - TRY_CAST(b.v AS DOUBLE)) < 0.005 AND contains(a.v, '.'), false) THEN 'same' ELSE 'different' END AS class
    FROM (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) || '.5' AS v FROM part WHERE p_partkey % 5 > 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_size || '.502' ELSE p_brand END AS v FROM part WHERE p_partkey % 4 > 0) b ON a.k = b.k""")
def _(s, d):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey").alias("k")
    native = load(s, d, "part").where("p_partkey % 5 > 0").select(k, F.concat(size, F.lit(".5")).alias("value"))
    cleaned = load(s, d, "part").where("p_partkey % 4 > 0").select(k, F.when(F.col("p_partkey") % 2 == 0, F.concat(size, F.lit(".502"))).otherwise(F.col("p_brand")).alias("value"))
    return D.compared(native, cleaned, ["k"])


RULES = {"page": "[?&/]page[=/]?([0-9]+)", "title": "<title>([^<]*)</title>", "host": "^https?://([^/]+)"}


@query("T_14_rule_scores", """
    WITH c AS (SELECT page_id, 'title' AS rule, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS actual FROM pages UNION ALL SELECT page_id, 'host', nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') FROM pages)
    SELECT rule, count(*) AS expected, count(*) FILTER (WHERE actual = expected) AS matched, round(100.0 * count(*) FILTER (WHERE actual = expected) / count(*), 1) AS pct FROM (SELECT c.*, CASE WHEN page_id % 2 = 0 THEN actual ELSE 'x' END AS expected FROM c) GROUP BY 1""")
def _(s, d):
    pages = load(s, d, "pages")
    titles, hosts = D.captured(pages, {"title": RULES["title"]}, "page_id", "html"), D.captured(pages, {"host": RULES["host"]}, "page_id", "url")
    found = titles.unionByName(hosts)
    expected = found.select("page_id", "rule", F.when(F.col("page_id") % 2 == 0, F.col("actual")).otherwise("x").alias("expected"))
    return D.rule_scores(found, expected, "page_id")


@query("T_15_rising_triplet", """
    SELECT user_id, list_filter([CASE WHEN v[i] <= v[i + 1] AND v[i + 1] <= v[i + 2] THEN CAST(v[i] AS VARCHAR) || ',' || v[i + 1] || ',' || v[i + 2] END for i in range(1, len(v) - 1)], lambda x: x IS NOT NULL)[1] AS triplet FROM (SELECT user_id, list(CAST(floor(value) AS BIGINT) ORDER BY ts, event_id) AS v FROM events GROUP BY 1)""")
def _(s, d):
    rows = load(s, d, "events").select("user_id", "ts", "event_id", F.floor("value").alias("v"))
    return D.rising_triplets(rows, "user_id", ["ts", "event_id"], "v").select("user_id", F.array_join(F.col("triplet").cast("array<string>"), ",").alias("triplet"))


@query("T_16_targets", """
    WITH used AS (SELECT o_custkey AS school, year(o_orderdate) AS y, max(o_orderkey) AS doc FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2), pair AS (SELECT school, count(*) = 2 AS p FROM used GROUP BY 1),
    stale AS (SELECT school, doc, y, CASE WHEN p THEN 'pairable_stale' ELSE 'stale_unpairable' END AS priority, 'selected_stale' AS reason FROM used JOIN pair USING (school) WHERE doc % 3 > 0),
    best AS (SELECT o_custkey AS school, year(o_orderdate) AS y, o_orderkey AS doc, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'F' AND year(o_orderdate) IN (1996, 1997) AND NOT EXISTS (SELECT 1 FROM used WHERE used.school = o_custkey AND used.y = year(o_orderdate))
        QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderstatus <> 'P', o_orderpriority = '5-LOW', o_orderdate, o_orderkey) = 1)
    SELECT school, doc, y AS "year", priority, reason FROM stale UNION ALL SELECT school, doc, y, CASE WHEN y = 1997 THEN 'latest_gap' ELSE 'prior_gap' END, 'missing_row_' || CASE o_orderstatus WHEN 'P' THEN 'extraction_pending' ELSE 'failed' END FROM best WHERE o_orderpriority <> '5-LOW'""")
def _(s, d):
    orders = load(s, d, "orders").select(
        F.col("o_custkey").alias("school"), F.year("o_orderdate").cast("bigint").alias("year"), F.col("o_orderkey").alias("doc"), "o_orderstatus", F.col("o_orderdate").alias("discovered"),
        mapped(F.col("o_orderstatus"), {"P": "extraction_pending", "O": "failed"}).alias("status"), F.when(F.col("o_orderpriority") == "5-LOW", "xlsx").otherwise("pdf_flat").alias("format"), F.lit(None).cast("string").alias("flag"),
    )
    done = orders.where("o_orderstatus = 'F'").groupBy("school", "year").agg(F.max("doc").alias("doc"))
    selected = done.select("school", "year", "doc", F.lit("tier4").alias("producer"), F.when(F.col("doc") % 3 > 0, "1.9.2").otherwise("1.10").alias("producer_version"))
    schools = load(s, d, "customer").select(F.col("c_custkey").alias("school"))
    return D.targets(schools, selected, orders.where("o_orderstatus <> 'F'"), 1996, 1997, "1.10", ["pdf_flat", "pdf_scanned"])


@query("F_21_recently_probed", """
    SELECT c_custkey, c_nationkey = 3 OR CASE WHEN c_custkey % 3 = 0 THEN false WHEN c_custkey % 3 = 1 THEN false ELSE date_diff('second', TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 30) DAY, TIMESTAMP '2024-01-31') / 86400.0 < 10 END AS skipped FROM customer""")
def _(s, d):
    k = F.col("c_custkey")
    at = F.when(k % 3 == 1, "no time").when(k % 3 == 2, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")), "yyyy-MM-dd HH:mm:ss"))
    return load(s, d, "customer").select("c_custkey", D.recently_probed(F.col("c_nationkey") == 3, at, F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"), 10).alias("skipped"))


FIELDS = "SELECT p_partkey AS number, CAST(p_size % 5 AS VARCHAR) AS section, p_brand AS gender, CAST(p_partkey % 4 AS VARCHAR) AS cohort, p_type AS tag FROM part"


def _fields(s, d):
    return load(s, d, "part").select(F.col("p_partkey").alias("number"), (F.col("p_size") % 5).cast("string").alias("section"), F.col("p_brand").alias("gender"), (F.col("p_partkey") % 4).cast("string").alias("cohort"), F.col("p_type").alias("tag"))


@query("F_16_structural_filter", f"SELECT number FROM ({FIELDS}) WHERE section = '2' AND cohort = '1' AND starts_with(tag, 'P')")
def _(s, d):
    return S.matching_fields(_fields(s, d), section="2", cohort="1", gender=None, prefix_tag="P").select("number")


@query("T_03_unique_lookup", f"SELECT c_custkey, CAST(n AS DOUBLE) AS number FROM (SELECT c_custkey, CAST(c_custkey % 5 AS VARCHAR) AS section, CAST(c_custkey % 4 AS VARCHAR) AS cohort, 'Brand#' || (c_custkey % 5 + 1) || (c_nationkey % 5 + 1) AS gender FROM customer) LEFT JOIN (SELECT section, cohort, gender, min(number) AS n FROM ({FIELDS}) GROUP BY 1, 2, 3 HAVING count(*) = 1) USING (section, cohort, gender)")
def _(s, d):
    k = F.col("c_custkey")
    wanted = load(s, d, "customer").select(k, (k % 5).cast("string").alias("section"), (k % 4).cast("string").alias("cohort"), F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string"), (F.col("c_nationkey") % 5 + 1).cast("string")).alias("gender"))
    return S.unique_fields(_fields(s, d), ["section", "cohort", "gender"], wanted, "number").select("c_custkey", F.col("number").cast("double").alias("number"))


INDEX = """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS version, p_brand AS sub, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE replace(p_name, 'a', 'o') END AS label, p_type AS head FROM part"""


def _index(s, d):
    even = F.col("p_partkey") % 2 == 0
    question = F.struct(F.when(even, F.col("p_name")).otherwise(F.replace("p_name", F.lit("a"), F.lit("o"))).alias("row_label"), F.array(F.struct(F.col("p_type").alias("header"))).alias("columns"))
    rows = load(s, d, "part").select(F.when(even, "A").otherwise("B").alias("version"), F.col("p_brand").alias("id"), "p_partkey", question.alias("q"))
    # a form is a version's questions of one brand and a thousand keys, so forms grow in number and not in size
    forms = rows.groupBy("version", "id", F.floor(F.col("p_partkey") / 1000).alias("form")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "q"))), lambda x: x["q"]).alias("questions"))
    forms = forms.select("version", F.array(F.struct(F.array(F.struct("id", "questions")).alias("subsections"))).alias("sections"))
    return S.flat_index(forms)


@query("R_05_flat_index", f"SELECT version, sub AS subsection, label AS \"row\", lower(head) AS \"column\" FROM ({INDEX}) GROUP BY 1, 2, 3, 4")
def _(s, d):
    return _index(s, d).select("version", "subsection", "row", "column")


@query("J_16_renamed", None)
def _(s, d):
    index = _index(s, d)
    keys = ["subsection", "column", "row"]
    a, b = index.where("version = 'A'").select(*keys), index.where("version = 'B'").select(*keys)
    return S.renamed(a.join(b, keys, "left_anti"), b.join(a, keys, "left_anti"))


@query("T_12_schema_diff", None)
def _(s, d):
    index = _index(s, d)
    return S.schema_diff(index.where("version = 'A'"), index.where("version = 'B'"))[1]


@query("D_24_equivalence", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'direct' WHEN p_size % 3 = 0 THEN 'unmapped' ELSE 'preserved-only' END AS kind FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", S.equivalence(F.col("p_partkey") % 2 == 0, F.col("p_size") % 3 == 0).alias("kind"))


TABLE = "CASE c_custkey % 6 WHEN 0 THEN 'sfa2324' WHEN 1 THEN 'COST1_2024' WHEN 2 THEN 'EF2024D' WHEN 3 THEN 'DRVADM2024' WHEN 4 THEN 'HD2024' ELSE 'OTHER1' END"


@query("D_23_table_of_year", """
    SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'SFA' || lpad(CAST((y - 1) % 100 AS VARCHAR), 2, '0') || lpad(CAST(y % 100 AS VARCHAR), 2, '0') WHEN 1 THEN 'COST1_' || y WHEN 2 THEN 'EF' || y || 'D' WHEN 3 THEN 'DRVADM' || y WHEN 4 THEN 'HD' || y ELSE 'OTHER1' END AS t FROM (SELECT c_custkey, 2000 + c_nationkey AS y FROM customer)""")
def _(s, d):
    return load(s, d, "customer").select("c_custkey", S.table_of_year(F.expr(TABLE), F.col("c_nationkey") + 2000).alias("t"))


@query("D_23_resolved_tables", """
    SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'ADM2023' WHEN n_nationkey % 3 = 1 THEN 'SFA1819_P1' ELSE 'HD2023' END AS resolved FROM nation""")
def _(s, d):
    k = F.col("n_nationkey") % 3
    mappings = load(s, d, "nation").select("n_nationkey", mapped(k, {0: "adm2023", 1: "SFA1819", 2: "HD2023"}).alias("table"), mapped(k, {0: "A", 1: "B", 2: "C"}).alias("variable"))
    have = s.createDataFrame([("ADM2023", "a"), ("ADM2022", "a"), ("SFA1819_P1", "B"), ("IC2023", "C")], "table string, variable string")
    return S.resolved_tables(mappings, have).select("n_nationkey", "resolved")


@query("F_11_public_rows", "SELECT doc_id FROM labels WHERE toxic = 0 AND quality = 1")
def _(s, d):
    rows = load(s, d, "labels").withColumn("flag", F.when(F.col("quality") == 0, "low_coverage"))
    return rows.where(D.usable(F.col("flag"))).where("toxic = 0").select("doc_id")
