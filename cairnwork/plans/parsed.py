"""Queries of the parsing and address functions. Inputs are made by expressions that both dialects read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.functions import parsing as P
from cairnwork.functions import web as U
from cairnwork.plans.registry import query
from cairnwork.storage import load

#: Texts of many shapes, by a key.
AMOUNT = """CASE c_custkey % 9 WHEN 0 THEN concat('$', CAST(c_custkey * 37 AS VARCHAR(20)))  WHEN 1 THEN concat(CAST(c_custkey % 100 AS VARCHAR(20)), '%') WHEN 2 THEN concat(CAST(c_custkey AS VARCHAR(20)), '-', CAST(c_custkey + 1 AS VARCHAR(20)))
    WHEN 3 THEN concat('1,', CAST(100 + c_custkey % 900 AS VARCHAR(20)), '.5') WHEN 4 THEN 'n/a' WHEN 5 THEN concat('0', CAST(c_custkey AS VARCHAR(20))) WHEN 6 THEN concat('1,0', CAST(c_custkey % 10 AS VARCHAR(20))) WHEN 7 THEN ' ' ELSE concat(' ', CAST(c_custkey AS VARCHAR(20)), ' ') END"""


@query("X_02_lenient_number", f"SELECT c_custkey, TRY_CAST(regexp_replace(t, '[$,%\\s]', '', 'g') AS DOUBLE) AS number FROM (SELECT c_custkey, {AMOUNT} AS t FROM customer)")
def _(s, d):
    return load(s, d, "customer").select("c_custkey", P.lenient_number(F.expr(AMOUNT)).alias("number"))


@query("X_03_grouped_number", f"""
    SELECT c_custkey, CASE WHEN regexp_full_match(trim(t), '\\$?\\s?(\\d{{1,3}}(,\\d{{3}})*|\\d+)(\\.\\d+)?%?') AND NOT (length(n) > 1 AND starts_with(n, '0') AND substr(n, 2, 1) BETWEEN '0' AND '9') THEN TRY_CAST(n AS DOUBLE) END AS number
    FROM (SELECT c_custkey, t, regexp_replace(trim(t), '[$,%\\s]', '', 'g') AS n FROM (SELECT c_custkey, {AMOUNT} AS t FROM customer))""")
def _(s, d):
    return load(s, d, "customer").select("c_custkey", P.grouped_number(F.expr(AMOUNT)).alias("number"))


@query("X_04_numbers_match", """
    SELECT l_orderkey, l_linenumber, l_partkey, e = a OR coalesce(CASE WHEN NOT contains(e, '.') THEN CAST(trunc(TRY_CAST(a AS DOUBLE)) AS BIGINT) = CAST(trunc(TRY_CAST(e AS DOUBLE)) AS BIGINT) ELSE abs(TRY_CAST(e AS DOUBLE) - TRY_CAST(a AS DOUBLE)) < 0.005 END, false) AS same
    FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN concat(CAST(l_linenumber AS VARCHAR), '.5') WHEN l_partkey % 3 = 1 THEN CAST(l_linenumber AS VARCHAR) ELSE 'none' END AS e, CASE WHEN l_suppkey % 4 = 0 THEN concat(CAST(l_linenumber AS VARCHAR), '.502') WHEN l_suppkey % 4 = 1 THEN concat(CAST(l_linenumber AS VARCHAR), '.9') WHEN l_suppkey % 4 = 2 THEN CAST(l_linenumber AS VARCHAR) ELSE 'none' END AS a FROM lineitem)""")
def _(s, d):
    line = F.col("l_linenumber").cast("string")
    expected = F.when(F.col("l_partkey") % 3 == 0, F.concat(line, F.lit(".5"))).when(F.col("l_partkey") % 3 == 1, line).otherwise("none")
    k = F.col("l_suppkey") % 4
    actual = F.when(k == 0, F.concat(line, F.lit(".502"))).when(k == 1, F.concat(line, F.lit(".9"))).when(k == 2, line).otherwise("none")
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", P.numbers_match(expected, actual).alias("same"))


HINT = "CASE c_nationkey % 5 WHEN 0 THEN 'graduation rate' WHEN 1 THEN '25th percentile rate' WHEN 2 THEN 'nearest tenth' WHEN 3 THEN 'dollar amount' ELSE 'other' END"
MARKED = f"CASE c_custkey % 13 WHEN 9 THEN 'Yes' WHEN 10 THEN '☒' WHEN 11 THEN NULL WHEN 12 THEN 'Not Offered' ELSE {AMOUNT} END"


@query("X_07_value_kind", f"""
    SELECT c_custkey, CASE WHEN l IN ('n/a', 'na', 'not applicable', 'not-applicable', 'not required', 'not offered') THEN 'not_applicable' WHEN h = 'graduation rate' OR contains(l, '%') THEN 'percent' WHEN h = 'dollar amount' OR starts_with(l, '$') THEN 'currency'
        WHEN l = 'yes' THEN 'yesno' WHEN l = '☒' THEN 'checkbox' WHEN h = 'nearest tenth' THEN 'number' WHEN t IS NULL THEN 'unknown' ELSE 'text' END AS kind
    FROM (SELECT c_custkey, h, t, lower(trim(coalesce(t, ''))) AS l FROM (SELECT c_custkey, {HINT} AS h, {MARKED} AS t FROM customer))""")
def _(s, d):
    return load(s, d, "customer").select("c_custkey", P.value_kind(F.expr(MARKED), F.expr(HINT)).alias("kind"))


LABEL = "concat('First-time, first-year (', CASE p_size % 4 WHEN 0 THEN 'Freshmen' WHEN 1 THEN 'Males' WHEN 2 THEN 'Nonresident Aliens' ELSE 'another gender' END, '): ', p_name)"


@query("X_08_normalised_label", f"""
    SELECT p_partkey, concat('first time first year ', CASE p_size % 4 WHEN 0 THEN 'first year' WHEN 1 THEN 'men' WHEN 2 THEN 'nonresidents' ELSE 'unknown' END, ' ', lower(p_name)) AS label FROM part""")
def _(s, d):
    return load(s, d, "part").select("p_partkey", P.normalised_label(F.expr(LABEL)).alias("label"))


@query("X_09_normalised_name", "SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(lower(concat(p_name, ' & ', p_brand)), '&', 'and'), '[^a-z0-9]+', ' ', 'g'), '(^| )(red|the)( |$)', ' ', 'g')) AS name FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", P.normalised_name(F.concat("p_name", F.lit(" & "), "p_brand"), ["red", "the"]).alias("name"))


CODE = "CASE p_partkey % 4 WHEN 0 THEN concat('a', CAST(p_partkey % 1000 AS VARCHAR(20))) WHEN 1 THEN concat(' C.', CAST(p_partkey % 100 AS VARCHAR(20)), ' ') WHEN 2 THEN concat('J', CAST(p_partkey % 10 AS VARCHAR(20)), 'b') ELSE concat('K', CAST(p_partkey AS VARCHAR(20))) END"


@query("X_12_question_number", """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'A.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN 'C.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 3, '0') WHEN 2 THEN 'J.' || CAST(p_partkey % 10 AS VARCHAR) || 'B' END AS number FROM part""")
def _(s, d):
    return load(s, d, "part").select("p_partkey", P.question_number(F.expr(CODE)).alias("number"))


@query("X_13_clean_token", "SELECT page_id, nullif(regexp_replace(regexp_replace(substr(trim(url), 1, 40), '[^a-zA-Z0-9._:/@+-]', '-', 'g'), '-+', '-', 'g'), '') AS token FROM pages")
def _(s, d):
    return load(s, d, "pages").select("page_id", P.clean_token(F.col("url"), 40).alias("token"))


@query("X_14_filled_template", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name || ' has ' || CAST(c_custkey AS VARCHAR) END AS sentence FROM customer")
def _(s, d):
    name = F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("{left_over}")
    return load(s, d, "customer").select("c_custkey", P.filled("{name} has {count}", {"name": name, "count": F.col("c_custkey")}).alias("sentence"))


@query("X_15_display_strings", """
    SELECT s_suppkey, CASE WHEN r * 100 < 10 THEN printf('%.1f', r * 100) ELSE printf('%.0f', r * 100) END || '%' AS share, CASE WHEN m < 0 THEN '-' ELSE '' END || '$' || format('{:,}', abs(m)) AS money,
        CASE WHEN r > 0 THEN '+' ELSE '' END || printf('%.1f', r * 100) || ' pts' AS points, CASE WHEN m > 0 THEN '+' ELSE '' END || CAST(m AS VARCHAR) AS change
    FROM (SELECT s_suppkey, (s_suppkey % 64) / 64.0::DOUBLE + 0.0013 AS r, CAST(s_suppkey * 137 - 5000 AS BIGINT) AS m FROM supplier)""")
def _(s, d):
    rate, amount = (F.col("s_suppkey") % 64) / F.lit(64.0) + 0.0013, F.col("s_suppkey") * 137 - 5000
    return load(s, d, "supplier").select(
        "s_suppkey", P.percent_text(rate).alias("share"), P.money_text(amount.cast("double")).alias("money"), P.delta_text(rate, "rate").alias("points"), P.delta_text(amount, "count").alias("change")
    )


NAMED = "concat(CASE o_orderkey % 3 WHEN 0 THEN 'The Common  Data Set: ' WHEN 1 THEN 'our CDS ' ELSE 'the data of ' END, CAST(2000 + o_orderkey % 40 AS VARCHAR(20)), ' – ', CAST(2001 + o_orderkey % 40 + o_orderkey % 2 AS VARCHAR(20)))"


@query("X_17_named_year", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 2 = 0 AND o_orderkey % 40 <= 35 THEN CAST(2000 + o_orderkey % 40 AS VARCHAR) || '-' || right(CAST(2001 + o_orderkey % 40 AS VARCHAR), 2) END AS span FROM orders")
def _(s, d):
    return load(s, d, "orders").select("o_orderkey", P.named_year(F.expr(NAMED)).alias("span"))


@query("X_18_year_start", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS DOUBLE) END AS first FROM orders")
def _(s, d):
    y = F.year("o_orderdate").cast("string")
    span = F.when(F.col("o_orderkey") % 2 == 0, F.concat(y, F.lit("-07"))).otherwise(F.concat(y, F.lit("-2007")))
    return load(s, d, "orders").select("o_orderkey", P.year_start(span).cast("double").alias("first"))


@query("X_19_pdf_date", """
    SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN strftime(date_trunc('year', ts), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(date_trunc('second', ts) + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS at FROM events""")
def _(s, d):
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("D:"), stamp, F.lit("Z"))).when(k == 1, F.concat(F.lit("D:"), stamp, F.lit("-05'30'"))).when(k == 2, F.concat(F.lit("D:"), F.date_format("ts", "yyyy"))).otherwise("today")
    return load(s, d, "events").select("event_id", F.date_format(P.pdf_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("X_20_release_date", """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE o_orderkey % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'day' END AS "precision" FROM orders""")
def _(s, d):
    k, at = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(at, "MMMM d, yyyy")).when(k == 1, F.date_format(at, " MMMM yyyy")).when(k == 2, F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy"))
    return load(s, d, "orders").select("o_orderkey", P.release_date(text).alias("r")).select("o_orderkey", "r.day", "r.precision")


@query("X_21_months_later", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + INTERVAL (o_orderkey % 30) MONTH, '%Y-%m-%d') AS due FROM orders")
def _(s, d):
    return load(s, d, "orders").select("o_orderkey", F.date_format(F.add_months(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 30).cast("int")), "yyyy-MM-dd").alias("due"))


@query("X_22_age_bucket", """
    SELECT event_id, CASE WHEN h < 1 THEN 'under an hour' WHEN h < 24 THEN 'under a day' WHEN h < 168 THEN 'under a week' ELSE 'older' END AS age FROM (SELECT event_id, date_diff('microsecond', ts, TIMESTAMP '2024-01-31') // 1000000 / 3600 AS h FROM events)""")
def _(s, d):
    return load(s, d, "events").select("event_id", P.age_bucket(P.hours_since(F.col("ts"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"))).alias("age"))


@query("X_23_half_away", "SELECT s_suppkey, CAST(sign(v) * floor(abs(v) + 0.5) AS DOUBLE) AS away, CAST(floor(v + 0.5) AS DOUBLE) AS up FROM (SELECT s_suppkey, s_suppkey * 0.5::DOUBLE - 20 AS v FROM supplier)")
def _(s, d):
    from cairnwork.functions.scalars import half_up

    value = F.col("s_suppkey") * 0.5 - 20
    return load(s, d, "supplier").select("s_suppkey", P.half_away(value).cast("double").alias("away"), half_up(value).cast("double").alias("up"))


LINK = """CASE page_id % 8 WHEN 0 THEN concat('https://org', CAST(page_id % 7 AS VARCHAR(20)), '.app.box.com/s/abc', CAST(page_id AS VARCHAR(20)), '?x=1') WHEN 1 THEN concat('https://drive.google.com/file/d/f', CAST(page_id AS VARCHAR(20)), '/view')
    WHEN 2 THEN concat('https://docs.google.com/spreadsheets/d/s', CAST(page_id AS VARCHAR(20)), '/edit#gid=0') WHEN 3 THEN concat('http://10.0.0.', CAST(page_id % 256 AS VARCHAR(20)), '/x') WHEN 4 THEN concat('https://login.microsoftonline.com/', CAST(page_id AS VARCHAR(20)))
    WHEN 5 THEN concat('ftp://files.org/', CAST(page_id AS VARCHAR(20))) WHEN 6 THEN concat('https://www.college.edu/oir/cds/', CAST(page_id AS VARCHAR(20)), '.pdf') ELSE url END"""


@query("X_27_seed_url", """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'https://' || regexp_replace(url, '^[a-z]+://', '') END AS seed FROM pages""")
def _(s, d):
    k = F.col("page_id") % 3
    text = F.when(k == 0, F.concat(F.lit(" "), "url")).when(k == 1, F.concat(F.lit("//"), F.regexp_replace("url", "^[a-z]+://", ""))).otherwise(F.lit("not an address"))
    return load(s, d, "pages").select("page_id", U.seed_url(text).alias("seed"))


@query("X_29_direct_link", f"""
    SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://org' || CAST(page_id % 7 AS VARCHAR) || '.box.com/shared/static/abc' || CAST(page_id AS VARCHAR) WHEN 1 THEN 'https://drive.google.com/uc?export=download&id=f' || CAST(page_id AS VARCHAR) || '&confirm=t'
        WHEN 2 THEN 'https://docs.google.com/spreadsheets/d/s' || CAST(page_id AS VARCHAR) || '/export?format=xlsx' ELSE {LINK} END AS link FROM pages""")
def _(s, d):
    return load(s, d, "pages").select("page_id", U.direct_link(F.expr(LINK)).alias("link"))


@query("X_30_fetchable", "SELECT page_id, page_id % 8 NOT IN (3, 5) AS fetchable FROM pages")
def _(s, d):
    return load(s, d, "pages").select("page_id", U.fetchable(F.expr(LINK)).alias("fetchable"))


@query("X_31_site_signs", """
    SELECT page_id, CASE WHEN page_id % 8 = 4 THEN 'auth_walled_microsoft' END AS wall, CASE page_id % 8 WHEN 0 THEN 'box' WHEN 1 THEN 'google_drive' WHEN 2 THEN 'google_drive' END AS storage,
        CASE page_id % 4 WHEN 0 THEN 'cloudflare' WHEN 1 THEN 'fastly' WHEN 2 THEN 'imperva' ELSE 'unknown' END AS waf, CASE WHEN page_id % 5 = 0 THEN 'drupal' WHEN page_id % 5 = 1 THEN 'wordpress' ELSE 'unknown' END AS cms,
        CASE WHEN n > 0 THEN 'static_html' WHEN length(html) BETWEEN 1 AND 49999 THEN 'js_required' ELSE 'unknown' END AS rendering
    FROM (SELECT *, len(regexp_extract_all(html, '<a ')) AS n FROM pages)""")
def _(s, d):
    k = F.col("page_id")
    server = F.when(k % 4 == 0, "Cloudflare").when(k % 4 == 2, "Imperva edge").otherwise("nginx")
    fastly, system = F.when(k % 4 == 1, "abc").otherwise(""), F.when(k % 5 == 0, "Drupal 9").when(k % 5 == 1, "WordPress 6").otherwise("")
    headers = F.create_map(F.lit("server"), server, F.lit("x-fastly-request-id"), fastly, F.lit("x-generator"), system)
    links = F.regexp_count("html", F.lit("<a "))
    return load(s, d, "pages").select(
        "page_id", U.auth_wall(F.expr(LINK)).alias("wall"), U.third_party(F.expr(LINK)).alias("storage"), U.waf(headers).alias("waf"), U.cms(headers, F.lit("https://x.org/")).alias("cms"),
        U.rendering(F.length("html"), links).alias("rendering"),
    )


@query("X_32_candidates", """
    SELECT page_id, 'https://www.college.edu/oir/cds/ https://www.college.edu/oir/' AS parents, 'https://www.college.edu/cds https://www.college.edu/ir/cds' AS known FROM pages WHERE page_id % 8 = 6
    UNION ALL SELECT page_id, '', regexp_extract(url, '^(https?://[^/]+)', 1) || '/cds ' || regexp_extract(url, '^(https?://[^/]+)', 1) || '/ir/cds' FROM pages WHERE page_id % 8 = 7""")
def _(s, d):
    link = F.expr(LINK)
    pages = load(s, d, "pages").where("page_id % 8 >= 6")
    return pages.select("page_id", F.array_join(U.parent_folders(link), " ").alias("parents"), F.array_join(U.well_known(link, ["/cds", "/ir/cds"]), " ").alias("known"))


MESSAGE = "CASE event_id % 8 WHEN 0 THEN 'HTTP 404 at x' WHEN 1 THEN 'HTTP 403: Just a moment' WHEN 2 THEN 'Timeout after 30 s' WHEN 3 THEN 'unknown content type for https://x.okta.com/' WHEN 4 THEN 'file exceeds 50 bytes' WHEN 5 THEN '' WHEN 6 THEN 'unsafe URL' ELSE event_type END"


@query("X_33_error_outcome", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'dead_url' WHEN 1 THEN 'bot_challenge' WHEN 2 THEN 'transient' WHEN 3 THEN 'auth_walled_okta' WHEN 4 THEN 'file_too_large' WHEN 5 THEN NULL WHEN 6 THEN 'blocked_url' ELSE 'permanent_other' END AS outcome FROM events")
def _(s, d):
    return load(s, d, "events").select("event_id", U.error_outcome(F.expr(MESSAGE)).alias("outcome"))


AGENT = "CASE event_id % 6 WHEN 0 THEN 'Mozilla/5.0 (X11)' WHEN 1 THEN 'curl/8.1' WHEN 2 THEN 'node' WHEN 3 THEN '' WHEN 4 THEN 'GPTBot by OpenAI' ELSE 'Wget' END"
ROUTES = [("/api/items/search", "search"), ("/api/items/[^/]+/facts(/.*)?", "facts"), ("/api/compare", "compare")]
PATH = "CASE event_id % 4 WHEN 0 THEN '/api/items/search' WHEN 1 THEN concat('/api/items/', event_type, '/facts') WHEN 2 THEN '/api/compare' ELSE '/api/compare/x' END"


@query("X_34_families", """
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'browser' WHEN 1 THEN 'curl' WHEN 2 THEN 'node_fetch' WHEN 3 THEN 'unknown' WHEN 4 THEN 'ai_agent' ELSE 'script' END AS agent,
        CASE WHEN event_type = 'click' THEN 'integration' ELSE CASE event_id % 6 WHEN 0 THEN 'browser' WHEN 3 THEN 'unknown' WHEN 4 THEN 'ai_agent' ELSE 'script' END END AS client, CASE event_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'facts' WHEN 2 THEN 'compare' ELSE 'other' END AS route FROM events""")
def _(s, d):
    client = F.when(F.col("event_type") == "click", "my tool").otherwise("")
    return load(s, d, "events").select("event_id", U.agent_family(F.expr(AGENT)).alias("agent"), U.client_family(client, F.expr(AGENT)).alias("client"), U.route_kind(F.expr(PATH), ROUTES).alias("route"))


@query("X_35_json_parts", """
    SELECT event_id, json_exists(props, '$.k') AS has, json_extract_string(props, '$.k') AS k, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS number, '{"event":' || event_id || ',"kind":"' || event_type || '"}' AS made FROM events""")
def _(s, d):
    k = F.get_json_object("props", "$.k")
    return load(s, d, "events").select(
        "event_id", F.array_contains(F.json_object_keys("props"), "k").alias("has"), k.alias("k"), k.rlike("^-?\\d+$").alias("number"), F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("kind"))).alias("made"),
    )


@query("X_36_save_code", """
    WITH p AS (SELECT c_custkey, CAST(1 AS BIGINT) * 16777216 + c_custkey % 4 * 4194304 + CASE WHEN c_custkey % 40 BETWEEN 1 AND 36 THEN c_custkey % 40 ELSE 0 END * 65536 + CASE WHEN c_custkey % 130 <= 120 THEN c_custkey % 130 ELSE 127 END * 512 + c_custkey % 501 AS v FROM customer)
    SELECT c_custkey, (SELECT string_agg(substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', ((v >> CAST(5 * (5 - i) AS INTEGER)) & 31) + 1, 1) || CASE WHEN i = 2 THEN '-' ELSE '' END, '' ORDER BY i) FROM range(6) r(i)) AS code,
        CASE WHEN c_custkey % 130 <= 120 THEN CAST(400 + c_custkey % 130 * 10 AS DOUBLE) END AS sat, CASE WHEN c_custkey % 40 BETWEEN 1 AND 36 THEN CAST(c_custkey % 40 AS DOUBLE) END AS act FROM p""")
def _(s, d):
    k = F.col("c_custkey")
    code = P.save_code((k % 501) / 100, 400 + k % 130 * 10, k % 40, k % 4)
    rows = load(s, d, "customer").select("c_custkey", code.alias("code")).withColumn("p", P.profile_of(F.lower("code")))
    return rows.select("c_custkey", "code", F.col("p.sat").cast("double").alias("sat"), F.col("p.act").cast("double").alias("act"))


QUOTE = "CASE doc_id % 4 WHEN 0 THEN substr(text, 11, 60) WHEN 1 THEN replace(substr(text, 11, 60), ' ', '  ') WHEN 2 THEN 'words that stand in no text' ELSE ' ' END"


@query("X_38_evidence", f"""
    SELECT doc_id, trim(q) <> '' AND (contains(text, q) OR contains(regexp_replace(text, '\\s+', ' ', 'g'), trim(regexp_replace(q, '\\s+', ' ', 'g')))) AS there FROM (SELECT doc_id, text, {QUOTE} AS q FROM documents)""")
def _(s, d):
    return load(s, d, "documents").select("doc_id", P.evidence_present(F.expr(QUOTE), F.col("text")).alias("there"))


@query("X_39_merged_labels", """
    SELECT doc_id, CAST(contains(t, 'the history of the') AS INTEGER) + CAST(contains(t, 'in the following') AS INTEGER) AS n FROM (SELECT doc_id, regexp_replace(lower(text), '[,–—:;/()\\s-]+', ' ', 'g') AS t FROM documents)""")
def _(s, d):
    labels = F.lit(["the history of the", "in the following", "too short"])
    return load(s, d, "documents").select("doc_id", P.labels_in(F.col("text"), labels).alias("n"))


KIND = "CASE c_nationkey % 5 WHEN 0 THEN 'Number' WHEN 1 THEN 'MM' WHEN 2 THEN 'YesNo' WHEN 3 THEN 'x' ELSE 'Text' END"
ANSWER = "CASE c_custkey % 6 WHEN 0 THEN concat('$', CAST(c_custkey % 40 AS VARCHAR(20))) WHEN 1 THEN 'Yes' WHEN 2 THEN 'x' WHEN 3 THEN '' WHEN 4 THEN CAST(c_custkey % 14 AS VARCHAR(20)) ELSE '-7' END"


@query("X_40_typed_value", f"""
    SELECT c_custkey, v AS value, CASE WHEN k = 'Number' AND TRY_CAST(v AS DOUBLE) < 0 THEN 'negative_count' END AS issue FROM (
    SELECT c_custkey, k, CASE WHEN a <> '' THEN CASE k WHEN 'Number' THEN CASE WHEN n IS NOT NULL THEN replace(a, '$', '') END WHEN 'MM' THEN CASE WHEN n BETWEEN 1 AND 12 THEN CAST(CAST(n AS INTEGER) AS VARCHAR) END
        WHEN 'YesNo' THEN CASE WHEN a IN ('Yes', '1') THEN 'Yes' WHEN a = '0' THEN 'No' END WHEN 'x' THEN CASE WHEN a IN ('Yes', 'x', '1') THEN 'x' END ELSE a END END AS v
    FROM (SELECT c_custkey, k, a, TRY_CAST(replace(a, '$', '') AS DOUBLE) AS n FROM (SELECT c_custkey, {KIND} AS k, {ANSWER} AS a FROM customer)))""")
def _(s, d):
    value = P.typed_value(F.expr(ANSWER), F.expr(KIND))
    return load(s, d, "customer").select("c_custkey", value.alias("value"), P.sane(value, F.expr(KIND), F.lit("how many")).alias("issue"))


@query("F_19_page_outcome", """
    SELECT page_id, CASE WHEN contains(t, 'captcha') OR contains(t, 'access denied') OR contains(t, 'cloudflare') OR contains(t, 'just a moment') OR contains(t, 'imperva') OR contains(t, 'perfdrive') THEN 'bot_challenge'
        WHEN contains(t, 'page not found') OR contains(t, 'server error') OR contains(t, 'please sign in') THEN 'wrong_content_type' WHEN regexp_matches(t, 'common data set|\\bcds\\b') AND NOT (contains(t, '<table') AND contains(t, '<td')) THEN 'wrong_content_type' END AS outcome
    FROM (SELECT page_id, lower(concat(html, CASE page_id % 4 WHEN 0 THEN ' Captcha' WHEN 1 THEN ' Page not found' WHEN 2 THEN ' our CDS' ELSE ' CDS <table><td>' END)) AS t FROM pages)""")
def _(s, d):
    tail = F.expr("CASE page_id % 4 WHEN 0 THEN ' Captcha' WHEN 1 THEN ' Page not found' WHEN 2 THEN ' our CDS' ELSE ' CDS <table><td>' END")
    return load(s, d, "pages").select("page_id", U.page_outcome(F.lit("https://x.org/"), F.concat("html", tail)).alias("outcome"))


@query("D_10_fact_display", """
    SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_brand WHEN p_size % 5 = 1 THEN p_type ELSE regexp_replace(regexp_replace(printf('%.3f', p_size / 8.0::DOUBLE), '0+$', ''), '\\.$', '') || CASE WHEN p_size % 5 = 2 THEN '%' ELSE '' END END AS shown FROM part""")
def _(s, d):
    k = F.col("p_size") % 5
    label, text = F.when(k == 0, F.col("p_brand")), F.when(k == 1, F.col("p_type"))
    return load(s, d, "part").select("p_partkey", P.fact_display(label, text, F.col("p_size") / 8.0, F.when(k == 2, "percent").otherwise("count")).alias("shown"))


@query("D_11_normalised_value", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END ELSE p_brand END AS value FROM part")
def _(s, d):
    k = F.col("p_size") % 3
    return load(s, d, "part").select("p_partkey", P.normalised_value(F.when(k == 0, F.col("p_size")), F.when(k == 1, F.col("p_size") > 20), F.col("p_brand")).alias("value"))


@query("A_28_mean_or_none", "SELECT p_brand, round(avg(p_size) FILTER (WHERE p_type = 'PROMO'), 2) AS mean FROM part GROUP BY 1")
def _(s, d):
    return load(s, d, "part").groupBy("p_brand").agg(F.round(F.avg(F.when(F.col("p_type") == "PROMO", F.col("p_size"))), 2).alias("mean"))
