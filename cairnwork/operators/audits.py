"""Audits of a corpus: what can be answered, what waits, what a queue has done, what a year holds, and where files are kept.

All counts are grouped aggregates; lists are top-k of a stated length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.functions.scalars import registrable_domain
from cairnwork.functions.web import storage_class, third_party
from cairnwork.operators.aggregates import ranked_quantiles

LOW_FIELDS, LARGE = 5, 10_000
#: Stages of a year in the order of the report.
STAGES = ("discovered", "published", "verified_absent", "archived", "pending", "extracted", "failed", "canonical", "high_quality", "low_quality", "blank")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Null for an empty whole."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits))


def _slice(rows: DataFrame, name: str) -> DataFrame:
    ok, ed, ea = (F.coalesce(c, F.lit(False)) for c in ("answerable", "ed_offered", "ea_offered"))
    counts = {
        "rows": F.count(F.lit(1)), "answerable": F.count_if(ok), "ed_offered": F.count_if(ed), "ed_offered_answerable": F.count_if(ed & ok), "ea_offered": F.count_if(ea), "early_offered": F.count_if(ed | ea),
        "early_offered_answerable": F.count_if((ed | ea) & ok), "second_deadline": F.count_if(F.coalesce("second_deadline", F.lit(False))),
    }
    made = rows.agg(*[v.alias(k) for k, v in counts.items()])
    shares = {"answerable_pct": ("answerable", "rows"), "ed_offered_answerable_pct": ("ed_offered_answerable", "ed_offered"), "early_offered_answerable_pct": ("early_offered_answerable", "early_offered"), "second_deadline_pct": ("second_deadline", "rows")}
    return made.select(F.lit(name).alias("slice"), *counts, *[percent(F.col(a), F.col(b)).alias(n) for n, (a, b) in shares.items()])


def answer_rates(rows: DataFrame, id_col: str, top: int = 200) -> DataFrame:
    """``(slice, rows, answerable, ..., answerable_pct, ...)``: counts and rates of all rows and of the ``top`` with most applications.

    ``rows`` has answerable, ed_offered, ea_offered, second_deadline and applied, of which nulls count as no and as 0. Ties go by id.
    """
    most = rows.orderBy(F.desc(F.coalesce("applied", F.lit(0))), id_col).limit(top)
    return _slice(rows, "all").unionByName(_slice(most, f"top_{top}"))


def answers_by(rows: DataFrame, key: str) -> DataFrame:
    """``(key, total, answerable, pct)`` of each producer or other key."""
    made = rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.coalesce("answerable", F.lit(False))).alias("answerable"))
    return made.withColumn("pct", percent(F.col("answerable"), F.col("total")))


def early_shares(rows: DataFrame, points: Sequence[float] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """``(count, p25, ...)``: how the early share of all admitted is spread over answerable rows that have both; one row, null quantiles if there are none."""
    both = rows.where("answerable AND ed_admitted IS NOT NULL AND admitted > 0").select(F.lit(1).alias("one"), (F.col("ed_admitted") / F.col("admitted")).alias("share"))
    return both.agg(F.count("*").alias("count")).withColumn("one", F.lit(1)).join(ranked_quantiles(both, ["one"], "share", points), "one", "left").drop("one")


def flag_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)``: how often each value of each column stands, null as ``None``."""
    cells = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.initcap(F.col(c).cast("string")), F.lit("None")).alias("value")) for c in columns])))
    return cells.groupBy("column", "value").agg(F.count("*").alias("n"))


def queue_recent(queue: DataFrame, now: Column, hours: int) -> DataFrame:
    """``(status, last_outcome, source, n, last_processed)`` of rows processed in the last hours; no outcome is ``(null)``."""
    recent = queue.where(F.col("processed_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return recent.groupBy("status", F.coalesce("last_outcome", F.lit("(null)")).alias("last_outcome"), "source").agg(F.count("*").alias("n"), F.max("processed_at").alias("last_processed"))


def queue_open(queue: DataFrame, key: str, most: int = 30) -> DataFrame:
    """The rows that wait or are in work, the longest first, at most ``most``, with the first 240 characters of their error."""
    rows = queue.where(F.col("status").isin("ready", "processing")).withColumn("last_error", F.left(F.coalesce("last_error", F.lit("")), F.lit(240)))
    return rows.orderBy(F.asc(F.coalesce("claimed_at", "enqueued_at")), key).limit(most)


def status_deltas(before: DataFrame, after: DataFrame, most_share: float) -> DataFrame:
    """``(status, before, after, delta, plausible)``: a change of more than ``most_share`` of all rows before is not plausible."""
    sides = [d.groupBy("status").agg(F.count("*").alias(n)) for d, n in ((before, "before"), (after, "after"))]
    total = before.agg(F.count("*").alias("_total"))
    made = sides[0].join(sides[1], "status", "full").na.fill(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))
    return made.join(F.broadcast(total)).withColumn("plausible", F.abs("delta") <= F.col("_total") * most_share).drop("_total")


def backlog(pending: DataFrame, key: str, group: str, now: Column, sample: int = 15, groups: int = 10, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """((count, oldest_hours, oldest_at), (list, place, name, value)) of what waits.

    Lists: counts by ``source_format`` and ``source_provenance`` (null as unknown), the ``groups`` keys of ``group`` with most rows,
    the ``sample`` oldest with their age in hours, and the largest of those with ``size`` at ``large`` or more.
    """
    rows = pending.withColumn("age", F.round(F.timestamp_diff("SECOND", F.col("created_at"), now) / 3600.0, 2))
    summary = rows.agg(F.count("*").alias("count"), F.coalesce(F.max("age"), F.lit(0.0)).alias("oldest_hours"), F.min("created_at").alias("oldest_at"))

    def counted(name: str, column: Column, most: int | None, order: Sequence[Column]) -> DataFrame:
        made = rows.groupBy(column.alias("name")).agg(F.count("*").alias("n")).where("name <> ''")
        return placed(made.orderBy(*order).limit(most) if most else made.orderBy(*order), name, order, F.col("n").cast("string"))

    def placed(df: DataFrame, name: str, order: Sequence[Column], value: Column) -> DataFrame:
        """A short list with its places: counts of formats and provenances, and top-k lists."""
        listed = df.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("o"), F.col("name").cast("string").alias("name"), value.alias("value"))
        return listed.agg(F.array_sort(F.collect_list(F.struct("o", "name", "value"))).alias("all")).select(F.lit(name).alias("list"), F.posexplode("all").alias("place", "x")).select("list", (F.col("place") + 1).alias("place"), "x.name", "x.value")

    unknown = F.lit("unknown")
    by_name, by_n = [F.col("name")], [-F.col("n"), F.col("name")]
    lists = [counted("format", F.coalesce("source_format", unknown), None, by_name), counted("provenance", F.coalesce("source_provenance", unknown), None, by_name), counted(group, F.coalesce(F.col(group).cast("string"), F.lit("")), groups, by_n)]
    named = rows.withColumn("name", F.col(key))
    old, big = [-F.coalesce("age", F.lit(-1.0)), F.col("name")], [-F.col("size"), -F.coalesce("age", F.lit(0.0)), F.col("name")]
    lists.append(placed(named.orderBy(*old).limit(sample), "oldest", old, F.col("age").cast("string")))
    lists.append(placed(named.where(F.col("size") >= large).orderBy(*big).limit(sample), "largest", big, F.col("size").cast("string")))
    return summary, reduce(DataFrame.unionByName, lists)


def rolled_up(classes: Mapping[str, DataFrame], by: str) -> DataFrame:
    """``(by, class...)``: how many rows each class has in each group; groups in which only the first class has rows are left out.

    For schema differences: unchanged first, then added, removed and possibly renamed.
    """
    first = next(iter(classes))
    every = reduce(DataFrame.unionByName, [df.select(by, F.lit(name).alias("class")) for name, df in classes.items()])
    made = every.groupBy(by).agg(*[F.count_if(F.col("class") == name).alias(name) for name in classes])
    return made.where(" OR ".join(f"`{name}` > 0" for name in classes if name != first))


def canonical_quality(artifacts: DataFrame) -> DataFrame:
    """``(document_id, producer, fields_populated)`` of each document's latest canonical artifact; the count its statistics give, else of its values.

    ``artifacts`` has document_id, kind, producer, created_at, populated (may be null) and values (a map). Of one time the
    greatest producer counts.
    """
    fields = F.coalesce(F.col("populated").cast("bigint"), F.size(F.coalesce("values", F.create_map().cast("map<string,string>"))).cast("bigint"))
    last = F.max_by(F.struct("producer", fields.alias("fields_populated")), F.struct("created_at", "producer"))
    return artifacts.where("kind = 'canonical'").groupBy("document_id").agg(last.alias("q")).select("document_id", "q.*")


def completeness(documents: DataFrame, quality: DataFrame, years: Sequence[str], corpus: int, low: int = LOW_FIELDS) -> DataFrame:
    """``(year, corpus, discovered, ..., blank)``: how many documents of each year reached each stage; years without any have zeros."""
    joined = documents.where(F.col("year").isin(*years)).join(quality, "document_id", "left")
    fields, there = F.coalesce("fields_populated", F.lit(0)), F.col("fields_populated").isNotNull()
    marks = (
        F.lit(True), F.col("participation_status") == "published", F.col("participation_status") == "verified_absent", F.coalesce("source_sha256", F.lit("")) != "", F.col("extraction_status") == "extraction_pending",
        F.col("extraction_status") == "extracted", F.col("extraction_status") == "failed", there, there & (fields >= low), there & (fields > 0) & (fields < low), there & (fields == 0),
    )
    counts = joined.groupBy("year").agg(*[F.count_if(m).alias(s) for s, m in zip(STAGES, marks, strict=True)])
    every = documents.sparkSession.createDataFrame([(y,) for y in years], "year string")
    return every.join(counts, "year", "left").na.fill(0, list(STAGES)).select("year", F.lit(corpus).alias("corpus"), *STAGES)


def file_storage(docs: DataFrame, key: str, hint: str, url: str, services: Sequence[str]) -> DataFrame:
    """``(key, storage)``: where the files of a key are kept: on its own organisation's hosts, on one service, mixed or unknown.

    ``hint`` is the key's own address; files on other organisations' hosts that are no known service don't count.
    """
    service = third_party(F.col(url))
    own = service.isNull() & (registrable_domain(F.col(url)) != "") & (registrable_domain(F.col(url)) == registrable_domain(F.col(hint)))
    counts = docs.groupBy(key).agg(F.count_if(own).alias("_own"), *[F.count_if(F.coalesce(service == s, F.lit(False))).alias(f"_{s}") for s in services])
    return counts.select(key, storage_class({s: F.col(f"_{s}") for s in services}, F.col("_own")).alias("storage"))


def typed_fields(documents: DataFrame, id_col: str, values_col: str, definitions: DataFrame) -> DataFrame:
    """``(id_col, field, value_text, value_num, value_bool, value_kind, value_status)``: one typed row for each entry of a map of texts.

    ``definitions`` has (field, kind) with the kinds number, boolean and text; unknown fields are text. A blank value is ``missing``, one that
    doesn't parse ``parse_error``, all else ``reported``.
    """
    rows = documents.select(id_col, F.explode(values_col).alias("field", "raw")).join(definitions.select("field", "kind"), "field", "left")
    text, kind = F.trim("raw"), F.coalesce("kind", F.lit("text"))
    number = F.regexp_replace(text, "[$,%\\s]", "").try_cast("double")
    low = F.lower(text)
    truth = F.when(low.isin("true", "yes", "y", "x", "1", "☒", "☑", "✓"), True).when(low.isin("false", "no", "n", "0", "☐"), False)
    blank = F.coalesce(text, F.lit("")) == ""
    failed = ((kind == "number") & number.isNull()) | ((kind == "boolean") & truth.isNull())
    return rows.select(
        id_col, "field", F.when(~blank, text).alias("value_text"), F.when(~blank & (kind == "number"), number).alias("value_num"), F.when(~blank & (kind == "boolean"), truth).alias("value_bool"), kind.alias("value_kind"),
        F.when(blank, "missing").when(failed, "parse_error").otherwise("reported").alias("value_status"),
    )
