"""Picks of one row among several by ordered rules, and orders of lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwork.operators.lookups import mapped
from cairnwork.operators.places import Order
from cairnwork.operators.ranking import first_per_key

# Flags of rows that show nothing, sources that come from the school itself, states of work in the order in which they are taken up, severities in order.
BAD_FLAGS = ("wrong_file", "blank_template", "low_coverage")
DIRECT_SOURCES = ("school_direct", "operator_manual")
STATUS_ORDER = {"extraction_pending": 0, "failed": 1, "extracted": 2, "not_applicable": 3}
SEVERITY_ORDER = {"major": 0, "notable": 1, "watch": 2}
REDRAIN_FORMATS = ("pdf_flat", "pdf_scanned")


def latest_outcomes(queue: DataFrame, key: str, keys: DataFrame, since: Column) -> DataFrame:
    """(key, processed_at, last_outcome): the latest terminal row since a time of each asked key, the greater id of equal times."""
    rows = queue.where("status IN ('done', 'failed_permanent') AND last_outcome IS NOT NULL AND processed_at IS NOT NULL").where(F.col("processed_at") >= since)
    return first_per_key(rows.join(keys.select(key).distinct(), key, "left_semi"), [key], [F.desc("processed_at"), F.desc("id")]).select(key, "processed_at", "last_outcome")


def redundant_work(queue: DataFrame, key: str) -> DataFrame:
    """The ready rows that another active row of their key makes redundant: work in progress comes first, then the oldest, then the least id."""
    active = queue.where("status IN ('ready', 'processing')")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("status") == "processing", 0).otherwise(1), "enqueued_at", "id"))
    return active.withColumn("_rank", rank).where("_rank > 1 AND status = 'ready'").drop("_rank")


def primary_rows(rows: DataFrame, keys: Sequence[str], variant: str, flag: str, source: str, id_col: str) -> DataFrame:
    """One row of each key among those without a variant: usable ones first, then those from the school itself, then the least id."""
    own = rows.where(F.col(variant).isNull())
    for k in keys:
        own = own.where(F.col(k).isNotNull())
    order = [F.coalesce(F.col(flag).isin(*BAD_FLAGS), F.lit(False)).asc(), F.coalesce(F.col(source).isin(*DIRECT_SOURCES), F.lit(False)).desc(), F.coalesce(F.col(id_col).cast("string"), F.lit("")).asc()]
    return first_per_key(own, keys, order)


def document_of_year(docs: DataFrame, keys: Sequence[str], status: str, source_format: str, flag: str, discovered: str, id_col: str) -> DataFrame:
    """The document of each key to take up next: by the state of its extraction, formats that can be extracted again first, usable ones first, the earliest discovered."""
    order = [
        F.coalesce(mapped(F.col(status), STATUS_ORDER), F.lit(4)).asc(), F.coalesce(F.col(source_format).isin(*REDRAIN_FORMATS), F.lit(False)).desc(), F.coalesce(F.col(flag).isin(*BAD_FLAGS), F.lit(False)).asc(),
        F.asc_nulls_first(discovered), F.asc(id_col),
    ]
    return first_per_key(docs, keys, order)


def best_anchor(anchors: DataFrame, key: str) -> DataFrame:
    """The best link to a whole document of each key: no section file, no reference, no test file, with a year, the latest year, the first on the page."""
    order = [F.asc("is_section"), F.asc("is_reference"), F.asc("is_test"), F.col("year").isNull().asc(), F.desc("year"), F.asc("position")]
    return first_per_key(anchors.where("kind = 'document'"), [key], order)


def yearly_candidates(anchors: DataFrame, key: str) -> DataFrame:
    """(key, year, kind, urls): what to archive of a key's links.

    Links count once for each address without fragment, references not at all. For each year
    the first whole clean document is taken, else the first whole test document, else two or
    more section files as one package in the order of their sections, else the file of section
    C. A link without a year is taken if the key has no other.
    """
    links = anchors.where("NOT is_reference").withColumn("_url", F.substring_index("url", "#", 1))
    links = first_per_key(links, [key, "_url"], [F.asc("position")])
    whole, at = ~F.col("is_section"), F.struct("position", "url")
    parts = F.array_sort(F.collect_list(F.when(F.col("section").isNotNull(), F.struct("section", "position", "url"))))
    years = links.where("year IS NOT NULL").groupBy(key, "year").agg(
        F.min(F.when(whole & ~F.col("is_test"), at)).alias("clean"), F.min(F.when(whole & F.col("is_test"), at)).alias("test"), parts.alias("parts"), F.min(F.when(F.col("section") == "C", at)).alias("c")
    )
    package = F.when(F.size("parts") >= 2, F.col("parts.url"))
    kind = F.when(F.col("clean").isNotNull(), "document").when(F.col("test").isNotNull(), "test").when(package.isNotNull(), "package").when(F.col("c").isNotNull(), "section_c")
    urls = F.coalesce(F.when(F.col("clean").isNotNull(), F.array("clean.url")), F.when(F.col("test").isNotNull(), F.array("test.url")), package, F.array("c.url"))
    dated = years.select(key, "year", kind.alias("kind"), F.array_join(urls, " ").alias("urls")).where("kind IS NOT NULL")
    lone = links.groupBy(key).agg(F.count("*").alias("n"), F.first("year").alias("year"), F.first("url").alias("urls")).where("n = 1 AND year IS NULL")
    return dated.unionByName(lone.select(key, "year", F.lit("undated").alias("kind"), "urls"))


def claimed_names(rows: DataFrame, name: str, size: str, id_col: str) -> DataFrame:
    """``rows`` with ``wins``: of rows that claim one name the largest keeps it, the least id of equal ones."""
    order = Window.partitionBy(name).orderBy(F.coalesce(size, F.lit(0)).desc(), F.asc(id_col))
    return rows.withColumn("wins", F.row_number().over(order) == 1)


def assigned_slugs(rows: DataFrame, tiers: Sequence[str], claimed: DataFrame, id_col: str) -> DataFrame:
    """(id_col, slug, tier): a unique name for each row, by the columns ``tiers`` from short to long.

    A row takes the name of a tier if nobody else that is still without a name has it there and
    it isn't claimed (``claimed (slug)``) or taken. Rows that share a short name go on together.
    Rows left over after the last tier are not returned.
    """
    rest, taken, out = rows.select(id_col, *tiers), claimed.select("slug").distinct(), None
    for k, tier in enumerate(tiers):
        free = rest.withColumn("_n", F.count("*").over(Window.partitionBy(tier))).where("_n = 1").drop("_n")
        free = free.join(taken.withColumnRenamed("slug", tier), tier, "left_anti")
        got = free.select(id_col, F.col(tier).alias("slug"), F.lit(tier).alias("tier"))
        out = got if out is None else out.unionByName(got)
        taken = taken.union(got.select("slug"))
        rest = rest.join(got.select(id_col), id_col, "left_anti")
    return out


def pending_order(year: str, discovered: str, key: str) -> list[Order]:
    """Newest year first, then the latest discovered, then the key; an order for ``ranked_overall``.

    A failing ``try_cast`` costs an exception a row, so a text without digits isn't cast.
    """
    begin = F.substring(F.col(year), 1, 4)
    return [(F.coalesce(F.when(begin.rlike("[0-9]"), begin.try_cast("int")), F.lit(-1)), F.desc), F.desc_nulls_last(discovered), F.asc(key)]


def severity_order(severity: str, *ids: str) -> list[Order]:
    """major, notable, watch, others; then the ids. An order for ``ranked_overall``."""
    return [(F.coalesce(mapped(F.col(severity), SEVERITY_ORDER), F.lit(9)), F.asc), *[F.asc(c) for c in ids]]


def collated(column: str, descending: bool = False) -> Column:
    """Order of texts as people read them: letters before case, not by code."""
    key = F.collate(F.col(column), "UNICODE")
    return key.desc() if descending else key.asc()


def asked_ids(spark_frame: DataFrame, ids: Sequence[str], id_col: str, most: int = 25) -> DataFrame:
    """The rows of the asked ids in the order asked: trimmed, blank ones left out, each once, at most ``most``; ``position`` counts from 0."""
    wanted = list(dict.fromkeys(i.strip() for i in ids if i.strip()))[:most]
    kind = spark_frame.schema[id_col].dataType.simpleString()
    asked = spark_frame.sparkSession.createDataFrame([(p, i) for p, i in enumerate(wanted)], "position int, asked string")
    return spark_frame.join(F.broadcast(asked.select("position", F.col("asked").try_cast(kind).alias(id_col))), id_col)
