"""Queries that write tables by version and workbooks in the work folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnwork.plans.registry import ORACLE_SQL, query
from cairnwork.sinks import versions, workbooks
from cairnwork.sources import archives
from cairnwork.sources import workbooks as read
from cairnwork.storage import load, work_dir


def _labels(s, d):
    """A versioned table of labels in which every seventh document has been replaced by two rows."""
    path = f"{work_dir(s)}/cairnwork/labels-{uuid.uuid4().hex}"
    versions.commit(load(s, d, "labels"), path, "doc_id")
    docs = load(s, d, "documents").where("doc_id % 7 = 0").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("quality"), F.lit(9).alias("toxic"))
    versions.replace_documents(docs, path, ["quality"])
    return path


REPLACED = "SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 0) UNION ALL SELECT doc_id, q, 9 FROM documents, (VALUES (0), (1)) v(q) WHERE doc_id % 7 = 0"


@query("SNK_01_replaced_by_version", f"SELECT doc_id, CAST(quality AS INTEGER) AS quality, CAST(toxic AS INTEGER) AS toxic FROM ({REPLACED})")
def _(s, d):
    return versions.read(s, _labels(s, d)).select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))


@query("SNK_02_version_before", "SELECT doc_id, CAST(quality AS INTEGER) AS quality FROM labels")
def _(s, d):
    return versions.read(s, _labels(s, d), 1).select("doc_id", F.col("quality").cast("int").alias("quality"))


@query("SNK_09_view_of_version", f"SELECT CAST(toxic AS INTEGER) AS toxic, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM ({REPLACED}) GROUP BY 1")
def _(s, d):
    source = _labels(s, d)
    versions.refresh_view(s, f"{source}-view", [source], lambda rows: rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("quality").alias("good")), "toxic")
    return versions.read(s, f"{source}-view").select(F.col("toxic").cast("int").alias("toxic"), "n", "good")


@query("SNK_11_workbook_cells", """
    WITH r AS (SELECT r_name AS book, n_name AS section, c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY r_name, n_name ORDER BY c_custkey) AS place
               FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    cells AS (SELECT book, section, 'A' || (place + 1) AS cell, CAST(c_custkey AS VARCHAR) AS value FROM r UNION ALL SELECT book, section, 'B' || (place + 1), c_name FROM r UNION ALL SELECT book, section, 'C' || (place + 1), c_mktsegment FROM r
              UNION ALL SELECT DISTINCT book, section, h.cell, h.value FROM r, (VALUES ('A1', 'c_custkey'), ('B1', 'c_name'), ('C1', 'c_mktsegment')) h(cell, value))
    SELECT replace(book, ' ', '-') || '.xlsx' AS file, section AS sheet, cell, value FROM cells""")
def _(s, d):
    return read.workbook_cells(s, f"{_books(s, d)}/*.xlsx").select(F.substring_index("file", "/", -1).alias("file"), "sheet", "cell", "value")


def _books(s, d):
    """A folder with a workbook of each region, in which each nation has a sheet of its customers."""
    nations = load(s, d, "nation").join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = load(s, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    folder = f"{work_dir(s)}/cairnwork/books-{uuid.uuid4().hex}"
    books = workbooks.workbooks(rows, "r_name", "n_name", ["c_custkey", "c_name", "c_mktsegment"], ["c_custkey"])
    workbooks.write_workbooks(books, "r_name", folder).write.format("noop").mode("overwrite").save()
    return folder


@query("SRC_11_sheet_partitions", ORACLE_SQL["SNK_11_workbook_cells"])
def _(s, d):
    return archives.sheet_cells(s, f"{_books(s, d)}/*.xlsx").select(F.substring_index("file", "/", -1).alias("file"), "sheet", "cell", "value")
