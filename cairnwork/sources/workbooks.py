"""Workbooks (XLSX) as tables of cells, and the fields that cell maps find in them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "file string, sheet string, hidden boolean, cell string, value string"
PACKAGE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _named(tree: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    """Elements of a local name, whatever their namespace."""
    return (x for x in tree.iter() if x.tag.rsplit("}", 1)[-1] == name)


def read_cells(content: bytes) -> Iterator[tuple[str, bool, str, str]]:
    """(sheet, whether it is hidden, cell, text) of all cells that hold something, sheet by sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in _named(si, "t")) for si in _named(ElementTree.fromstring(book.read("xl/sharedStrings.xml")), "si")]
        links = {r.get("Id"): r.get("Target") for r in _named(ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")), "Relationship")}
        for sheet in _named(ElementTree.fromstring(book.read("xl/workbook.xml")), "sheet"):
            target = links.get(sheet.get(PACKAGE), "").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            if path not in names:
                continue
            for cell in _named(ElementTree.fromstring(book.read(path)), "c"):
                value = next(_named(cell, "v"), None)
                text = value.text if value is not None else "".join(t.text or "" for t in _named(cell, "t"))
                if cell.get("t") == "s" and text:
                    text = shared[int(text)]
                if cell.get("t") == "b" and text:
                    text = "TRUE" if text == "1" else "FALSE"
                if text:
                    yield sheet.get("name"), sheet.get("state", "visible") != "visible", cell.get("r"), re.sub(r"\.0$", "", text) if cell.get("t") in (None, "n") else text


def workbook_cells(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    """``(file, sheet, hidden, cell, value)`` of the workbooks at ``path``, all as text. One workbook is one task's work; it must fit one binary value (2 GB)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in CELLS.split(", ")]
        for frame in frames:
            for source, content in zip(frame["path"], frame["content"], strict=True):
                part = []
                for cell in read_cells(content):
                    part.append((source, *cell))
                    if len(part) == rows:
                        yield pd.DataFrame(part, columns=names)
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CELLS)


def own_cell_map(cells: DataFrame, map_sheet: str) -> DataFrame:
    """``(file, field, sheet, cell)`` from a sheet of each workbook that tells where its answers stand: field, sheet and cell in its columns A, B and C, under a header."""
    part = cells.where(F.col("sheet") == map_sheet).select("file", F.regexp_extract("cell", "^([A-Z]+)", 1).alias("c"), F.regexp_extract("cell", "(\\d+)$", 1).cast("int").alias("r"), "value").where("r > 1")
    wide = part.groupBy("file", "r").agg(*[F.max(F.when(F.col("c") == c, F.trim("value"))).alias(n) for c, n in (("A", "field"), ("B", "sheet"), ("C", "cell"))])
    return wide.where("field IS NOT NULL AND sheet IS NOT NULL AND cell IS NOT NULL").select("file", "field", "sheet", F.upper(F.replace("cell", F.lit("$"), F.lit(""))).alias("cell"))


def answers(cells: DataFrame, cell_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((file, field, value), (file, asked, filled, blank)) of workbooks by a map of cells.

    ``cell_map`` has (field, sheet, cell), and ``file`` where each workbook has its own. White
    space around a value doesn't count; a cell that isn't there or is blank is a blank field.
    """
    keys = ["file", "sheet", "cell"] if "file" in cell_map.columns else ["sheet", "cell"]
    filled = cells.select("file", "sheet", "cell", F.nullif(F.trim("value"), F.lit("")).alias("value")).where("value IS NOT NULL")
    found = filled.join(cell_map, keys).select("file", "field", "value")
    files, got = cells.select("file").distinct(), found.groupBy("file").agg(F.count("*").alias("filled"))
    if "file" in cell_map.columns:
        asked = cell_map.groupBy("file").agg(F.count("*").alias("asked"))
        counts = files.join(asked, "file", "left").join(got, "file", "left")
    else:
        counts = files.join(got, "file", "left").withColumn("asked", F.lit(cell_map.count()))
    counts = counts.select("file", F.coalesce("asked", F.lit(0)).alias("asked"), F.coalesce("filled", F.lit(0)).alias("filled"))
    return found, counts.withColumn("blank", F.col("asked") - F.col("filled"))


def column_layout(cells: DataFrame, sheet: str) -> DataFrame:
    """``(file, field, value)`` of the reduced layout: field in column A, question in B, answer in C of one sheet; answers alone count."""
    part = cells.where(F.col("sheet") == sheet).select("file", F.regexp_extract("cell", "^([A-Z]+)", 1).alias("c"), F.regexp_extract("cell", "(\\d+)$", 1).alias("r"), F.trim("value").alias("value"))
    wide = part.groupBy("file", "r").agg(*[F.max(F.when(F.col("c") == c, F.col("value"))).alias(n) for c, n in (("A", "field"), ("C", "value"))])
    return wide.where("field <> '' AND value <> ''").select("file", "field", "value")


def sheet_table(cells: DataFrame, sheet: str, columns: dict[str, str]) -> DataFrame:
    """``(file, row, columns...)``: a sheet as a table by its header row, which ``columns`` names (output name to header, ignoring case)."""
    part = cells.where(F.lower("sheet") == sheet.lower()).select("file", F.regexp_extract("cell", "^([A-Z]+)", 1).alias("c"), F.regexp_extract("cell", "(\\d+)$", 1).cast("int").alias("row"), F.trim("value").alias("value"))
    head = part.where("row = 1").select("file", "c", F.lower("value").alias("name"))
    body = part.where("row > 1").join(head, ["file", "c"])
    return body.groupBy("file", "row").agg(*[F.max(F.when(F.col("name") == h.lower(), F.col("value"))).alias(out) for out, h in columns.items()])
