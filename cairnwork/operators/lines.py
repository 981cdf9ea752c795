"""Texts as lines: sections under headings and the rows of pipe tables, by windows over each text's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = "^#{1,6}\\s+"


def spread(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` dealt by id over spark.sql.shuffle.partitions tasks: what reads texts row by row isn't one task for a file of one row group, and windows by id need no other shuffle."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, at, line)`` with ``at`` from 0; null texts have no lines."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "line"))


def with_sections(rows: DataFrame, id_col: str, heading: Column | None = None) -> DataFrame:
    """``rows`` of lines with ``section``: the latest heading at or before each line, null before the first.

    ``heading`` gives the heading of a line, null for other lines; Markdown headings if not given.
    """
    title = heading if heading is not None else F.when(F.col("line").rlike(HEADING), F.trim(F.regexp_replace("line", HEADING, "")))
    until = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(title, ignorenulls=True).over(until))


def table_rows(rows: DataFrame, id_col: str) -> DataFrame:
    """``(id_col, section, start, at, cells)``: the rows of pipe tables, rules such as |---|:-:| left out.

    A table is a run of adjacent lines that start with a pipe; ``start`` is its first line.
    ``rows`` has lines with sections.
    """
    piped = rows.where(F.ltrim("line").startswith("|"))
    run = F.col("at") - F.row_number().over(Window.partitionBy(id_col).orderBy("at"))
    placed = piped.withColumn("_run", run).withColumn("start", F.min("at").over(Window.partitionBy(id_col, "_run")))
    body = F.regexp_replace(F.trim("line"), "^\\||\\|$", "")
    cells = F.transform(F.split(body, "\\|"), lambda x: F.trim(x))
    return placed.where(~body.rlike("^[\\s:|-]*-[\\s:|-]*$")).select(id_col, "section", "start", "at", cells.alias("cells"))
