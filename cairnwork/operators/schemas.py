"""Form schemas as tables: structural filters, flat indexes, differences with renames, equivalences and table names by year."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwork.functions.parsing import normalised_label
from cairnwork.operators.ranking import first_per_key


def matching_fields(fields: DataFrame, **equal: object) -> DataFrame:
    """The fields that equal every filter given (None: not asked); ``prefix_<column>`` asks for a beginning."""
    for name, value in equal.items():
        if value is None:
            continue
        fields = fields.where(F.coalesce(F.col(name.removeprefix("prefix_")).startswith(value), F.lit(False)) if name.startswith("prefix_") else F.col(name) == value)
    return fields


def unique_fields(fields: DataFrame, by: list[str], wanted: DataFrame, number: str = "question_number") -> DataFrame:
    """``wanted`` with the number of the one field that has its values of ``by``; null if none or several do."""
    single = fields.groupBy(*by).agg(F.count("*").alias("_n"), F.min(number).alias(number)).where("_n = 1").drop("_n")
    return wanted.join(single, by, "left")


def flat_index(schemas: DataFrame) -> DataFrame:
    """(version, subsection, row, column, raw_row, raw_column): the fields of nested schemas, the first of equal keys.

    ``schemas`` has version and sections: array of (subsections: array of (id, questions: array of
    (row_label, columns: array of (header)))). Labels are normalised.
    """
    rows = schemas.select("version", F.posexplode("sections").alias("p1", "s")).select("version", "p1", F.posexplode("s.subsections").alias("p2", "u"))
    rows = rows.select("version", "p1", "p2", "u.id", F.posexplode("u.questions").alias("p3", "q")).select("version", "p1", "p2", "p3", "id", "q.row_label", F.posexplode("q.columns").alias("p4", "c"))
    flat = rows.select(
        "version", F.col("id").alias("subsection"), normalised_label(F.col("row_label")).alias("row"), normalised_label(F.coalesce("c.header", F.lit(""))).alias("column"),
        F.col("row_label").alias("raw_row"), F.col("c.header").alias("raw_column"), "p1", "p2", "p3", "p4",
    )
    return first_per_key(flat, ["version", "subsection", "row", "column"], [F.asc(f"p{i}") for i in (1, 2, 3, 4)]).drop("p1", "p2", "p3", "p4")


PAIRS = "subsection string, column string, old string, new string, similarity double"


def renamed(removed: DataFrame, added: DataFrame, least: float = 0.55) -> DataFrame:
    """(subsection, column, old, new, similarity): removed fields paired with added ones of the same subsection and column.

    In each group, removed labels in order take the most similar label that is still free, at
    ``least`` or more, the last of equal ones; both are then used. Both sides have (subsection,
    column, row). A group holds the fields of one column of one subsection of a form.
    """

    def pair(gone: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        free, out = sorted(new["row"]), []
        for old in sorted(gone["row"]):
            scored = [(SequenceMatcher(None, old, label).ratio(), k) for k, label in enumerate(free)]
            best = max(scored, default=(0.0, -1))
            if best[0] >= least:
                label = free.pop(best[1])
                out.append((gone["subsection"].iloc[0], gone["column"].iloc[0], old, label, best[0]))
        return pd.DataFrame(out, columns=["subsection", "column", "old", "new", "similarity"])

    left, right = (x.select(*[F.col(c).alias(c) for c in ("subsection", "column", "row")]).groupBy("subsection", "column") for x in (removed, added))
    return left.cogroup(right).applyInPandas(pair, PAIRS)


def schema_diff(old: DataFrame, new: DataFrame, least: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """((subsection, column, row, class, other), counts of each class by subsection) of two flat indexes.

    Classes: unchanged, removed, added and possibly_renamed, where ``other`` is the new label.
    """
    keys = ["subsection", "column", "row"]
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    gone, fresh = a.join(b, keys, "left_anti"), b.join(a, keys, "left_anti")
    pairs = renamed(gone, fresh, least)
    moved = pairs.select("subsection", "column", F.col("old").alias("row"), F.lit("possibly_renamed").alias("class"), F.col("new").alias("other"))
    none = F.lit(None).cast("string").alias("other")
    rows = a.join(b, keys, "left_semi").select(*keys, F.lit("unchanged").alias("class"), none).unionByName(moved)
    rows = rows.unionByName(gone.join(moved.select(*keys), keys, "left_anti").select(*keys, F.lit("removed").alias("class"), none))
    taken = pairs.select("subsection", "column", F.col("new").alias("row"))
    rows = rows.unionByName(fresh.join(taken, keys, "left_anti").select(*keys, F.lit("added").alias("class"), none))
    counts = rows.groupBy("subsection").agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("unchanged", "added", "removed", "possibly_renamed")])
    return rows, counts


def equivalence(matched: Column, dropped: Column) -> Column:
    """How a field of an older form stands to the current one: direct, unmapped (what it asked is no longer asked) or preserved-only."""
    return F.when(matched, "direct").when(F.coalesce(dropped, F.lit(False)), "unmapped").otherwise("preserved-only")


# Prefixes of tables that are named by the data year.
YEAR_TABLES = ("DRVCOST", "DRVADM", "DRVEF", "DRVGR", "DRVC", "ADM", "HD", "IC")


def table_of_year(table: Column, year: Column) -> Column:
    """A table's name in another data year: student aid tables go by the pair of years, others end in the year."""
    name, y = F.upper(table), year.cast("string")
    two = F.lpad((year % 100).cast("string"), 2, "0")
    before = F.lpad(((year - 1) % 100).cast("string"), 2, "0")
    out = name
    for prefix in reversed(YEAR_TABLES):
        out = F.when(name.startswith(prefix), F.concat(F.lit(prefix), y)).otherwise(out)
    out = F.when(name.startswith("EF") & name.endswith("D"), F.concat(F.lit("EF"), y, F.lit("D"))).otherwise(out)
    out = F.when(name.startswith("COST1_"), F.concat(F.lit("COST1_"), y)).otherwise(out)
    return F.when(name.startswith("SFA"), F.concat(F.lit("SFA"), before, two)).otherwise(out)


def resolved_tables(mappings: DataFrame, available: DataFrame) -> DataFrame:
    """``mappings`` (table, variable) with ``resolved``: the table itself if it has the variable, else the only table of its family that has it, else the table as it was."""
    have = available.select(F.upper("table").alias("_t"), F.upper("variable").alias("_v")).distinct()
    family = F.regexp_replace(F.regexp_replace(F.col("_t"), "\\d+.*$", ""), "_+$", "")
    families = have.groupBy("_v", family.alias("_f")).agg(F.count("*").alias("_n"), F.min("_t").alias("_only")).where("_n = 1")
    rows = mappings.withColumns({"_t": F.upper("table"), "_v": F.upper("variable")}).withColumn("_f", F.regexp_replace(F.regexp_replace("_t", "\\d+.*$", ""), "_+$", ""))
    rows = rows.join(have.withColumn("_own", F.lit(True)), ["_t", "_v"], "left").join(families.select("_v", "_f", "_only"), ["_v", "_f"], "left")
    return rows.select(*mappings.columns, F.when(F.col("_own"), F.col("_t")).otherwise(F.coalesce("_only", "_t")).alias("resolved"))


def latest_version(fields: DataFrame, key: str, version: str) -> DataFrame:
    """Each field by the newest version of the form that has it."""
    return fields.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_r = 1").drop("_r")
