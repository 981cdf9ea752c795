"""File sinks: JSON lines, CSV with nested columns as JSON, section folders, and replacement of partitions."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def flat(df: DataFrame) -> DataFrame:
    """``df`` with structs, maps and arrays as JSON text."""
    nested = (StructType, MapType, ArrayType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, section: str | None = None) -> None:
    """CSV with a header, quotes doubled; one folder for each value of ``section`` if given."""
    writer = flat(df).write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.partitionBy(section) if section else writer).csv(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the partitions that ``df`` has rows for and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def report_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): the rows as lines of a Markdown table, null as empty, pipes escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def replace_table(df: DataFrame, path: str) -> int:
    """Replaces the folder of files at ``path`` and returns its number of rows.

    The new files are written beside it first, so a write that fails leaves the old ones, and ``df`` may
    read them. The folders then change places by two renames; a reader in between finds none. Tables of
    ``sinks.versions`` are replaced in one step.
    """
    spark, mark, path = df.sparkSession, uuid.uuid4().hex, path.rstrip("/")
    new, old, here = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new-{mark}", f"{path}.old-{mark}", path))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(new.toString())
    except PySparkException:
        fs.delete(new, True)
        raise
    rows = spark.read.parquet(new.toString()).count()
    there = fs.exists(here)
    if there and not fs.rename(here, old):
        raise OSError(f"{path} can't be renamed")
    if not fs.rename(new, here):
        if there:
            fs.rename(old, here)
        raise OSError(f"{new.toString()} can't be renamed")
    if there:
        fs.delete(old, True)
    return rows


def replace_documents(stored: DataFrame, rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    """``stored`` with the documents of ``rows`` replaced as a whole; an error names how many rows lack a required value."""
    missing = rows.where(" OR ".join(f"`{c}` IS NULL" for c in required)).count()
    if missing:
        raise ValueError(f"{missing} rows without {', '.join(required)}")
    return stored.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(*stored.columns))
