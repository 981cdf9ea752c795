"""Reading tables and cutting lineage through a shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables written so far inside the innermost ``working``.
_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One Parquet table of a data directory; the path may be any that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or a local one on a local master."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def materialize(df: DataFrame, name: str = "step", compression: str = "snappy") -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and returns the table read back.

    What follows starts from files, so a lost executor costs no recomputation of ``df``
    and ids made by ``monotonically_increasing_id`` stay as they were written.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/cairnwork/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    own = _written.get()
    if own is not None:
        own.append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` returned and that nothing reads any more: what was made of them is itself written."""
    for table in tables:
        discard_folder(table.sparkSession, table.written_at)


def discard_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of files that nothing reads any more, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def working() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end, also on an error, what ``materialize`` wrote inside it, but for the tables given to the function that it yields.

    A result that is used later must read kept tables and the caller's own alone.
    """
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    outer = _written.get()
    mark = _written.set(own)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _written.reset(mark)
        discard(*[t for t in own if not any(t is k for k in kept)])
        if outer is not None:
            outer += kept
