"""The identity of rows, decisions joined back through it, and joins on keys that may be very common."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnwork.storage import materialize

#: A key is common if it has more rows than COMMON and than the MOST-th part of all; so there are at most MOST common keys.
COMMON, MOST = 1000, 1000


#: Rows of an Arrow batch of whole texts.
BATCH = 2000


def short_batches(spark: SparkSession) -> None:
    """Has the session send texts to Python in batches of at most BATCH rows: the default of 10,000 takes some 100 MB on each side for a core."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def stable(docs: DataFrame) -> DataFrame:
    """``docs`` if it is a plain scan of Parquet files, else ``docs`` written once and read back.

    What is evaluated more than once and matched by row must not change in between: a
    scan of files gives the same rows each time, anything computed needn't.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() == "SubqueryAlias":
        plan = plan.child()
    if plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation"):
        try:
            row_table(docs)
            return docs
        except AnalysisException:  # a format without row numbers
            pass
    return materialize(docs, "rows")


def row_table(docs: DataFrame, **columns: Column) -> DataFrame:
    """``(row, columns...)`` for a frame that ``stable`` returned; no other name of ``docs`` comes along.

    ``row`` is (hash of the file's path, the row's number in the file). It doesn't depend on
    how a scan is split, on the number of cores or on the columns read, so every evaluation
    agrees. (Two of a million files share a 64-bit hash with a chance of 3 in 100 million.)
    """
    place = docs.metadataColumn("_metadata")
    row = F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"))
    return docs.select(row.alias("row"), *[c.alias(n) for n, c in columns.items()])


def chosen(docs: DataFrame, decisions: DataFrame, copies: str | None = None) -> DataFrame:
    """Rows of ``docs`` whose ``row`` is in ``decisions``, in docs' columns, whatever their names; repeated as the column ``copies`` says, if given."""
    picked = decisions.select("row", *([F.col(copies).cast("int").alias("copies")] if copies else []))
    kept = row_table(docs, doc=F.struct("*")).join(picked, "row")
    if copies:
        kept = kept.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return kept.select("doc.*")


def join_common(big: DataFrame, small: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """``big.join(small, keys)`` where one key may have a third of the rows of ``big``.

    ``small`` is a written table of unique keys; ``count`` says how many rows of ``big`` each
    has. Rows of common keys, of which there are at most MOST, meet their one row of
    ``small`` by broadcast and stay where they are; all others are shuffled.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    common = small.where(F.col(count) > max(COMMON, total // MOST))
    if common.isEmpty():
        return big.join(small, list(keys))
    rest = small.where(F.col(count) <= max(COMMON, total // MOST))
    others = big.join(F.broadcast(common.select(*keys)), list(keys), "left_anti").join(rest, list(keys))
    return big.join(F.broadcast(common), list(keys)).unionByName(others)


def ordinals(df: DataFrame, *order: str) -> DataFrame:
    """``df`` written in the order of ``order`` with ``part`` and ``at``: a row's range partition and its place there.

    Ranges are sorted each on its own, so no task holds more than its range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())
    return materialize(
        placed.withColumn("part", F.shiftright("_at", 33)).withColumn("at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at"), "ordered"
    )


def places(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``place``: 1, 2, ... in each group by ``order``, with no group in one task; groups are not null.

    Rows are range-sorted by (group, order); a place is a row's place in its range, less the group's
    first there, plus the group's rows in ranges before.
    """
    placed = ordinals(df, group, *order)
    parts = placed.groupBy("part", group).agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", group, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    return placed.join(starts, ["part", group]).withColumn("place", F.col("at") + F.col("_start")).drop("part", "at", "_start")
