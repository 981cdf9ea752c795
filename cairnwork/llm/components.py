"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.llm.rows import join_common
from cairnwork.storage import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Labels each node of ``edges (u bigint, v bigint)`` with the least node it reaches.

    Returns ``(node, label)`` for nodes that are not their own label. Each round links
    every larger neighbour to the least one (large star) and then every smaller one
    (small star); rounds needed grow with the logarithm of the component size. A round
    is two grouped minima and two joins back, written to the shared folder; a node with very
    many links is joined by broadcast. The loop ends when a round changes no row: the tables,
    which are sets, have equal counts and no row of the new one is missing in the old one.
    Loops, repeated and reversed edges and nulls in either end are ignored; no edges give no rows.
    """
    pairs = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    pairs = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    count = pairs.count()
    for _ in range(max_rounds if count else 0):
        new, least = _round(pairs)
        before, count = count, new.count()
        settled = count == before and new.join(pairs, ["u", "v"], "left_anti").isEmpty()
        discard(pairs, least)
        pairs = new
        if settled:
            break
    else:
        if count:
            raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _round(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the links after a large and a small star, a table that the caller discards)."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
    large = join_common(both, least, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(moved.union(small).distinct(), "stars"), least
