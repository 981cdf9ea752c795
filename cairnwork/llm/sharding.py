"""Sharding by a hierarchical weighted hash tree.

Shards stand in slots of racks, and racks in regions, filled in order; a tree of more shards is the same
tree with more slots filled. A weight is taken as a sum of powers of two (its bits), and each of
these layers is drawn on its own. A region draws, for each key and layer, an exponential variate with the
weight of all its slots as rate; hash draws then choose a rack below it and a slot below the rack. If
a shard with that layer stands in the slot, it holds the region's draw. If not, each shard of the
region takes the draw plus an exponential variate of its own, as if the slots before had been passed
by. The least draw of all regions and layers wins. So each slot has a time of its own for each key,
whatever the other slots hold, that is exponential with its weight as rate: shards are
chosen in proportion to their weights; a full region costs one draw and its descent; and a shard that
comes, goes or changes its weight moves rows only into or out of itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwork.llm.rows import ordinals

#: Racks of a region, slots of a rack, and bits of a weight after the point.
RACKS, SLOTS, FRACTION = 2, 4, 8


def layers(shards: int, weights: Sequence[float] | None = None) -> list[tuple[int, int, list[int]]]:
    """(region, bit, its slots that hold a shard whose weight has this bit) of the tree; weights are rounded to multiples of 2**-FRACTION."""
    scaled = [round((weights[s] if weights else 1.0) * (1 << FRACTION)) for s in range(shards)]
    if not scaled or min(scaled) <= 0:
        raise ValueError("a tree needs shards of positive weight")
    size = RACKS * SLOTS
    out = []
    for region in range(0, shards, size):
        own = scaled[region : region + size]
        for bit in range(max(own).bit_length()):
            held = [slot for slot, w in enumerate(own) if w >> bit & 1]
            if held:
                out.append((region // size, bit, held))
    return out


def _hash(key: str, *place: Column) -> Column:
    return F.xxhash64(F.col(key), *place)


def _variate(bits: Column) -> Column:
    """-ln(u) with u in (0, 1) from 52 bits of a hash."""
    return -F.log((F.shiftrightunsigned(bits, 12) + F.lit(0.5)) / F.lit(float(1 << 52)))


def tree_shard(key: str, shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard of a key in the tree of so many shards: a look-up in arrays, of the same code at any number."""
    size = RACKS * SLOTS
    entries = F.array(*[F.struct(F.lit(r).alias("region"), F.lit(b).alias("bit"), F.lit(float(2.0 ** (b - FRACTION))).alias("weight"), F.array(*map(F.lit, held)).alias("held")) for r, b, held in layers(shards, weights)])

    def best(e: Column) -> Column:
        drawn = _variate(_hash(key, e["region"], e["bit"], F.lit("region"))) / (e["weight"] * size)
        rack = F.pmod(_hash(key, e["region"], e["bit"], F.lit("rack")), F.lit(RACKS))
        slot = F.pmod(_hash(key, e["region"], e["bit"], rack, F.lit("slot")), F.lit(SLOTS))
        first = (rack * SLOTS + slot).cast("int")
        others = F.transform(e["held"], lambda s: F.struct((drawn + _variate(_hash(key, e["region"], e["bit"], F.lit("own"), s)) / e["weight"]).alias("time"), (e["region"] * size + s).alias("shard")))
        return F.when(F.array_contains(e["held"], first), F.struct(drawn.alias("time"), (e["region"] * size + first).alias("shard"))).otherwise(F.array_min(others))

    return F.array_min(F.transform(entries, best))["shard"]


def assign(rows: DataFrame, key: str, shards: int, weights: Sequence[float] | None = None, grown: int | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and, if ``grown`` is given, ``grown_shard`` for the tree of that many shards.

    Shards without a weight in ``weights`` weigh 1. A null key is one more key and goes to one
    shard. Columns of those two names are replaced.
    """
    filled = [*(weights or []), *[1.0] * max(shards, grown or 0)]
    out = rows.withColumn("shard", tree_shard(key, shards, filled))
    return out.withColumn("grown_shard", tree_shard(key, grown, filled)) if grown else out


def with_slots(rows: DataFrame, shard: str, *order: str) -> DataFrame:
    """``rows`` with ``slot``: places 0, 1, ... in each shard by ``order``, with no shard in one task.

    Rows are range-sorted by (shard, order); a slot is a row's place in its range, less the
    shard's first place there, plus the shard's rows in ranges before. Only that table of
    (range, shard), at most ranges + shards rows, is broadcast.
    """
    placed = ordinals(rows, shard, *order)
    runs = placed.groupBy("part", shard).agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(shard).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    out = placed.join(F.broadcast(starts), ["part", shard])
    return out.withColumn("slot", F.col("at") - F.col("_first") + F.col("_before")).drop("part", "at", "_first", "_before")


def shard_documents(docs: DataFrame, shards: int, grown: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, size, text_crc32, law, shard, slot, grown_shard)`` for each row of ``docs`` under the law ``key``.

    Size is the text's UTF-8 bytes plus 1 (null: 1, checksum 0). The id and the number of
    shards decide alone; equal ids share a shard and take neighbouring slots, and rows of
    equal id, size and checksum are interchangeable.
    """
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = with_slots(assign(rows, id_col, shards, grown=grown or shards + 1), "shard", id_col, "size", "text_crc32")
    return placed.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
