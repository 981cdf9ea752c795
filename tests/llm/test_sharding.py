"""The hash tree against a recomputation outside Spark, and what moves when shards come or weights change."""

import math
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from cairnwork.llm import sharding
from cairnwork.storage import load, materialize

SF = "/root/testdata/sf0.001"


def spark_hash(key, *place):
    """xxhash64 of a bigint and what follows as Spark chains it: the hash of a column is the seed of the next."""
    seed = 42
    for i, x in enumerate((key, *place)):
        if x is not None:
            wide = 8 if i == 0 or isinstance(x, Wide) else 4
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else int(x).to_bytes(wide, "little", signed=True), seed)
    return seed


class Wide(int):
    """A bigint among ints."""


def variate(bits):
    return -math.log(((bits >> 12) + 0.5) / (1 << 52))


def signed(bits):
    return bits - (1 << 64) if bits >> 63 else bits


def reached(key, shards, weights=None):
    """The slot of least time; every slot's time is worked out, in every layer."""
    times = []
    for region, bit, held in sharding.layers(shards, weights):
        weight = 2.0 ** (bit - sharding.FRACTION)
        drawn = variate(spark_hash(key, region, bit, "region")) / (weight * 8)
        rack = signed(spark_hash(key, region, bit, "rack")) % 2
        first = rack * 4 + signed(spark_hash(key, region, bit, Wide(rack), "slot")) % 4
        for slot in held:
            own = 0 if slot == first else variate(spark_hash(key, region, bit, "own", slot)) / weight
            times.append((drawn + own, region * 8 + slot))
    return min(times)[1]


@pytest.mark.parametrize("weights", [None, [1, 2, 3, 4] * 5, [0.5, 1.25, 7, 100] * 5])
@pytest.mark.parametrize("shards", [1, 5, 16, 19])
def test_descent(spark, weights, shards):
    got = {r.id: (r["shard"], r.grown_shard) for r in sharding.assign(spark.range(-300, 500), "id", shards, weights, grown=shards + 1).collect()}
    assert got == {k: (reached(k, shards, weights), reached(k, shards + 1, weights)) for k in range(-300, 500)}


@pytest.mark.parametrize("weights", [None, [1 + s % 5 / 4 for s in range(60)]], ids=["even", "uneven"])
def test_one_more_shard_takes_rows_only_into_itself_at_every_count(spark, weights):
    keys = spark.range(5_000)
    rows = keys.select(*[sharding.tree_shard("id", n, weights and weights[:n]).alias(f"n{n}") for n in range(1, 42)]).collect()
    grown = sharding.assign(keys, "id", 1, weights, grown=2).select("grown_shard").collect()
    assert [r.grown_shard for r in grown] == [r.n2 for r in rows]
    for n in range(1, 41):
        moved = [(r[n - 1], r[n]) for r in rows if r[n - 1] != r[n]]
        assert moved and {y for _, y in moved} == {n}


def test_a_changed_weight_moves_rows_only_through_its_shard(spark):
    before = [1.0, 2.5, 1.0, 4.0] * 4
    for shard, weight in ((5, 3.0), (6, 2.0), (3, 5.0)):
        after = [weight if s == shard else w for s, w in enumerate(before)]
        rows = spark.range(20_000).select(sharding.tree_shard("id", 16, before).alias("a"), sharding.tree_shard("id", 16, after).alias("b")).where("a <> b").collect()
        assert rows and all(shard in (r.a, r.b) for r in rows)


def test_many_shards_stay_even(spark):
    counts = [r["count"] for r in sharding.assign(spark.range(60_000), "id", 300).groupBy("shard").count().collect()]
    assert len(counts) == 300 and min(counts) > 130 and max(counts) < 280


def test_weights_are_met(spark):
    weights = [1, 2, 3, 4] * 4
    counts = {r["shard"]: r["count"] for r in sharding.assign(spark.range(40_000), "id", 16, weights).groupBy("shard").count().collect()}
    for s, w in enumerate(weights):
        assert abs(counts[s] / 40_000 - w / 40) < 5 * math.sqrt(w / 40 / 40_000)


def test_table_against_recomputation(spark):
    rows = [(3, "é"), (3, "é"), (1, None), (None, "x"), (2, ""), (5, "long " * 50_000)]
    docs = load(spark, SF, "documents").select("doc_id", "text")
    docs = materialize(docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumn("shard", F.lit("own")).withColumn("slot", F.lit(-1)), "test")
    out = sharding.shard_documents(docs, 16).collect()
    expected = []
    for r in docs.collect():
        text = (r.text or "").encode()
        expected.append((r.doc_id, len(text) + 1, zlib.crc32(text), "key", reached(r.doc_id, 16), reached(r.doc_id, 17)))
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r["size"], r.text_crc32, r.law, r["shard"], r.grown_shard)) for r in out)
    for s in range(16):
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in out if r["shard"] == s)
        assert [x[0] for x in own] == list(range(len(own)))
        assert own == sorted(own, key=lambda x: x[1:])  # slots rise with the id
