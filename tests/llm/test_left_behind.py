"""What operators leave in the work folder, and units of very many rows in the mix."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnwork.llm import mixing, queries, rows
from cairnwork.storage import discard, materialize, work_dir, working

SF = "/root/testdata/sf0.001"
#: Tables that a query's result itself reads.
INPUTS = {
    "op1_simhash_golay": 2, "op2_quality_bradley_terry": 0, "op3_mix_pivotal": 1, "op4_licence_sentences": 0, "op5_substring_fm_index": 2, "op6_exact_block_names": 2, "op7_bpe_pair_index": 0, "op8_orc_tokens": 1, "op9_shard_hash_tree": 1,
    "op10_lossless_webp": 0, "op11_word_runs": 0, "op12_url_bloom_join": 2, "op13_source_divergence": 4,
}


def _folders(spark):
    top = f"{work_dir(spark)}/cairnwork"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


@pytest.mark.parametrize("name", list(INPUTS))
def test_queries_leave_what_their_result_reads(spark, name):
    before = _folders(spark)
    out = queries.QUERIES[name](spark, SF)
    assert len(_folders(spark) - before) == INPUTS[name]
    assert out.count() > 0


def test_the_pipeline_leaves_its_last_stage(spark):
    before = _folders(spark)
    out = corpus_pipeline.run(spark, SF)
    assert len(_folders(spark) - before) == 1 and out.count() > 0


def test_tables_go_on_errors_and_kept_ones_belong_to_the_outside(spark):
    before = _folders(spark)
    with working() as keep:
        with working() as inner:
            a = inner(materialize(spark.range(3)))
            b = materialize(spark.range(4))
        assert len(_folders(spark) - before) == 1 and a.count() == 3 and not os.path.exists(b.written_at)
        with pytest.raises(ZeroDivisionError), working():
            materialize(spark.range(5))
            raise ZeroDivisionError
        c = keep(materialize(spark.range(6)))
    assert not os.path.exists(a.written_at) and c.count() == 6
    discard(c)
    assert _folders(spark) == before


def test_places_in_groups_of_any_size(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), (F.col("id") * 7919 % 5003).alias("k"))
    want = {}
    for g, k in sorted(map(tuple, df.collect())):
        want[g, k] = sum(1 for x in want if x[0] == g) + 1
    assert {(r.g, r.k): r.place for r in rows.places(df, "g", "k").collect()} == want


def test_a_unit_of_very_many_rows(spark, monkeypatch):
    """All rows of a source have a null id and one size: they are listed in parts and numbered by a range sort."""
    many = spark.range(2600).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    few = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("t").alias("source"))
    docs = materialize(many.union(few), "test")
    out = mixing.mixed_digest(docs).collect()
    assert len(out) == 2900
    taken, target = sum(r.taken for r in out if r.doc_id is None), next(r.target for r in out if r.doc_id is None)
    assert abs(taken - target) <= 3
    mixed = mixing.mixed_documents(docs)
    assert mixed.where("doc_id IS NULL").count() * 3 == taken
    assert mixed.where("doc_id IS NOT NULL").count() * 5 == sum(r.taken for r in out if r.doc_id is not None)
    monkeypatch.setattr(mixing, "COMMON", 10_000)
    assert sorted(map(str, mixing.mixed_digest(docs).collect())) == sorted(map(str, out)) and mixing.mixed_documents(docs).count() == mixed.count()
