"""Row identity under other splits of the scan, clashing column names, and common keys in joins."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnwork.llm import components, exact, fmindex, mixing, neardup, quality, rows
from cairnwork.storage import load, materialize

SF = "/root/testdata/sf0.001"
EXTRA = ("_row_id", "row", "doc", "id", "_id", "good", "_copies", "copies", "score", "_score", "_bytes", "carried", "_metadata", "one", "a.b")


@pytest.fixture(scope="module")
def docs(spark):
    """Documents in three files, with columns whose names operators may use inside."""
    own = load(spark, SF, "documents").repartition(3, "doc_id").select("*", *[F.lit(7).alias(c) for c in EXTRA])
    return materialize(own, "test")



@pytest.mark.parametrize("parts", ["1", "4", "24"])
def test_row_identity_does_not_depend_on_splits(spark, docs, parts):
    first = {tuple(r.row): r.doc_id for r in rows.row_table(docs, doc_id=F.col("doc_id")).collect()}
    spark.conf.set("spark.sql.files.minPartitionNum", parts)
    try:
        again = {tuple(r.row): r.doc_id for r in rows.row_table(docs, doc_id=F.col("doc_id"), text=F.col("text")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert len(first) == docs.count() and first == again


def test_computed_frames_are_written_first(spark, docs):
    assert rows.stable(docs) is docs
    for computed in (docs.union(docs), docs.where("doc_id % 2 = 0"), docs.withColumn("r", F.rand()), spark.range(5)):
        table = rows.stable(computed)
        assert table is not computed
        assert rows.row_table(table).distinct().count() == computed.count()


@pytest.mark.parametrize(
    "keep",
    [exact.drop_exact_duplicates, neardup.drop_near_duplicates, mixing.mixed_documents, lambda d: quality.keep_good(d, load(d.sparkSession, SF, "labels"))],
    ids=["exact", "near", "mix", "quality"],
)
def test_clashing_columns_come_back_unchanged(spark, docs, keep):
    out = keep(docs)
    assert out.columns == docs.columns and 0 < out.count()
    assert out.select(*[f"`{c}`" for c in EXTRA]).distinct().collect() == [tuple([7] * len(EXTRA))]
    assert out.join(docs, "doc_id", "left_anti").isEmpty()
    assert keep(materialize(docs.limit(0), "test")).count() == 0


def test_other_queries_ignore_clashing_columns(spark, docs):
    plain = docs.select("doc_id", "text", "source")
    labels = load(spark, SF, "labels")
    for run in (lambda d: quality.classify(d, labels), fmindex.remove_repeats, exact.exact_duplicates, mixing.mixed_digest):
        a, b = (sorted(map(str, run(d).collect())) for d in (docs, materialize(plain, "test")))
        assert a == b


def test_results_do_not_depend_on_splits(spark, docs):
    seen = []
    for parts in ("1", "4", "24"):
        spark.conf.set("spark.sql.files.minPartitionNum", parts)
        try:
            seen.append([sorted(map(str, f(docs).collect())) for f in (fmindex.remove_repeats, mixing.mixed_documents, exact.drop_exact_duplicates)])
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
    assert seen[0] == seen[1] == seen[2]


def test_a_score_column_is_not_replaced(spark, docs):
    ranker = quality.train(docs, load(spark, SF, "labels"))
    with pytest.raises(ValueError):
        quality.score(docs, ranker)
    assert quality.score(docs, ranker, name="worth").columns == [*docs.columns, "worth"]


def test_repeated_ids_train_the_same_model(spark, docs):
    twice = materialize(docs.union(docs.withColumn("text", F.concat(F.lit("~ "), "text"))).repartition(5), "test")
    labels = load(spark, SF, "labels")
    a, b = (quality.train(x, labels) for x in (twice, twice.coalesce(1)))
    assert (a.weights == b.weights).all() and a.threshold == b.threshold


def test_common_keys_join_whole(spark, monkeypatch):
    monkeypatch.setattr(rows, "COMMON", 50)
    monkeypatch.setattr(rows, "MOST", 4)
    rng = random.Random(1)
    keys = [0] * 400 + [1] * 300 + [rng.randrange(2, 300) for _ in range(300)] + [None] * 100
    big = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    small = materialize(big.where("k IS NOT NULL AND k % 7 <> 3").groupBy("k").agg(F.count("*").alias("n")), "test")
    joined = rows.join_common(big, small, ["k"], "n")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, big.join(small, ["k"]).collect()))


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(rows, "COMMON", 20)
    edges = [(0, k) for k in range(1, 200)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5, 5), (None, 3), (7, None)]
    out = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert out == {k: 0 for k in range(1, 200)} | {1000 + k: 1000 for k in range(1, 71)}


def test_windows_of_other_lengths(spark):
    rng = random.Random(4)
    base = [str(rng.randrange(50)) for _ in range(300)]
    texts = [" ".join(base[:200]), " ".join(base[100:]), "x " * 40, " ".join(base[150:180]), None]
    frame = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "test")
    for window in (1, 3, 8, 50, 120):
        words = [(t or "").split() for t in texts]
        starts = [tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1)]
        many = {s for s in set(starts) if starts.count(s) > 1}
        gone = [{x for k in range(len(w) - window + 1) if tuple(w[k : k + window]) in many for x in range(k, k + window)} for w in words]
        got = {r.doc_id: r.n_removed for r in fmindex.remove_repeats(frame, window=window).collect()}
        assert got == {i: len(g) for i, g in enumerate(gone)}
    with pytest.raises(ValueError):
        fmindex.Anchors(0)


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage on documents with nulls, repeated rows and clashing names, and on an empty table."""
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "one two"), (2, "one two")], "doc_id bigint, text string")
    for k in docs.columns:
        if k not in odd.columns:
            odd = odd.withColumn(k, F.lit(None).cast(docs.schema[k].dataType))
    table = materialize(docs.unionByName(odd), "test")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, table = table, materialize(stage(spark, table, SF), "test")
        assert table.columns == docs.columns and 0 < table.count()
        assert table.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, table, SF)
    assert last.count() == table.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, materialize(docs.limit(0), "test"), SF).count() == 0
