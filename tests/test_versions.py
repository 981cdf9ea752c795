"""Replacement by pointer: failing writes, readers during a write, frames that read their own target, rival writers."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairnwork.sinks import files
from cairnwork.sinks import versions as V


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _table(spark, rows):
    return spark.createDataFrame(rows, "k bigint, v string")


def _failing(spark):
    return spark.range(5).select(F.col("id").alias("k"), F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).cast("string").alias("v"))


def test_versions_readers_and_failing_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    assert V.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        V.read(spark, path)
    first = V.commit(_table(spark, [(1, "a"), (2, "b"), (None, "n")]), path, "k", 4)
    assert (first.number, first.rows) == (1, 3)
    reader = V.read(spark, path)
    second = V.commit(V.read(spark, path).where("k = 1").union(_table(spark, [(5, "e")])), path, "k", 4)
    assert (second.number, second.rows) == (2, 2)
    assert _rows(reader.where("k IS NOT NULL")) == [(1, "a"), (2, "b")] and reader.count() == 3
    assert _rows(V.read(spark, path)) == [(1, "a"), (5, "e")] and V.read(spark, path, 1).count() == 3
    before = sorted(os.listdir(f"{path}/data"))
    with pytest.raises(PySparkException):
        V.commit(_failing(spark), path, "k", 4)
    assert V.current(spark, path).number == 2 and sorted(os.listdir(f"{path}/data")) == before and len(os.listdir(f"{path}/manifests")) >= 2
    empty = V.commit(V.read(spark, path).where("k < 0"), path, "k", 4)
    assert empty.rows == 0 and V.read(spark, path).columns == ["k", "v"] and V.read(spark, path).count() == 0


def test_rival_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.commit(_table(spark, [(1, "a")]), path, "k")
    with pytest.raises(V.Conflict):
        V.commit(_table(spark, [(1, "z")]), path, "k", expected=0)
    place = V._Files.put_in_place

    def beaten(self, source, target):
        monkeypatch.setattr(V._Files, "put_in_place", place)
        V.commit(_table(spark, [(7, "rival")]), path, "k")
        place(self, source, target)

    monkeypatch.setattr(V._Files, "put_in_place", beaten)
    with pytest.raises(V.Conflict):
        V.commit(_table(spark, [(1, "z")]), path, "k")
    assert V.versions(spark, path) == [1, 2] and _rows(V.read(spark, path)) == [(7, "rival")]
    assert len(os.listdir(f"{path}/data")) == 2


def test_documents_are_replaced_in_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    first = V.commit(spark.range(100).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v")), path, "k", 8)
    second = V.replace_documents(_table(spark, [(5, "new"), (5, "newer"), (500, "more")]), path, ["v"])
    touched = {b for b in second.folders if second.folders[b] != first.folders[b]}
    assert len(touched) <= 2 and second.rows == 102
    want = sorted([(k, str(k)) for k in range(100) if k != 5] + [(5, "new"), (5, "newer"), (500, "more")])
    assert _rows(V.read(spark, path)) == want
    for bad in ([(6, None)], [(None, "x")]):
        with pytest.raises(ValueError, match="1 rows"):
            V.replace_documents(_table(spark, bad), path, ["v"])
    assert V.current(spark, path).number == 2 and V.read(spark, path, 1).count() == 100
    third = V.replace_documents(V.read(spark, path).where("k = 7").withColumn("v", F.lit("own")), path)
    assert third.rows == 102 and V.read(spark, path).where("v = 'own'").count() == 1


def test_views_follow_their_sources_versions(spark, tmp_path):
    source, view = str(tmp_path / "s"), str(tmp_path / "v")
    V.commit(_table(spark, [(1, "a"), (1, "b"), (2, "c")]), source, "k")

    def build(rows):
        return rows.groupBy("k").agg(F.count("*").alias("n"))

    made, new = V.refresh_view(spark, view, [source], build, "k")
    assert new and made.rows == 2 and dict(made.sources) == {source: 1}
    assert V.refresh_view(spark, view, [source], build, "k") == (made, False)
    reader = V.read(spark, view)
    V.replace_documents(_table(spark, [(3, "d")]), source)
    assert _rows(V.read(spark, view)) == [(1, 2), (2, 1)]
    again, new = V.refresh_view(spark, view, [source], build, "k")
    assert new and again.rows == 3 and _rows(reader) == [(1, 2), (2, 1)] and _rows(V.read(spark, view)) == [(1, 2), (2, 1), (3, 1)]
    with pytest.raises(FileNotFoundError):
        V.refresh_view(spark, view, [str(tmp_path / "none")], build, "k")


def test_vacuum_keeps_what_kept_versions_name(spark, tmp_path):
    path = str(tmp_path / "t")
    V.commit(spark.range(50).select(F.col("id").alias("k"), F.lit("a").alias("v")), path, "k", 4)
    for k in range(3):
        V.replace_documents(_table(spark, [(k, "b")]), path)
    rows, before = _rows(V.read(spark, path)), _rows(V.read(spark, path, 3))
    os.makedirs(f"{path}/data/000000000005-underway")
    V.vacuum(spark, path, 2)
    assert V.versions(spark, path) == [3, 4] and _rows(V.read(spark, path)) == rows and _rows(V.read(spark, path, 3)) == before
    assert "000000000005-underway" in os.listdir(f"{path}/data")
    V.commit(V.read(spark, path), path, "k", 4)
    assert len(V.vacuum(spark, path, 1)) >= 1 and _rows(V.read(spark, path)) == rows
    with pytest.raises(ValueError):
        V.vacuum(spark, path, 0)


def test_a_plain_folder_keeps_its_rows_when_a_write_fails(spark, tmp_path):
    path = str(tmp_path / "plain")
    assert files.replace_table(_table(spark, [(1, "a"), (2, "b")]), path) == 2
    with pytest.raises(PySparkException):
        files.replace_table(_failing(spark), path)
    assert _rows(spark.read.parquet(path)) == [(1, "a"), (2, "b")]
    assert files.replace_table(spark.read.parquet(path).where("k = 2"), path) == 1
    assert _rows(spark.read.parquet(path)) == [(2, "b")] and sorted(os.listdir(tmp_path)) == ["plain"]
