"""Lines, tables, overlays, queues and map merges on small cases with nulls and repeated rows."""

import datetime as dt

from pyspark.sql import functions as F

from cairnwork.functions import scalars as X
from cairnwork.operators import joins as J
from cairnwork.operators import lines as T
from cairnwork.operators import queue as Q


def test_tables_and_sections(spark):
    text = "top\n| a | b |\n|---|:-:|\n| 1 | |\n\n## Part one\n| x |\nend"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    rows = T.with_sections(T.lines(docs, "id", "text"), "id")
    assert [(r.start, r["at"], r.section, r.cells) for r in T.table_rows(rows, "id").orderBy("at").collect()] == [(1, 1, None, ["a", "b"]), (1, 3, None, ["1", ""]), (6, 6, "Part one", ["x"])]


def test_claims_take_pending_and_lapsed_rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "pending", None, 0), (2, "in_work", t, 1), (3, "in_work", t + dt.timedelta(minutes=9), 1), (4, "done", t, 1), (5, "pending", None, 0), (6, "in_work", None, 2)]
    queue = spark.createDataFrame(rows, "id int, status string, claimed_at timestamp_ntz, attempts int")
    after, lost = Q.claim(queue, "id", [F.col("id")], F.lit(t + dt.timedelta(minutes=10)).cast("timestamp_ntz"), 600, 2)
    assert {r.id: (r.status, r.attempts) for r in after.collect()} == {1: ("in_work", 1), 2: ("in_work", 2), 3: ("in_work", 1), 4: ("done", 1), 5: ("pending", 0), 6: ("in_work", 2)}
    assert [(r.id, r.attempt, r.outcome) for r in lost.collect()] == [(2, 1, "timed_out")]


def test_latest_overlay_keeps_equal_rows_and_nulls(spark):
    base = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "k int, v string")
    extra = spark.createDataFrame([(1, 5, "x"), (1, 9, "y"), (2, 1, "z")], "k int, t int, w string")
    out = J.latest_overlay(base, extra, ["k"], "e.t < 9 OR b.v IS NULL", [-F.col("e.t")], ["w"])
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, "a", "x"), (1, "a", "x"), (None, "b", None), (2, None, "z")]))


def test_merged_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "4"}), ({"d": "5"}, None), (None, None)], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in df.select(X.merged_maps(F.col("x"), F.col("y"))).collect()] == [{"a": "1", "b": "3"}, {"c": "4"}, {"d": "5"}, None]
