"""Each relational query against its SQL in DuckDB, and edge cases of the column functions."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cairnwork.functions import scalars as X
from cairnwork.operators import filters as L
from cairnwork.operators import joins as J
from cairnwork.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    rows = [sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None))) for x in (ours, theirs)]
    assert rows[0] == rows[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_blank_filters(spark):
    df = spark.createDataFrame([("5",), ("",), (None,), ("x",), ("NaN",)], "v string")
    count = lambda *a: df.where(L.condition("v", *a)).count()
    assert count("is blank") == 2 and count("is not blank") == 3
    assert count("!=", "x") == 2 and count(">=", 1, True) == 1 and count("!=", 1, True) == 1


def test_scalars(spark):
    row = spark.range(1).select(
        X.strict_number(F.lit("$1,200")).alias("a"), X.strict_number(F.lit("1-2")).alias("b"), X.half_up(F.lit(-2.5)).alias("c"), X.padded_id(F.lit(1234567)).alias("d"),
        X.safe_rate(F.lit(3), F.lit(0)).alias("e"), X.interpolated_percentile(F.lit(600.0), F.lit(500.0), F.lit(550.0), F.lit(650.0)).alias("f"),
        X.haversine_miles(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("g"), F.length(X.shaped_uuid(F.lit("k"))).alias("h"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.h) == (1200.0, None, -2, "1234567", None, 62.5, 36)
    assert abs(row.g - 69.09) < 0.1


def test_overlay_prefers_curated(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (3, "w")], "k int, v string")
    assert {tuple(r) for r in J.overlay(a, b, "k", ["v"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}
