"""Renames between forms against a plain greedy pairing, and pushed filters."""

from difflib import SequenceMatcher

import pytest

from cairnwork.operators import aggregates as A
from cairnwork.operators import filters as L
from cairnwork.operators import schemas as S


def test_renames_are_greedy_and_one_to_one(spark):
    gone = [("s", "c", r) for r in ("men who applied", "women who applied", "total applied", "zzz")] + [("t", "c", "alone")]
    new = [("s", "c", r) for r in ("men that applied", "women that applied", "all who applied")] + [("t", "d", "alone")]
    schema = "subsection string, column string, row string"
    got = {(r.old, r.new) for r in S.renamed(spark.createDataFrame(gone, schema), spark.createDataFrame(new, schema)).collect()}
    free, expected = sorted(r for s, c, r in new if s == "s"), set()
    for old in sorted(r for s, c, r in gone if s == "s"):
        best = max(((SequenceMatcher(None, old, x).ratio(), i) for i, x in enumerate(free)), default=(0, -1))
        if best[0] >= 0.55:
            expected.add((old, free.pop(best[1])))
    assert got == expected
    rows, counts = S.schema_diff(spark.createDataFrame(gone, schema), spark.createDataFrame(new, schema))
    assert {r.subsection: (r.unchanged, r.added, r.removed, r.possibly_renamed) for r in counts.collect()} == {"s": (0, 3 - len(expected), 4 - len(expected), len(expected)), "t": (0, 1, 1, 0)}
    assert rows.count() == (3 - len(expected)) + (4 - len(expected)) + len(expected) + 2


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1.0, "R"), (20.0, ""), (float("nan"), "A"), (None, None), (float("inf"), "N"), (30.0, "N")], "q double, f string").write.parquet(path)
    search = L.Search(spark.read.parquet(path), ["q", "f"])
    rows = search.rows([("q", ">=", 10), ("f", "!=", "R")], ["q", "f"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(q,10.0)" in pushed and "Not(EqualTo(f,R))" in pushed
    assert [tuple(r) for r in rows.collect()] == [(30.0, "N")]
    assert search.rows([("q", "is blank", None)], ["f"]).count() == 1 and search.rows([("f", "is not blank", None)], ["f"]).count() == 4
    for wrong in ([("x", "=", 1)], [("q", "~", 1)]):
        with pytest.raises(ValueError):
            search.check(wrong)
    with pytest.raises(ValueError):
        search.check([], ["x"])
    assert search.required([("q", ">", 1), ("f", "is blank", None), ("q", "<", 3)]) == ["q"]


def test_quantiles_of_large_groups_equal_small_ones(spark):
    rows = [(k % 3 if k % 50 else None, float((k * 7919) % 1000)) for k in range(2000)] + [(9, 1.0), (9, None), (8, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    a, b = (sorted(map(str, f(df, ["k"], "v", points).where("p50 IS NOT NULL").collect())) for f in (A.quantiles, A.ranked_quantiles))
    assert a == b
