"""Places in a sort by expressions."""

import pytest

from cairnwork.operators import picks, places, position
from cairnwork.operators.ranking import ranked_overall


@pytest.mark.parametrize("order", [lambda: picks.pending_order("a", "b", "k"), lambda: picks.severity_order("a", "k"), lambda: position.match_order("admit_rate")])
def test_a_sort_compares_columns_alone(spark, capsys, monkeypatch, order):
    monkeypatch.setattr(places, "materialize", lambda df, name: df)
    rows = spark.range(3).selectExpr("id AS k", "cast(id AS string) AS a", "id AS b", "cast(id AS string) AS fit", "cast(id AS string) AS outlook", "cast(id AS double) AS acceptance_rate", "id AS rank_score", "cast(id AS string) AS name")
    placed = places.sorted_ranges(rows, order())
    placed.explain(True)
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    sort = [x.split("Sort [")[1] for x in plan.splitlines() if "Sort [" in x]
    assert len(sort) == 1 and "(" not in sort[0].split("]")[0]
    assert placed.columns == [*rows.columns, "_part", "_at"]


def test_pending_order_of_odd_years(spark):
    rows = [(1, "unknown", 1), (2, None, 2), (3, "2021-05", 1), (4, "2021-04", 2), (5, " 99x", 9), (6, "+202", 1), (7, "-2", 9), (8, "", None), (9, " 7 ", 0), (10, "2022", None)]
    made = ranked_overall(spark.createDataFrame(rows, "k int, span string, at int"), picks.pending_order("span", "at", "k"), "place")
    assert made.columns == ["k", "span", "at", "place"]
    assert [r.k for r in made.orderBy("place").collect()] == [10, 4, 3, 6, 9, 5, 2, 1, 8, 7]
    assert [r.place for r in made.orderBy("place").collect()] == list(range(1, 11))
