"""Texts of one file are read in many tasks."""

import pytest

from cairnwork.operators import forms, matrices, prose


@pytest.mark.parametrize("read", [prose.marked_options, prose.application_policies, prose.two_year_rates, prose.retention_rate, prose.faculty_ratio, prose.grade_average, forms.pipe_tables])
def test_texts_of_one_partition_are_dealt_over_tasks(spark, read):
    docs = spark.createDataFrame([(i, "C13 Application Fee") for i in range(40)], "id int, body string").coalesce(1)
    assert docs.rdd.getNumPartitions() == 1
    assert read(docs, "id", "body").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tables_are_read_without_windows(spark, capsys):
    docs = spark.createDataFrame([(1, "## x\n| a | b |\n|---|---|\n| c | |\n| d | 1 |\n| | 2 |\ntext\n|\n| lone | 3 |\n|")], "id int, body string")
    rows = forms.pipe_tables(docs, "id", "body")
    assert [tuple(r) for r in rows.orderBy("at", "label").collect()] == [
        (1, "x", 1, 4, "c d", ["1"], ["a", "b"]), (1, "x", 1, 5, "c d", ["2"], ["a", "b"]), (1, "x", 8, 8, "lone", ["3"], ["", ""]),
    ]
    rows.explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "Sort" not in plan


def test_a_label_is_normalised_once_for_all_keys(spark, capsys):
    rows = spark.range(1).selectExpr("cast(id AS string) AS label")
    rows.select(forms._first_of(forms.normalised_label(rows["label"]), forms.NONACADEMIC).alias("first")).explain(True)
    plan = capsys.readouterr().out.split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1]
    assert plan.count("freshm") == 1


def test_tables_are_rebuilt_and_read_back_after_one_shuffle(spark, capsys):
    values = spark.createDataFrame([(1, "H.501", "5"), (1, "C.101", None), (1, "C.101", "7"), (1, "H.502", "9"), (1, "H.502", "8"), (2, "C.702", "Important"), (2, "C.101", " ")], "doc int, field string, value string")
    made = matrices.matrices(values, "doc")
    assert {tuple(r) for r in matrices.field_values(made, "doc").collect()} == {(1, "H.501", "5"), (1, "H.502", "8"), (2, "C.702", "Important")}
    assert {r.name for r in made.where("doc = 1").collect()} == {"h5-student-loans"}
    back = matrices.fields_of_tables(forms.pipe_tables(matrices.markdown(made, "doc"), "doc", "text"), "doc")
    capsys.readouterr()
    back.explain()
    plan = capsys.readouterr().out
    by_doc = [x for x in plan.splitlines() if "Exchange hashpartitioning(doc" in x]
    assert len(by_doc) == 1, plan
    assert {tuple(r) for r in back.collect()} == {(1, "H.501", "5"), (1, "H.502", "8"), (2, "C.702", "Important")}


def test_where_a_table_begins_is_found_once(spark, capsys):
    docs = spark.createDataFrame([(1, "## H5 student loans\n| | Number in class | Percent of class | Average per borrower |\n|---|---|---|---|\n| Any loan program | 1 | | |")], "id int, body string")
    back = matrices.fields_of_tables(forms.pipe_tables(docs, "id", "body"), "id")
    assert [tuple(r) for r in back.collect()] == [(1, "H.501", "1")]
    capsys.readouterr()
    back.explain(True)
    plan = capsys.readouterr().out.split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1]
    assert plan.count("array_position(") == 1 and plan.count("split(") == 3, plan
