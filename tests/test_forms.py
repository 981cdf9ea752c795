"""Pipe tables and resolvers on forms as they come out of converters."""

from pyspark.sql import functions as F

from cairnwork.operators import forms as T

FORM = """## C2 waiting list
| Waiting list | Total |
|---|---|
| Number of qualified applicants offered a place | 1,200 |
| Number accepting a place | |
| on the waiting list | 300 |
| | 301 |
| Number of wait-listed students admitted | n/a |

text between
| lone |
## C7
| Academic | Very Important | Important | Considered | Not |
|:-:|---|---|---|---|
| Rigor of secondary school record | X | | | |
| Class rank | | | x | |
| Interview | | ✓ | | |
| Volunteer work | long prose that is no mark | | | X |
## C1
| Men who applied | 1368 |
|---|---|
| Women who applied | 1,411 |
## C9
| | 25th percentile | 50th percentile | 75th percentile |
|---|---|---|---|
| SAT Composite | | | |
| SAT Math | 600 | 650 | 900 |
| ACT Composite (0-36) | 28 | 30 | 33 |
"""


def frame(spark, text):
    return spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")


def test_tables(spark):
    rows = T.pipe_tables(frame(spark, FORM), "id", "text").orderBy("at").collect()
    got = [(r.section, r.label, r["values"]) for r in rows]
    assert got[:4] == [
        ("C2 waiting list", "Number of qualified applicants offered a place", ["1,200"]),
        ("C2 waiting list", "Number accepting a place on the waiting list", ["300"]),
        ("C2 waiting list", "Number accepting a place on the waiting list", ["301"]),
        ("C2 waiting list", "Number of wait-listed students admitted", ["n/a"]),
    ]
    plain = [r for r in rows if r.section == "C1"]
    assert [(r.label, r["values"], r.headers) for r in plain] == [("Men who applied", ["1368"], ["", ""]), ("---", ["---"], ["", ""]), ("Women who applied", ["1,411"], ["", ""])]
    assert [r.label for r in rows if r.section == "C9"] == ["SAT Composite", "SAT Math", "ACT Composite (0-36)"]
    assert not [r for r in rows if r.label == "lone"] and {r.id for r in rows} == {1}


def test_resolvers(spark):
    rows = T.pipe_tables(frame(spark, FORM), "id", "text")
    fields = spark.createDataFrame(
        [("Academic Factors", "Rigor of secondary school record", "C.701"), ("Academic Factors", "Class rank", "C.702"), ("Nonacademic Factors", "Interview", "C.707"), ("Nonacademic Factors", "Volunteer work", "C.716")],
        "category string, question string, field string",
    )
    claims = [T.waiting_list(rows, "id"), T.selection_basis(rows, "id", fields), T.score_percentiles(rows, "id")]
    got = {r.field: r.value for r in T.cleaned(claims, "id").collect()}
    assert got == {
        "C.202": "1200", "C.203": "300", "C.701": "Very Important", "C.702": "Considered", "C.707": "Important", "C.716": "Not Considered",
        "C.911": "600", "C.912": "650", "C.914": "28", "C.915": "30", "C.916": "33",
    }


def test_race_columns(spark):
    text = "| | First-time, first-year | Degree-Seeking Undergraduates (include first-time first-year) | Total Undergraduates |\n|---|---|---|---|\n| Hispanic/Latino | 10 | 1,020 | 30 |\n| Asian, non-Hispanic | 4 | x | |"
    fields = spark.createDataFrame(
        [(c, k, q, f"B.{i}{j}") for i, (c, k) in enumerate([("First-time, first-year", "Degree-seeking"), ("All", "Degree-seeking"), ("All", "All")]) for j, q in enumerate(["Hispanic / Latino", "Asian, non-Hispanic"])],
        "cohort string, category string, question string, field string",
    )
    got = {r.field: r.value for r in T.enrollment_by_race(T.pipe_tables(frame(spark, text), "id", "text"), "id", fields).collect()}
    assert got == {"B.00": "10", "B.10": "1020", "B.20": "30", "B.01": "4"}


def test_claims_by_rank(spark):
    made = [spark.createDataFrame([(1, f, v, s, 0)], "id int, field string, value string, start int, at int") for f, v, s in (("A.1", "first", 5), ("A.1", "second", 1), ("B.401", "old", 1), ("B.401", "new", 9))]
    out = {r.field: r.value for r in T.cleaned([made[0], made[1], made[2], made[3]], "id", "^B\\.[45]\\d\\d$").collect()}
    assert out == {"A.1": "first", "B.401": "new"}
    assert T.cleaned([made[0].where(F.lit(False))], "id").count() == 0
