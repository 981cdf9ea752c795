"""Answers beside labels on sheets whose rows and columns have moved."""

import pytest
from test_workbooks import write_book

from cairnwork.sources import recovery as R
from cairnwork.sources import workbooks as W

HEADER = "Percent and number of first-time, first-year students enrolled in Fall who submitted SAT/ACT scores"


def _cells(spark, *rows):
    return spark.createDataFrame([(f, s, c, v) for f, s, c, v in rows], "file string, sheet string, cell string, value string")


def test_columns_and_letters(spark):
    names = ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ABC", "XFD"]
    rows = R.grid(_cells(spark, *[("f", "s", f"{n}7", n) for n in names], ("f", "s", "7", "x"), ("f", "s", "A", "x"))).collect()
    assert {r.value: r.col for r in rows} == {"A": 1, "Z": 26, "AA": 27, "AZ": 52, "BA": 53, "ZZ": 702, "AAA": 703, "ABC": 731, "XFD": 16384}
    back = spark.createDataFrame([(r.col, r.value) for r in rows], "n int, name string")
    assert all(r.a == r.name for r in back.select("name", R.column_letters(back.n).alias("a")).collect())


def test_scores_of_shifted_sheets(spark):
    sheet = [("A3", "SAT Math"), ("B3", "1"), ("B9", HEADER), ("A10", "Submitting SAT Scores"), ("B10", "61%"), ("C10", "700"), ("C11", "Submitting ACT scores"), ("D11", " "), ("E11", "50"),
             ("B12", "SAT Evidence-Based Reading and Writing"), ("C12", "640"), ("D12", "690"), ("E12", "740"), ("A13", "note"), ("B13", "SAT Math"), ("C13", "9"), ("A14", "SAT  math"), ("B14", "700"), ("D14", "TRUE"),
             ("A15", "C10 class"), ("A16", "ACT composite"), ("B16", "30")]
    cells = _cells(spark, *[("a", "CDS-C", c, v) for c, v in sheet], *[("b", "Admissions", c, v) for c, v in sheet[2:6]], ("b", "Admission", "A1", HEADER), ("c", "CDS-B", "A1", HEADER))
    got = {(r.file, r.field): r.value for r in R.score_answers(cells).collect()}
    assert got == {
        ("a", "C.901"): "61%", ("a", "C.903"): "700", ("a", "C.902"): None, ("a", "C.904"): "50", ("a", "C.908"): "640", ("a", "C.909"): "690", ("a", "C.910"): "740", ("a", "C.911"): "700", ("a", "C.912"): None, ("a", "C.913"): None,
    }
    mapped = spark.createDataFrame([("a", "C.902", "9/1"), ("a", "C.911", "1/1"), ("b", "C.911", "5"), ("a", "D.1", "x")], "file string, field string, value string")
    merged = {(r.file, r.field): r.value for r in R.with_recovered(mapped, R.score_answers(cells)).collect()}
    assert merged == {k: v for k, v in got.items() if v is not None} | {("b", "C.911"): "5", ("a", "D.1"): "x"}


def test_applications_by_sex_and_residence(spark):
    fields = spark.createDataFrame(
        [("C.101", "Total first-time, first-year men who applied", "Men", None, None), ("C.105", "men who were admitted", "Males", "All", None), ("C.109", "full-time men who enrolled", "Men", "All", "FT"), ("C.110", "men who enrolled", "Men", "All", "PT"),
         ("C.111", "men who enrolled", "Men", "All", None), ("C.117", "students who applied", "All", "All", None), ("C.120", "students who applied", "All", "In-State", None), ("C.122", "students who applied", "All", "Nonresidents", None), ("D.101", "men who applied", "Men", "All", None)],
        "field string, question string, gender string, residency string, unit_load string",
    )
    sheet = [("B2", "Total first-time, first-year men who applied"), ("E2", "n/a"), ("F2", "1,200"), ("G2", "9"), ("A3", "First-time first-year men admitted"), ("B3", "300"), ("A4", "Full-time, first-time, first-year men who enrolled"), ("B4", "80"),
             ("A5", "Part-time, first-time, first-year men who enrolled"), ("C5", "7"), ("A6", "first-time first-year students who applied"), ("B6", "x"), ("C6", "5000"), ("D6", "3000"), ("F6", "1500"), ("G6", "500"), ("A7", "first-time first-year students applied"), ("B7", "1")]
    got = {r.field: r.value for r in R.application_answers(_cells(spark, *[("a", "C", c, v) for c, v in sheet]), fields).collect()}
    assert got == {"C.101": "1,200", "C.105": "300", "C.109": "80", "C.110": "7", "C.117": "5000", "C.120": "3000", "C.122": "500"}


def test_a_workbook_with_answer_columns(spark, tmp_path):
    book = {"A1": "title", "B3": "Question Number", "D3": "Answer", "B4": "C.101", "D4": 12, "B5": " C.102 ", "AA5": "far", "B7": "C.103", "D7": "x"}
    write_book(tmp_path / "a.xlsx", [("CDS-C", False, book), ("Other", False, {"A1": "Question number", "B1": "answer", "A2": "Z.1"})])
    cells = W.workbook_cells(spark, str(tmp_path / "*.xlsx"))
    found = R.embedded_cell_map(cells)
    assert {(r.field, r.sheet, r.cell) for r in found.collect()} == {("C.101", "CDS-C", "D4"), ("C.102", "CDS-C", "D5"), ("C.103", "CDS-C", "D7")}
    assert {(r.field, r.value) for r in W.answers(cells, found)[0].collect()} == {("C.101", "12"), ("C.103", "x")}


@pytest.mark.parametrize("rows", [[], [("a", "CDS-C", "A1", "x")]])
def test_nothing_to_recover(spark, rows):
    assert R.score_answers(_cells(spark, *rows)).count() == 0
