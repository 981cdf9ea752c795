"""Workbooks written part by part, opened as archives and read back as cells."""

import io
import zipfile

from pyspark.sql import functions as F

from cairnwork.sinks import workbooks as S
from cairnwork.sources import workbooks as W


def test_names(spark):
    given = ["a[b]:c", "  x   y ", "'quoted'", "History", None, "", "é" * 40, "'" * 3, "a\\b/c?d*e"]
    got = [r[0] for r in spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string").orderBy("i").select(S.sheet_name(F.col("g"))).collect()]
    assert got == ["a b c", "x y", "quoted", "Sheet", "Sheet", "Sheet", "é" * 31, "Sheet", "a b c d e"]
    assert S.unique_names(["A", "a", "A (2)", "x" * 31, "X" * 31]) == ["A", "a (2)", "A (2) (2)", "x" * 31, "X" * 27 + " (2)"]
    assert S._letters(1) == "A" and S._letters(27) == "AA" and S._letters(703) == "AAA"


def _rows(spark):
    rows = [
        ("u", "A General", 2, "x <&> \"y\"", 1.5, True), ("u", "A General", 1, None, 7.0, None), ("u", "B/ Enrollment", 10, "tab\there\x01", None, False), ("u", "B/ Enrollment", 9, " lead", -3.25, None),
        ("v", None, None, "", 1e300, True), ("v", "history", 1, "'=1+1", 2.0, None), (None, "A General", 1, "é", 0.0, None),
    ]
    return spark.createDataFrame(rows, "book string, section string, n int, text string, amount double, flag boolean").repartition(3)


def test_books_read_back_as_cells(spark, tmp_path):
    books = S.workbooks(_rows(spark), "book", "section", ["n", "text", "amount", "flag"], ["n"], [8, 40])
    files = {r.file: r.bytes for r in S.write_workbooks(books, "book", str(tmp_path / "out")).collect()}
    assert set(files) == {"u.xlsx", "v.xlsx", ".xlsx"}
    for name, size in files.items():
        content = (tmp_path / "out" / name).read_bytes()
        assert len(content) == size
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            assert book.testzip() is None and "xl/styles.xml" in book.namelist()
    cells = {(r.file.rsplit("/", 1)[-1], r.sheet, r.cell): r.value for r in W.workbook_cells(spark, str(tmp_path / "out" / "*.xlsx")).collect()}
    u = {k[1:]: v for k, v in cells.items() if k[0] == "u.xlsx"}
    assert {s for s, _ in u} == {"A General", "B Enrollment"}
    assert [u["A General", f"{c}1"] for c in "ABCD"] == ["n", "text", "amount", "flag"]
    assert u["A General", "A2"] == "1" and ("A General", "B2") not in u and u["A General", "C2"] == "7" and u["A General", "B3"] == 'x <&> "y"' and u["A General", "D3"] == "TRUE" and u["A General", "C3"] == "1.5"
    assert u["B Enrollment", "A2"] == "9" and u["B Enrollment", "B2"] == " lead" and u["B Enrollment", "B3"] == "tab\there" and u["B Enrollment", "D3"] == "FALSE" and ("B Enrollment", "C3") not in u
    v = {k[1:]: x for k, x in cells.items() if k[0] == "v.xlsx"}
    assert {s for s, _ in v} == {"Sheet", "Sheet (2)"} and v["Sheet", "B2"] == "'=1+1"


def test_no_rows_and_no_order(spark):
    assert S.workbooks(_rows(spark).limit(0), "book", "section", ["n"], ["n"]).count() == 0
    assert S.workbooks(_rows(spark), "book", "section", ["n"], []).count() == 3


def test_sections_and_variants(spark):
    fields = spark.createDataFrame([("d", "A", "General", None), ("d", "A", "General", "Evening"), ("e", "B", "Enrollment", None)], "doc string, section string, section_name string, variant string")
    assert {tuple(r) for r in S.section_rows(fields, "doc").select("doc", "sheet", "variant", "variants").collect()} == {("d", "A General", "Main", 2), ("d", "A General", "Evening", 2), ("e", "B Enrollment", "Main", 1)}
