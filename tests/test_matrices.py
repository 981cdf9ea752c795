"""Tables rebuilt from fields, and fields read back from them and from their Markdown."""

from cairnwork.operators import forms
from cairnwork.operators import matrices as M


def _values(spark, rows):
    return spark.createDataFrame(rows, "doc int, field string, value string, question string, schema_version string")


def _cells(df):
    return {(r.doc, r.name, r.label, c.column): (c.display, c.missing) for r in df.collect() for c in r.cells}


def test_each_field_has_one_place_in_a_layout():
    for form in ("new", "old"):
        ids = [i for m in M.MATRICES if m.form in (None, form) and not m.choice for _, row in m.rows for i in row if i]
        assert len(ids) == len(set(ids))
    by_name = {(m.name, m.form): m for m in M.MATRICES}
    new, old = by_name["b1-undergraduate", "new"], by_name["b1-undergraduate", "old"]
    assert new.rows[0][1] == ("B.101", "B.126", "B.151", None) and new.rows[12] == ("Total undergraduates", ("B.113", "B.138", "B.163", "B.176"))
    assert old.rows[1][1] == ("B.105", "B.106", "B.107", "B.108", None) and old.rows[12][1] == ("B.149", "B.150", "B.151", "B.152", "B.193")
    assert by_name["b1-overall", "new"].rows[2][1] == ("B.125", "B.150", "B.175", "B.178")
    assert by_name["j-degrees-conferred", None].rows[39] == ("Total", ("J.140", "J.180", "J.220"))
    assert by_name["h2-aid-awarded", None].rows[12][1] == ("H.213", "H.226", "H.239")
    assert all(len(ids) == len(m.columns) for m in M.MATRICES for _, ids in m.rows)


def test_layouts_gaps_percent_and_choices(spark):
    rows = [
        (1, "C.101", "10", None, None), (1, "C.116", " ", None, None), (1, "C.117", "Not provided", None, None), (1, "B.432", "91", None, None), (1, "J.101", "5%", None, None), (1, "J.141", "7", None, None),
        (1, "C.702", "very important", None, None), (1, "C.703", "Other", None, None), (1, "Z.9", "x", None, None), (1, "G.119", "5", None, None),
        (2, "C.101", "11", None, "2024-25"), (2, "C.117", "99", "Students who applied", "2024-25"), (2, "D.201", "3", None, "2024-25"),
        (3, "B.101", "1", None, None), (3, "B.103", "2", "... Another Gender ...", None), (4, "B.101", "1", None, None), (4, "B.101", "1", None, None), (5, "B.301", "—", None, None),
    ]
    got = _cells(M.matrices(_values(spark, rows), "doc"))
    assert got[1, "c1-admissions", "Applied", "Males"] == ("10", False) and got[1, "c1-admissions", "Applied", "Total"] == ("Not reported", True)
    assert got[1, "c1-admissions", "Admitted", "Total"] == ("Not provided", True) and got[1, "c1-admissions", "Enrolled full-time", "Total"] == ("Not reported", True)
    assert got[1, "b4-current-graduation-rates", "Six-year graduation rate", "Total"] == ("91%", False)
    assert got[1, "j-degrees-conferred", "Agriculture", "Certificate/diploma"] == ("5%", False) and got[1, "j-degrees-conferred", "Agriculture", "Associate"] == ("7%", False)
    assert [got[1, "c7-factors", "Class rank", c] for c in ("Very important", "Important")] == [("Yes", False), ("—", True)]
    assert got[1, "c7-factors", "Academic GPA", "Considered"] == ("—", True) and got[1, "c7-factors", "Interview", "Considered"] == ("Not reported", True)
    assert got[2, "c1-admissions", "Applied", "Men"] == ("11", False) and got[2, "c1-admissions", "Applied", "Total"] == ("99", False)
    assert got[2, "d2-transfer-admissions", "Applied", "Men"] == ("3", False) and (2, "d2-transfer-admissions", "Applied", "Males") not in got
    assert got[3, "b1-undergraduate", "Full-time first-time first-year degree-seeking", "Another gender"] == ("2", False)
    assert got[4, "b1-undergraduate", "Full-time first-time first-year degree-seeking", "Males"] == ("1", False)
    assert not [k for k in got if k[0] == 5] and not [k for k in got if k[1] == "b1-graduate"]


def test_round_trip_by_cells_and_by_markdown(spark):
    rows = []
    for doc, form in ((1, "new"), (2, "old")):
        for k, field in enumerate(sorted({i for m in M.MATRICES if m.form in (None, form) for _, ids in m.rows for i in ids if i})):
            if (k + doc) % 4:
                value = M.MATRICES[[m.name for m in M.MATRICES].index("c7-factors")].columns[k % 4] if field.startswith("C.7") else f"{k}%" if field.startswith("J.") or field in {f"B.{n}" for n in (429, 430, 431, 432, 529, 530, 531, 532, 2203)} else str(k)
                rows.append((doc, field, value, "another gender" if field in ("B.103", "C.103") and form == "old" else None, "2024-25" if form == "old" else None))
    rows += [(2, f, "1", "another gender", "2024-25") for f in ("B.103", "C.103") if not any(r[:2] == (2, f) for r in rows)]
    values = _values(spark, rows)
    made = M.matrices(values, "doc")
    want = {r[:3] for r in rows}
    assert {tuple(r) for r in M.field_values(made, "doc").collect()} == want
    tables = forms.pipe_tables(M.markdown(made, "doc"), "doc", "text")
    assert {tuple(r) for r in M.fields_of_tables(tables, "doc").collect()} == want
    asked = spark.createDataFrame([("First-time, first-year", "Degree-seeking", "Asian, non-Hispanic", "B.206"), ("All", "All", "Asian, non-Hispanic", "B.226")], "cohort string, category string, question string, field string")
    by_resolver = {(r.doc, r.field, r.value) for r in forms.enrollment_by_race(tables, "doc", asked).collect()}
    assert by_resolver == {w for w in want if w[1] in ("B.206", "B.226")}


def test_no_values(spark):
    made = M.matrices(_values(spark, []), "doc")
    assert made.count() == 0 and M.markdown(made, "doc").count() == 0
