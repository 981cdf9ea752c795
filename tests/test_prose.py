"""Resolvers of prose and column layouts over several ways in which each section is written."""

import pytest

from cairnwork.operators import forms, prose


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(2)


def _claims(df):
    out = {}
    for r in df.collect():
        assert (r.id, r.field) not in out
        out[r.id, r.field] = r.value
    return out


def test_degrees_by_lines_else_by_tables(spark):
    spoken = "B3 Number of degrees awarded\nCertificate/diploma    12\nBachelor's degrees  1,234 \nPost-master's certificates 4\nBachelor's degrees Master's degrees 9\nDoctoral degrees – other 7,\nMaster's degrees n/a\nB4 Associate degrees 5"
    table = "## B. Enrollment and persistence\n| Degrees | Number |\n|---|---|\n| Associate degrees | 31 |\n| Master's degrees | x |\n| Master's degrees | 8 |\n| Master's degrees | 9 |"
    docs = _docs(spark, spoken + "\n" + table, table, table.replace("persistence", "other"), "", None)
    got = _claims(prose.degrees_awarded(docs, forms.pipe_tables(docs, "id", "body"), "id", "body"))
    assert got == {(0, "B.301"): "12", (0, "B.303"): "1234", (0, "B.306"): "4", (1, "B.302"): "31", (1, "B.305"): "9"}


def test_two_year_rates(spark):
    text = "For Two-Year Institutions\n 2020 2021\nB12 initial cohort: 100 2,000\nB13 30 40 total\nB14 of: none\nB15: a 7: b 8\nB15 then: 9 10\nB19 55: no\nB22 retention\nB16: 5"
    assert _claims(prose.two_year_rates(_docs(spark, text, "B12: 5", None), "id", "body")) == {
        (0, "B.1201"): "100", (0, "B.1202"): "2000", (0, "B.1301"): "30", (0, "B.1302"): "40", (0, "B.1501"): "9", (0, "B.1502"): "10", (0, "B.1901"): "55",
    }


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("## B22. Retention Rates\nlong notes\n98.40% of them", "98.40"),
        ("- B22 For the cohort of 2023\n\nnote\n 97 %\n## C", "97"),
        ("B22 alone 5%", None),
        ("## B22\nnothing\n## C1\n60%", None),
        ("B22 retention" + " x" * 1600 + " 50%", None),
    ],
)
def test_retention(spark, text, value):
    assert _claims(prose.retention_rate(_docs(spark, text), "id", "body")) == ({(0, "B.2203"): value} if value else {})


def test_school_units_by_headers(spark):
    fields = spark.createDataFrame(
        [(c, q, f"{c[:3]}.{i}") for c in ("Required", "Recommended") for i, q in enumerate(["English", "Mathematics", "Science", "Computer Science", "Of these, units that must be lab"])],
        "category string, question string, field string",
    )
    rows = "| English | 4 | 3 |\n| Mathematics | | 2.5 |\n| Computer science | 1 | x |\n| Of these, units that must be lab | 2 | 1 |\n| Science | 3 | 3 |\n"
    docs = _docs(spark, "| Subject | Required | Recommended |\n|---|---|---|\n" + rows, "| Subject | Units | More units |\n|---|---|---|\n" + rows, "| Subject | Recommended | Units |\n|---|---|---|\n" + rows, "| Subject | Units |\n|---|---|\n| English | 4 |\n")
    got = _claims(prose.school_units(forms.pipe_tables(docs, "id", "body"), "id", fields))
    first = {"Req.0": "4", "Req.3": "1", "Req.4": "2", "Req.2": "3"}
    assert {f: v for (k, f), v in got.items() if k == 0} == first | {"Rec.0": "3", "Rec.1": "2.5", "Rec.4": "1", "Rec.2": "3"}
    assert {f: v for (k, f), v in got.items() if k == 1} == first
    assert {f: v for (k, f), v in got.items() if k == 2} == {f.replace("Req", "Rec"): v for f, v in first.items()}
    assert not [k for k in got if k[0] == 3]


def test_participation_and_faculty_tables(spark):
    f1 = "| | First-time, first-year students | Undergraduates |\n|---|---|---|\n| Percent who are from out of state | 45% | 40 |\n| Percent of women who join sororities Percent who live off campus | 1 | 2 |\n| Average age of full-time students | 18.2 | |\n"
    i1 = "| | | Full-Time | Part-Time | Total |\n|---|---|---|---|---|\n" + "".join(f"| {c} | words | {k} | {10 * k} | {11 * k} |\n" for k, c in enumerate("ABCDE", 1)) + "| K | words | 1 | 1 | 1 |\n"
    docs = _docs(spark, f1, i1, i1.replace("| E |", "| Z |"))
    rows = forms.pipe_tables(docs, "id", "body")
    assert _claims(prose.participation(rows, "id")) == {(0, "F.101"): "45", (0, "F.109"): "40", (0, "F.107"): "18.2"}
    assert _claims(prose.faculty_counts(rows, "id")) == {(1, f"I.{base + k - 1}"): str(k * times) for k in range(1, 6) for base, times in ((101, 1), (111, 10), (121, 11))}


def test_faculty_ratio_in_rows_lines_and_wrapped_text(spark):
    docs = _docs(
        spark,
        "Fall 2024 Student to Faculty ratio | 12 to 1 | (based on 3,400 students\n| and 283 faculty). |",
        "STUDENT TO FACULTY RATIO\nReport the Fall 2024 ratio " + "word " * 90 + "\nstudent to\nfaculty ratio: 9.5:1 based on 1200 students and 126 faculty",
        "student to faculty ratio is nice; 12 students",
        None,
    )
    assert _claims(prose.faculty_ratio(docs, "id", "body")) == {
        (0, "I.201"): "12", (0, "I.202"): "3400", (0, "I.203"): "283", (1, "I.201"): "9.5", (1, "I.202"): "1200", (1, "I.203"): "126",
    }


@pytest.mark.parametrize(
    ("text", "average", "share"),
    [
        ("C12 Average high school GPA of all degree-seeking, first-time, first-year students who submitted GPA: 3.85\nPercent of total first-time, first-year students who submitted high school GPA: 92.5%\nC13 5%", "3.85", "92.5"),
        ("3.9 Average high school GPA of all degree-seeking\nfirst-time", "3.9", None),
        ("Average high school GPA of all degree-seeking, first-time          4\nPercent of total first-time, first-year students who submitted high\nschool GPA  88%", "4", "88"),
        ("| Average high school GPA of all degree-seeking, first-time,\nfirst-year students who submitted | 3.71 | x\n| Percent of total first-time, first-year students who submitted GPA | 70 % |", "3.71", "70"),
        ("Average high school GPA 3.2", None, None),
    ],
)
def test_grade_average(spark, text, average, share):
    want = {(0, f): v for f, v in (("C.1201", average), ("C.1202", share)) if v}
    assert _claims(prose.grade_average(_docs(spark, text), "id", "body")) == want


def test_application_policies_in_columns_and_words(spark):
    wide = " " * 60
    columns = f"""
C13          Application Fee
{wide}Yes          No
  Does your institution have an application fee?            {" " * 14}x
  Amount of application fee:        $1,050
Can it be waived for applicants with financial need?        x
      x          Same fee
{wide}Yes          No
  Can on-line application fee be waived for applicants      x
C14  Application closing date
{wide}Yes          No
  Does your institution have an application closing date?   x
                                            Date
  Application closing date (fall)           6/1
  Priority Date                             Nov-15
C15 next"""
    words = "C13. Application Fee\n| Does your institution have an application fee? | Y es |\n| Amount of application fee: | 75 |\n| Same fee | X |\n| Can it be waived for applicants with financial need? | N/A |\nC14. Application closing date\nDoes your institution have an application closing date? No\nApplication closing date (fall): January 5, 2025 Priority Date 15-Sept\nC15"
    got = _claims(prose.application_policies(_docs(spark, columns, words, "", None), "id", "body"))
    assert {f: v for (k, f), v in got.items() if k == 0} == {
        "C.1301": "No", "C.1302": "1050", "C.1303": "Yes", "C.1304": "X", "C.1305": "Yes", "C.1401": "Yes", "C.1402": "6", "C.1403": "1", "C.1404": "11", "C.1405": "15",
    }
    assert {f: v for (k, f), v in got.items() if k == 1} == {
        "C.1301": "Yes", "C.1302": "75", "C.1303": "No", "C.1304": "X", "C.1401": "No", "C.1402": "1", "C.1403": "5", "C.1404": "9", "C.1405": "15",
    }
    assert {k for k, _ in got} == {0, 1}


def test_marked_options(spark):
    text = """E1 Special study options
  x  Double major
- [x] Honors program          [ ] Internships
☒ Study abroad
 Distance learning
x Other (specify):

 Winter term
E3 Areas in which students must
 ✓ History
 Foreign languages x
F. STUDENT LIFE
F2 Activities offered
 ✔ Jazz band      Opera
F3 ROTC
F4 Housing:
 - [ ] x Coed dorms
G. ANNUAL EXPENSES"""
    got = _claims(prose.marked_options(_docs(spark, text, "E1 none", None), "id", "body"))
    # a ticked box counts for every option of its line, as does a mark before another option
    assert got == {(0, f): "X" for f in ("E.105", "E.110", "E.112", "E.115", "E.119", "E.305", "F.207", "F.213", "F.401")} | {(0, "E.120"): "Winter term"}
