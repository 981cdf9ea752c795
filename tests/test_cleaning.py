"""The order of claims in a whole form, and each reader on the layouts it reads."""

from cairnwork.operators import cleaning as C
from cairnwork.operators import forms, prose


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(2)


def _fields(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "field string")


def _got(df):
    return sorted((r.id, r.field, r.value) for r in df.collect())


def test_direct_rows(spark):
    text = "| Item | Prompt | Response | Note |\n|---|---|---|---|\n| A101 | name? | X College | n |\n| C9 | rate | | 7 |\n| C.117 | total | 1,200 | |\n| Z1 | no | 1 | |\n| C500 | not known | 5 | |\n\n| Id | v |\n|---|---|\n| B101 | only |\n"
    docs = _docs(spark, text)
    got = _got(C.direct_answers(forms.pipe_tables(docs, "id", "body"), "id", _fields(spark, "A.101", "C.009", "C.117", "B.101")))
    assert got == [(0, "A.101", "X College"), (0, "B.101", "only"), (0, "C.009", "7"), (0, "C.117", "1,200")]


def test_mapped_rows_prefer_full_time_columns(spark):
    text = "| | Part-time men | Full-time men | Women |\n|---|---|---|---|\n| Degree-seeking, first-time | 5 | 6 | 7 |\n| Total all | 1 | x | 9 |\n"
    labels = [("degree seeking", "B.1", "men"), ("degree-seeking first time", "B.2", 2), ("total", "B.3", "men"), ("total", "B.4", "women"), ("total", "B.5", 9)]
    assert _got(C.mapped_answers(forms.pipe_tables(_docs(spark, text), "id", "body"), "id", labels)) == [(0, "B.1", "6"), (0, "B.2", "7"), (0, "B.4", "9")]


def test_lines(spark):
    text = "C117 students who applied 15,411\n c.2 waiting list: Y\nA105 web: https://x.edu/a b\nB1 nothing here\nC1302 fee $50\nC905 sat composite 1,700\nC906 sat 1400\nG5 due: soon 1-May\nsee C117 5\nC118: 7\nD1 x%"
    known = _fields(spark, "C.117", "C.002", "A.105", "B.001", "C.905", "C.906", "G.005", "C.118", "D.001")
    assert _got(C.line_answers(_docs(spark, text, None), "id", "body", known)) == [(0, "C.002", "Y"), (0, "C.117", "15411"), (0, "C.906", "1400"), (0, "G.005", "1-May")]


def test_anchors(spark):
    text = "The Retention RATE of all\nis 97%." + " " * 400 + "closing date 5"
    anchors = [("retention rate", r"(\d+)%", "B.2203"), ("closing date", r"(\d+)", "C.1402"), ("rate", r"(\d{3})", "X"), ("of all", r"is (\d)", "B.2203"), ("none", "(.)", "Y")]
    assert _got(C.anchored_answers(_docs(spark, text), "id", "body", anchors)) == [(0, "B.2203", "9"), (0, "B.2203", "97"), (0, "C.1402", "5")]


def test_the_first_claim_wins_but_for_overriding_fields(spark):
    text = "## C\n| Id | prompt | answer |\n|---|---|---|\n| C101 | men who applied | 10 |\n| men who applied | 11 | |\n\nC101 men 12\nC102 women 13\nFor Two-Year Institutions\nB12 cohort: 5 6\nB22 For the cohort 91%\nretention 92%\nB1201 x 4\n"
    docs = _docs(spark, text, None, "")
    known = _fields(spark, "C.101", "C.102", "B.1201")

    def rates(d, rows):
        return prose.two_year_rates(d, "id", "body")

    def retention(d, rows):
        return prose.retention_rate(d, "id", "body")

    args = (docs, "id", "body", known, [("men who applied", "C.101", 0)], [("retention", r"(\d+)%", "B.2203")], [rates, retention])
    got = {(r.id, r.field): (r.value, r.source) for r in C.clean(*args).collect()}
    assert got == {(0, "C.101"): ("10", 0), (0, "C.102"): ("13", 1), (0, "B.2203"): ("92", 2), (0, "B.1201"): ("5", 3), (0, "B.1202"): ("6", 3)}
    got = {(r.id, r.field): (r.value, r.source) for r in C.clean(*args, overriding=r"^B\.22").collect()}
    assert got[0, "B.2203"] == ("91", 4) and got[0, "C.101"] == ("10", 0)
