"""Queries of the subsection spans and prose resolvers over texts made of table columns, each in several layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.operators import cleaning, forms, prose, slices
from cairnwork.plans.registry import query
from cairnwork.storage import load

#: Sentences of a document as lines, opened by codes in four styles that follow from the document's own numbers; SQL of both engines.
LINED = """concat(CASE doc_id % 5 WHEN 0 THEN '## C13. ' WHEN 1 THEN concat('- c13 Fee', chr(10), '### C13 ') WHEN 2 THEN 'The application FEE is ' WHEN 3 THEN 'C12: ' ELSE 'see C13 ' END,
 replace(coalesce(text, ''), '. ', chr(10)), chr(10), CASE WHEN doc_id % 3 = 0 THEN '**C14** x' ELSE '* D2 : y' END, chr(10), 'D1. z', chr(10), 'end')"""


@query("T_05_slices", f"""
    WITH d AS (SELECT doc_id, string_split({LINED}, chr(10)) AS w FROM documents),
    lines AS (SELECT doc_id, unnest(w) AS line, generate_subscripts(w, 1) - 1 AS place, len(w) AS n FROM d),
    codes(code, rank) AS (SELECT s || k, row_number() OVER (ORDER BY s, k) FROM (VALUES ('B', 1, 5), ('B', 22, 22), ('C', 1, 22), ('D', 1, 16), ('G', 1, 6), ('H', 1, 10), ('I', 1, 3), ('J', 1, 3)) r(s, a, b), range(a, b + 1) t(k)),
    heads AS (SELECT doc_id, place, n, code, rank, CASE WHEN starts_with(ltrim(line), '## ') THEN 0 WHEN starts_with(ltrim(line), '### ') THEN 1 WHEN starts_with(ltrim(line), '**') THEN 3 ELSE 2 END AS style
              FROM lines JOIN codes ON upper(regexp_extract(line, '^\\s*(?:### \\s*)?(?:## \\s*)?(?:# \\s*)?(?:- \\s*)?(?:\\* \\s*)?(?:\\*\\*)?\\s*([A-Za-z]\\d+)(?:\\s*[.:]|\\s|$)', 1)) = code),
    wanted AS (SELECT doc_id, len(w) AS n, code, rank FROM d, codes WHERE code IN ('C13', 'C14', 'D2', 'J1')),
    said AS (SELECT doc_id, code, min(place) AS place FROM lines, (VALUES ('C13', 'application fee'), ('C14', 'application closing date'), ('D2', 'number of students who applied, were admitted, and enrolled as degree-seeking transfer')) p(code, phrase) WHERE contains(lower(line), phrase) GROUP BY ALL),
    starts AS (SELECT doc_id, code, style AS strategy, place FROM heads UNION ALL SELECT doc_id, code, 4, place FROM said
               UNION ALL SELECT w.doc_id, w.code, 5, h.place FROM wanted w JOIN heads h ON h.doc_id = w.doc_id AND h.rank < w.rank QUALIFY row_number() OVER (PARTITION BY w.doc_id, w.code ORDER BY h.rank DESC, h.place) = 1),
    best AS (SELECT w.doc_id, w.code, w.rank, w.n, strategy, place FROM wanted w LEFT JOIN starts s ON s.doc_id = w.doc_id AND s.code = w.code QUALIFY row_number() OVER (PARTITION BY w.doc_id, w.code ORDER BY strategy, place) = 1),
    spans AS (SELECT *, place + CASE WHEN strategy = 5 THEN 400 ELSE 200 END AS most FROM best),
    laters AS (SELECT b.doc_id, b.code, min(h.place) AS later FROM spans b JOIN heads h ON h.doc_id = b.doc_id AND h.rank > b.rank AND h.place > b.place AND h.place < b.most GROUP BY ALL),
    ended AS (SELECT b.doc_id, b.code, b.strategy, b.place, least(coalesce(later, most), n) AS stop FROM spans b LEFT JOIN laters l ON l.doc_id = b.doc_id AND l.code = b.code),
    judged AS (SELECT *, strategy IS NOT NULL AND (strategy < 5 OR stop - place < 250) AS found FROM ended)
    SELECT j.doc_id, code, ['h2_code', 'h3_code', 'bullet_code', 'bold_code', 'anchor_phrase', 'bounded_window', 'unresolved'][CASE WHEN found THEN strategy ELSE 6 END + 1] AS strategy,
           CAST(CASE WHEN found THEN place END AS DOUBLE) AS start, CAST(CASE WHEN found THEN stop END AS DOUBLE) AS stop, md5(CASE WHEN found THEN array_to_string(w[place + 1:stop], chr(10)) ELSE '' END) AS text_md5
    FROM judged j JOIN d USING (doc_id)""")
def _(s, d):
    docs = load(s, d, "documents").select("doc_id", F.expr(LINED).alias("text"))
    return slices.slices(docs, "doc_id", "text", ["C13", "C14", "D2", "J1"]).select("doc_id", "code", "strategy", F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"), F.md5("text").alias("text_md5"))


def _texts(s, d, text):
    return load(s, d, "customer").select("c_custkey", F.expr(text).alias("text"))


def _rows(s, d, text):
    return forms.pipe_tables(_texts(s, d, text), "c_custkey", "text")


DEGREES = """CASE c_custkey % 3 WHEN 0 THEN concat('B3 Number of degrees awarded
Bachelor''s degrees     1,', CAST(100 + c_nationkey AS VARCHAR(9)), '
Master''s degrees and Associate degrees 9
Doctoral degrees – other ', CAST(c_custkey AS VARCHAR(9)), '
B4 Associate degrees 5') WHEN 1 THEN concat('## Enrollment and persistence
| Degrees | Number |
|---|---|
| Associate degrees | ', CAST(c_custkey AS VARCHAR(9)), ' |
| Master''s degrees | none |
') ELSE 'B3 Number of degrees: 12' END"""


@query("T_04_degrees", """
    SELECT c_custkey, 'B.303' AS field, '1' || (100 + c_nationkey) AS value FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'B.309', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'B.302', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 1""")
def _(s, d):
    return prose.degrees_awarded(_texts(s, d, DEGREES), _rows(s, d, DEGREES), "c_custkey", "text")


RATES = """concat('For Two-Year Institutions
', CASE c_custkey % 3 WHEN 0 THEN concat('B12 Initial cohort 2020: ', CAST(c_custkey AS VARCHAR(9)), ' 2,500') WHEN 1 THEN concat('B12 ', CAST(c_nationkey AS VARCHAR(9)), ' ', CAST(c_custkey AS VARCHAR(9))) ELSE 'B12 none' END, '
B21 of those: ', CAST(c_nationkey AS VARCHAR(9)), '
- B22 For the cohort of 2023', CASE WHEN c_custkey % 2 = 0 THEN concat(' the rate is
', CAST(c_nationkey AS VARCHAR(9)), '.5 %') ELSE '
## C' END, ' 99%')"""


@query("T_04_two_year_rates", """
    SELECT c_custkey, 'B.1201' AS field, CAST(CASE c_custkey % 3 WHEN 0 THEN c_custkey ELSE c_nationkey END AS VARCHAR) AS value FROM customer WHERE c_custkey % 3 < 2
    UNION ALL SELECT c_custkey, 'B.1202', CASE c_custkey % 3 WHEN 0 THEN '2500' ELSE CAST(c_custkey AS VARCHAR) END FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, 'B.2101', CAST(c_nationkey AS VARCHAR) FROM customer""")
def _(s, d):
    return prose.two_year_rates(_texts(s, d, RATES), "c_custkey", "text")


@query("T_04_retention", "SELECT c_custkey, 'B.2203' AS field, c_nationkey || '.5' AS value FROM customer WHERE c_custkey % 2 = 0")
def _(s, d):
    return prose.retention_rate(_texts(s, d, RATES), "c_custkey", "text")


UNITS = """concat('## C5
| Subject |', CASE c_custkey % 3 WHEN 0 THEN ' Required | Recommended |' WHEN 1 THEN ' Units | Other units |' ELSE ' Units recommended | Units |' END, '
|---|---|---|
| English | ', CAST(c_custkey AS VARCHAR(9)), ' | 2 |
| Mathematics | | ', CAST(c_nationkey AS VARCHAR(9)), ' |
| Computer science | 1.5 | n/a |
')"""


@query("T_04_school_units", """
    WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 2 THEN 'C.52' ELSE 'C.51' END AS first FROM customer)
    SELECT c_custkey, first || '1' AS field, CAST(c_custkey AS VARCHAR) AS value FROM c UNION ALL SELECT c_custkey, first || '3', '1.5' FROM c UNION ALL SELECT c_custkey, 'C.521', '2' FROM c WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'C.522', CAST(c_nationkey AS VARCHAR) FROM c WHERE c_custkey % 3 = 0""")
def _(s, d):
    fields = s.createDataFrame([(c, q, f"C.5{i}{j}") for i, c in enumerate(("Required", "Recommended"), 1) for j, q in enumerate(("English", "Mathematics", "Computer Science"), 1)], "category string, question string, field string")
    return prose.school_units(_rows(s, d, UNITS), "c_custkey", fields)


LIFE = """concat('## F1
| | First-time, first-year students | ', CASE WHEN c_custkey % 2 = 0 THEN 'Undergraduates' ELSE 'All undergraduate students' END, ' |
|---|---|---|
| Percent who are from out of state | ', CAST(c_nationkey AS VARCHAR(9)), '% | ', CAST(c_custkey AS VARCHAR(9)), ' |
| ', CASE WHEN c_custkey % 3 = 0 THEN 'Percent who live off campus Average age of all students' ELSE 'Average age of all students' END, ' | 18 | 20.5 |
## I1
| | | Full-time | Part-time | Total |
|---|---|---|---|---|
| A | all | ', CAST(c_custkey AS VARCHAR(9)), ' | | 5 |
| B | x | 1 | 2 | 3 |
| C | x | | | |
| D | x | | | |
| ', CASE WHEN c_custkey % 3 = 1 THEN 'E' ELSE 'Z' END, ' | x | | 7 | |
')"""


@query("T_04_participation", """
    SELECT c_custkey, 'F.101' AS field, CAST(c_nationkey AS VARCHAR) AS value FROM customer UNION ALL SELECT c_custkey, 'F.109', CAST(c_custkey AS VARCHAR) FROM customer
    UNION ALL SELECT c_custkey, 'F.108', '18' FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'F.116', '20.5' FROM customer WHERE c_custkey % 3 > 0""")
def _(s, d):
    return prose.participation(_rows(s, d, LIFE), "c_custkey")


@query("T_04_faculty_counts", """
    WITH c AS (SELECT * FROM customer WHERE c_custkey % 3 = 1) SELECT c_custkey, 'I.101' AS field, CAST(c_custkey AS VARCHAR) AS value FROM c
    UNION ALL SELECT c_custkey, f, v FROM c, (VALUES ('I.121', '5'), ('I.102', '1'), ('I.112', '2'), ('I.122', '3'), ('I.115', '7')) x(f, v)""")
def _(s, d):
    return prose.faculty_counts(_rows(s, d, LIFE), "c_custkey")


RATIO = """concat(CASE c_custkey % 4 WHEN 0 THEN '| Student to faculty ratio | ' WHEN 1 THEN 'Student to
Faculty ratio: ' WHEN 2 THEN 'STUDENT TO FACULTY RATIO of Fall 2024, ' ELSE 'the ratio ' END, CAST(c_nationkey AS VARCHAR(9)), CASE WHEN c_custkey % 4 = 1 THEN ':1' ELSE ' to 1' END, ' | (based on 1,', CAST(200 + c_nationkey AS VARCHAR(9)), ' students
| and ', CAST(c_custkey AS VARCHAR(9)), ' faculty).')"""


@query("T_04_faculty_ratio", """
    SELECT c_custkey, 'I.201' AS field, CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_custkey % 4 < 2 UNION ALL SELECT c_custkey, 'I.202', '1' || (200 + c_nationkey) FROM customer WHERE c_custkey % 4 < 3
    UNION ALL SELECT c_custkey, 'I.203', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 4 < 3""")
def _(s, d):
    return prose.faculty_ratio(_texts(s, d, RATIO), "c_custkey", "text")


GRADES = """concat(CASE c_custkey % 4 WHEN 0 THEN concat('C12 Average high school GPA of all degree-seeking, first-time, first-year students who submitted GPA: 3.', CAST(c_nationkey AS VARCHAR(9))) WHEN 1 THEN concat('3.', CAST(c_nationkey AS VARCHAR(9)), ' Average high school GPA of all degree-seeking
first-time students') WHEN 2 THEN concat('Average high school GPA of all degree-seeking, first-time          3.', CAST(c_nationkey AS VARCHAR(9))) ELSE 'Average high school GPA 3.3' END, '
Percent of total first-time, first-year students who submitted high
school GPA | ', CAST(c_custkey AS VARCHAR(9)), '.5 % |
C13 7%')"""


@query("T_04_grade_average", """
    SELECT c_custkey, 'C.1201' AS field, '3.' || c_nationkey AS value FROM customer WHERE c_custkey % 4 < 3 UNION ALL SELECT c_custkey, 'C.1202', c_custkey || '.5' FROM customer WHERE c_custkey % 4 < 3""")
def _(s, d):
    return prose.grade_average(_texts(s, d, GRADES), "c_custkey", "text")


POLICIES = """concat('C13 Application Fee
', CASE WHEN c_custkey % 2 = 0 THEN concat('                                               Yes       No
Does your institution have an application fee?', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '         ' END, ' x') ELSE concat('| Does your institution have an application fee? | ', CASE WHEN c_custkey % 4 = 1 THEN 'Y es' ELSE 'N/A' END, ' |') END, '
Amount of application fee: $1,', CAST(100 + c_nationkey AS VARCHAR(9)), '
', CASE c_custkey % 3 WHEN 0 THEN '      x    Same fee' ELSE '           Same fee' END, '
C14 Application closing date
Application closing date (fall) ', CASE c_custkey % 3 WHEN 0 THEN concat(CAST(c_nationkey % 12 + 1 AS VARCHAR(9)), '/', CAST(c_custkey % 28 + 1 AS VARCHAR(9))) WHEN 1 THEN concat('January ', CAST(c_custkey % 28 + 1 AS VARCHAR(9)), ', 2025') ELSE concat(CAST(c_custkey % 28 + 1 AS VARCHAR(9)), '-Sept') END, '
Does your institution have an application closing date? No
C15')"""


@query("T_04_application_policies", """
    SELECT c_custkey, 'C.1301' AS field, CASE WHEN c_custkey % 4 IN (0, 1) THEN 'Yes' ELSE 'No' END AS value FROM customer UNION ALL SELECT c_custkey, 'C.1302', '1' || (100 + c_nationkey) FROM customer UNION ALL SELECT c_custkey, 'C.1304', 'X' FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'C.1401', 'No' FROM customer UNION ALL SELECT c_custkey, 'C.1402', CAST(CASE c_custkey % 3 WHEN 0 THEN c_nationkey % 12 + 1 WHEN 1 THEN 1 ELSE 9 END AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'C.1403', CAST(c_custkey % 28 + 1 AS VARCHAR) FROM customer""")
def _(s, d):
    return prose.application_policies(_texts(s, d, POLICIES), "c_custkey", "text")


OPTIONS = """concat('E1 Special study options
', CASE c_custkey % 3 WHEN 0 THEN '   x   Double major' WHEN 1 THEN '- [x] Double major' ELSE '   Double major' END, '
', CASE WHEN c_custkey % 2 = 0 THEN '☒' ELSE '☐' END, ' Study abroad
', CASE WHEN c_custkey % 5 = 0 THEN concat('x Other (specify):

', c_name) ELSE 'Other (specify):' END, '
E3 Areas in which
 ✓ History
F. STUDENT LIFE
F2 Activities offered
', CASE WHEN c_custkey % 7 = 0 THEN '✔' ELSE ' ' END, ' Jazz band
F3
G. ANNUAL EXPENSES')"""


@query("T_04_marked_options", """
    SELECT c_custkey, 'E.105' AS field, 'X' AS value FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, 'E.115', 'X' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'E.119', 'X' FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_custkey, 'E.120', c_name FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'E.305', 'X' FROM customer UNION ALL SELECT c_custkey, 'F.207', 'X' FROM customer WHERE c_custkey % 7 = 0""")
def _(s, d):
    return prose.marked_options(_texts(s, d, OPTIONS), "c_custkey", "text")


WHOLE = """concat('## C
| Id | Prompt | Answer |
|---|---|---|
| C101 | men who applied | ', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR(9)) END, ' |
| women who applied | 1,', CAST(100 + c_nationkey AS VARCHAR(9)), ' | |

C101 men who applied ', CAST(c_nationkey AS VARCHAR(9)), '
C103 others: ', CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE 'not given' END, '
For Two-Year Institutions
B12 cohort: ', CAST(c_nationkey AS VARCHAR(9)), ' 6
- B22 For the cohort the rate is ', CAST(c_nationkey AS VARCHAR(9)), '.5 %
Admission ', CASE WHEN c_custkey % 5 = 0 THEN 'yield' ELSE 'retention' END, ' is 44%.
')"""


@query("T_02_clean_driver", """
    SELECT c_custkey, 'C.101' AS field, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS value, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS source FROM customer
    UNION ALL SELECT c_custkey, 'C.102', '1' || (100 + c_nationkey), 0 FROM customer UNION ALL SELECT c_custkey, 'C.103', 'x', 1 FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'B.1201', CAST(c_nationkey AS VARCHAR), 3 FROM customer UNION ALL SELECT c_custkey, 'B.1202', '6', 3 FROM customer
    UNION ALL SELECT c_custkey, 'B.2203', CASE WHEN c_custkey % 5 = 0 THEN c_nationkey || '.5' ELSE '44' END, CASE WHEN c_custkey % 5 = 0 THEN 4 ELSE 2 END FROM customer""")
def _(s, d):
    fields = s.createDataFrame([("C.101",), ("C.103",)], "field string")
    resolvers = [lambda docs, rows: prose.two_year_rates(docs, "c_custkey", "text"), lambda docs, rows: prose.retention_rate(docs, "c_custkey", "text")]
    return cleaning.clean(_texts(s, d, WHOLE), "c_custkey", "text", fields, [("women who applied", "C.102", 0)], [("admission retention", r"(\d+)%", "B.2203")], resolvers)
