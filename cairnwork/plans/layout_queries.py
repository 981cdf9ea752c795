"""Queries of rebuilt tables and of answers recovered from shifted sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.operators import forms
from cairnwork.operators import matrices as M
from cairnwork.plans.registry import query
from cairnwork.sources import recovery
from cairnwork.storage import load


def _values(s, d):
    """Loan fields H.501 to H.515 and admission fields of both layouts, of each customer as its key and the field's number say."""
    base = load(s, d, "customer").select("c_custkey", "c_nationkey", F.explode(F.expr("sequence(1, 15)")).alias("k"))
    loans = base.where("(c_custkey + k) % 4 > 0").select("c_custkey", F.expr("concat('H.', cast(500 + k AS string))").alias("field"), F.expr("CASE WHEN (c_custkey + k) % 4 = 1 THEN 'Not provided' ELSE cast(c_nationkey * 100 + k AS string) END").alias("value"))
    admitted = load(s, d, "customer").select("c_custkey", F.explode(F.expr("array('C.101', 'C.105', 'C.117')")).alias("field"), F.expr("cast(c_nationkey AS string)").alias("value"))
    asked = F.when((F.col("field") == "C.117") & (F.col("c_custkey") % 3 == 0), "Total students who applied")
    return loans.unionByName(admitted).select("*", asked.alias("question"))


LOAN_LABELS = "['Any loan program', 'Federal loan programs', 'Institutional loan programs', 'State loan programs', 'Private student loans']"


@query("R_07_matrices", f"""
    WITH cells AS (SELECT c_custkey, r, c, c_nationkey * 100 + (c * 5 + r + 1) AS v, (c_custkey + c * 5 + r + 1) % 4 AS m FROM customer, range(5) a(r), range(3) b(c)),
    loans AS (SELECT c_custkey, 'h5-student-loans' AS name, r, {LOAN_LABELS}[r + 1] AS label, string_agg(CASE m WHEN 0 THEN 'Not reported' WHEN 1 THEN 'Not provided' ELSE CAST(v AS VARCHAR) END, '~' ORDER BY c) AS cells FROM cells GROUP BY ALL),
    admitted AS (SELECT c_custkey, 'c1-admissions' AS name, k AS r, CASE WHEN c_custkey % 3 = 0 THEN ['Applied', 'Admitted', 'Enrolled full-time', 'Enrolled part-time', 'Enrolled total'] ELSE ['Applied', 'Admitted', 'Enrolled', 'Enrolled full-time', 'Enrolled part-time'] END[k + 1] AS label,
                 array_to_string(list_transform(CASE WHEN c_custkey % 3 = 0 THEN [[1, 0, 0, 0, 1], [1, 0, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]] ELSE [[1, 0, 0, 0], [0, 1, 0, 1], [0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]] END[k + 1], lambda x: CASE WHEN x = 1 THEN CAST(c_nationkey AS VARCHAR) ELSE 'Not reported' END), '~') AS cells
                 FROM customer, range(5) t(k))
    SELECT c_custkey, name, CAST(r AS INTEGER) AS "row", label, cells FROM (SELECT * FROM loans UNION ALL SELECT * FROM admitted)""")
def _(s, d):
    made = M.matrices(_values(s, d), "c_custkey")
    return made.select("c_custkey", "name", "row", "label", F.array_join(F.transform("cells", lambda c: c["display"]), "~").alias("cells"))


@query("R_07_fields_of_tables", """
    SELECT c_custkey, 'H.' || (500 + k) AS field, CAST(c_nationkey * 100 + k AS VARCHAR) AS value FROM customer, range(1, 16) t(k) WHERE (c_custkey + k) % 4 > 1
    UNION ALL SELECT c_custkey, field, CAST(c_nationkey AS VARCHAR) FROM customer, (VALUES ('C.101'), ('C.105'), ('C.117')) f(field)""")
def _(s, d):
    text = M.markdown(M.matrices(_values(s, d), "c_custkey"), "c_custkey")
    return M.fields_of_tables(forms.pipe_tables(text, "c_custkey", "text"), "c_custkey")


def _sheets(s, d):
    """A sheet of each supplier, its rows moved down and its columns right as the key says: an opening, two score rows, a closing row, and a score row after it."""
    rows = [("Percent and number of first-time, first-year students who submitted SAT/ACT scores", "", "", ""), ("Submitting SAT scores", "p", "n", ""), ("SAT Math", "a", " ", "b"), ("C10 class rank", "", "", ""), ("ACT composite", "1", "2", "3"),
            ("Total first-time, first-year men who applied", "n/a", "n", ""), ("First-time first-year students who were admitted", "n", "x", "a")]
    base = load(s, d, "supplier").select("s_suppkey", "s_nationkey", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(v).alias("v")) for r, row in enumerate(rows) for c, v in enumerate(row) if v])).alias("x"))
    value = F.expr("CASE x.v WHEN 'p' THEN concat(s_nationkey, '%') WHEN 'n' THEN cast(s_suppkey AS string) WHEN 'a' THEN cast(s_nationkey * 10 AS string) WHEN 'b' THEN cast(s_suppkey % 7 AS string) ELSE x.v END")
    cell = F.concat(recovery.column_letters(F.expr("x.c + 1 + cast(s_suppkey % 3 AS int)")), F.expr("cast(x.r + 1 + s_suppkey % 50 AS string)"))
    return base.select(F.col("s_suppkey").cast("string").alias("file"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'CDS-C' ELSE 'Admissions' END").alias("sheet"), cell.alias("cell"), value.alias("value"))


@query("T_09_scores", """
    SELECT CAST(s_suppkey AS VARCHAR) AS file, field, CASE field WHEN 'C.901' THEN s_nationkey || '%' WHEN 'C.903' THEN CAST(s_suppkey AS VARCHAR) WHEN 'C.911' THEN CAST(s_nationkey * 10 AS VARCHAR) WHEN 'C.913' THEN CAST(s_suppkey % 7 AS VARCHAR) END AS value
    FROM supplier, (VALUES ('C.901'), ('C.903'), ('C.911'), ('C.912'), ('C.913')) f(field)""")
def _(s, d):
    return recovery.score_answers(_sheets(s, d))


@query("T_09_applications", """
    SELECT CAST(s_suppkey AS VARCHAR) AS file, field, CASE field WHEN 'C.121' THEN CAST(s_nationkey * 10 AS VARCHAR) ELSE CAST(s_suppkey AS VARCHAR) END AS value FROM supplier, (VALUES ('C.101'), ('C.120'), ('C.121')) f(field)""")
def _(s, d):
    fields = s.createDataFrame([("C.101", "men who applied", "Men", None, None), ("C.120", "students admitted", "All", "All", None), ("C.121", "students admitted", "All", "In-State", None)], "field string, question string, gender string, residency string, unit_load string")
    return recovery.application_answers(_sheets(s, d), fields)


@query("T_09_recovered", """
    WITH f AS (SELECT s_suppkey, s_nationkey, field FROM supplier, (VALUES ('C.901'), ('C.903'), ('C.911'), ('C.913')) f(field))
    SELECT CAST(s_suppkey AS VARCHAR) AS file, field, CASE field WHEN 'C.901' THEN s_nationkey || '%' WHEN 'C.903' THEN CAST(s_suppkey AS VARCHAR) WHEN 'C.911' THEN CAST(s_nationkey * 10 AS VARCHAR) ELSE CAST(s_suppkey % 7 AS VARCHAR) END AS value FROM f
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'A.101', s_name FROM supplier""")
def _(s, d):
    mapped = load(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), F.explode(F.expr("array('A.101', 'C.912', 'C.911')")).alias("field"), F.col("s_name").alias("value"))
    return recovery.with_recovered(mapped, recovery.score_answers(_sheets(s, d)))
