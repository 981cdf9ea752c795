"""Answers found beside their labels on sheets whose rows have moved, where a map of cells would miss them.

A sheet is a grid of cells with numbers for row and column. Rows are put together from at most
``most_columns`` cells each; a region is the rows between a header and what ends it; an answer is the
cell at an offset from its label, or one of the numbers right of it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that sheets have instead of the template's, fields of the score table by label, sexes and residences of the applications table, and the marks of both tables.
SHEET_NAMES = {
    "CDS-A": ("A", "Information"), "CDS-B": ("B", "Enrollment"), "CDS-C": ("C", "Admission", "Admissions"), "CDS-D": ("D", "Transfer"), "CDS-E": ("E", "Academic"), "CDS-F": ("F", "Student Life"),
    "CDS-G": ("G", "Expenses"), "CDS-H": ("H", "Financial Aid"), "CDS-I": ("I", "Faculty"), "CDS-J": ("J", "Degrees"),
}
SCORE_FIELDS = {
    "submitting sat scores": ("C.901", "C.903"), "submitting act scores": ("C.902", "C.904"), "sat composite": ("C.905", "C.906", "C.907"), "sat evidence based reading and writing": ("C.908", "C.909", "C.910"),
    "sat math": ("C.911", "C.912", "C.913"), "act composite": ("C.914", "C.915", "C.916"),
}
SCORE_HEADER = ("percent and number", "first time first year", "students", "sat act")
SCORE_END = ("c10", "class rank")
RESIDENCES = ("All", "In-State", "Out-of-State", "Nonresidents", "Unknown")
SEX_NAMES = {
    "Males": ("men", "male", "males"), "Females": ("women", "female", "females"), "Another Gender": ("another gender",), "Unknown": ("unknown", "students of unknown sex", "unknown gender"), "All": ("all",),
}
NUMBER = "^\\s*-?\\d[\\d,]*(?:\\.\\d+)?\\s*$"


def plain_label(text: Column) -> Column:
    """Lower case, & as and, letters and digits alone."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.trim(text)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def grid(cells: DataFrame, most_columns: int | None = None) -> DataFrame:
    """``(file, sheet, row, col, value)`` of cells named by letters and digits; columns from 1, those after ``most_columns`` left out."""
    letters = F.split(F.regexp_extract("cell", "^([A-Z]+)\\d+$", 1), "")
    col = F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)
    out = cells.select("file", "sheet", F.regexp_extract("cell", "^[A-Z]+(\\d+)$", 1).try_cast("int").alias("row"), col.alias("col"), "value").where("row IS NOT NULL AND col > 0")
    return out.where(F.col("col") <= most_columns) if most_columns else out


def sheet_of(cells: DataFrame, official: str, names: Mapping[str, tuple[str, ...]] = SHEET_NAMES) -> DataFrame:
    """``(file, sheet)``: the sheet of each file that stands for an official one, by its own name first and then by the first of its other names."""
    known = [official, *names.get(official, ())]
    rank = F.array_position(F.array(*map(F.lit, known)), F.col("sheet"))
    return cells.where(F.col("sheet").isin(*known)).groupBy("file").agg(F.min_by("sheet", rank).alias("sheet"))


def grid_rows(cells: DataFrame, official: str, most_columns: int = 12) -> DataFrame:
    """``(file, row, cells)`` of one official sheet: each row's cells by column, as (col, value, label)."""
    part = grid(cells, most_columns).join(sheet_of(cells, official), ["file", "sheet"])
    cell = F.struct("col", "value", plain_label(F.col("value")).alias("label"))
    return part.groupBy("file", "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def _text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: c["label"]), " ")


def region(rows: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """The rows of each file after the first that opens and before the first after it that closes; rows that open are left out."""
    whole = Window.partitionBy("file")
    marked = rows.withColumns({"_opens": opens, "_closes": closes})
    marked = marked.withColumn("_first", F.min(F.when(F.col("_opens"), F.col("row"))).over(whole))
    marked = marked.withColumn("_end", F.min(F.when(F.col("_closes") & ~F.col("_opens") & (F.col("row") > F.col("_first")), F.col("row"))).over(whole))
    inside = (F.col("row") > F.col("_first")) & (F.col("_end").isNull() | (F.col("row") < F.col("_end"))) & ~F.col("_opens")
    return marked.where(inside).select(*rows.columns)


def _at(cells: Column, col: Column) -> Column:
    """The value in a column of a row."""
    return F.try_element_at(F.filter(cells, lambda c: c["col"] == col), F.lit(1))["value"]


def beside_labels(rows: DataFrame, fields: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """``(file, field, value)``: rows that begin with a known label give its fields the cells right of it, one each; of several rows the last counts.

    A blank cell or a truth value gives a null: the field is known not to be answered there.
    """
    first = F.try_element_at(F.filter("cells", lambda c: c["label"] != ""), F.lit(1))
    named = rows.withColumn("_label", first).where(F.col("_label.label").isin(*fields))
    of = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    each = named.select("file", "row", "cells", F.col("_label.col").alias("_col"), F.posexplode(F.element_at(of, F.col("_label.label"))).alias("offset", "field"))
    value = F.trim(_at(F.col("cells"), F.col("_col") + F.col("offset") + 1))
    held = each.select("file", "field", "row", F.when((value != "") & ~value.isin("TRUE", "FALSE"), value).alias("value"))
    return held.groupBy("file", "field").agg(F.max(F.struct("row", "value")).alias("_last")).select("file", "field", "_last.value")


def score_answers(cells: DataFrame) -> DataFrame:
    """``(file, field, value)`` of the test-score table by its visible labels, nulls where a labelled cell is blank."""
    rows = grid_rows(cells, "CDS-C")
    text = _text(F.col("cells"))
    opens, closes = F.lit(True), F.lit(False)
    for phrase in SCORE_HEADER:
        opens = opens & text.contains(phrase)
    for phrase in SCORE_END:
        closes = closes | text.contains(phrase)
    return beside_labels(region(rows, opens, closes), SCORE_FIELDS)


def application_answers(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """``(file, field, value)`` of the applications table by its visible labels.

    A row speaks of first-time, first-year students who applied, were admitted or enrolled. If it
    names a sex, the first number right of the label is that sex's count; a row without a
    sex that says ``who`` gives its numbers to the residences in order. ``fields`` has (field, question,
    gender, residency, unit_load); of fields that fit alike the first by ``field`` counts, and of rows the last.
    """
    rows = grid_rows(cells, "CDS-C")
    wanted = F.filter("cells", lambda c: c["label"].contains("first time first year") & c["label"].rlike("applied|admitted|enrolled"))
    named = rows.withColumn("_label", F.try_element_at(wanted, F.lit(1))).where("_label IS NOT NULL")
    label = F.col("_label.label")
    action = F.when(label.contains("admitted"), "admitted").when(label.contains("applied"), "applied").otherwise("enrolled")
    padded = F.concat(F.lit(" "), label, F.lit(" "))
    sex = F.when(padded.contains(" men "), "Males").when(padded.contains(" women "), "Females").when(label.contains("another gender"), "Another Gender").when(label.rlike("unknown gender|unknown sex"), "Unknown")
    load = F.when((action == "enrolled") & label.contains("full time"), "FT").when((action == "enrolled") & label.contains("part time"), "PT").otherwise("All")
    numbers = F.transform(F.filter("cells", lambda c: (c["col"] > F.col("_label.col")) & c["value"].rlike(NUMBER)), lambda c: F.trim(c["value"]))
    made = named.select("file", "row", action.alias("action"), sex.alias("sex"), load.alias("load"), padded.contains(" who ").alias("_who"), numbers.alias("_numbers"))
    one = made.where("sex IS NOT NULL").select("file", "row", "action", "sex", F.lit("All").alias("residence"), "load", F.try_element_at("_numbers", F.lit(1)).alias("value"))
    many = made.where("sex IS NULL AND _who").select("file", "row", "action", F.lit("All").alias("sex"), F.lit("All").alias("load"), F.inline(F.arrays_zip(F.array(*map(F.lit, RESIDENCES)).alias("residence"), F.slice("_numbers", 1, len(RESIDENCES)).alias("value"))))
    return _named_fields(one.unionByName(many).where("value IS NOT NULL"), fields)


def _named_fields(answers: DataFrame, fields: DataFrame) -> DataFrame:
    """The fields that answers by (action, sex, residence, load) belong to; all loads' enrolled fields name none in their question."""
    question, gender = plain_label(F.col("question")), plain_label(F.col("gender"))
    sex = F.lit(None).cast("string")
    for name, words in SEX_NAMES.items():
        sex = F.when(gender.isin(*words), name).otherwise(sex)
    spoken = F.array_compact(F.array(
        F.when(question.contains("full time") | (F.col("unit_load") == "FT"), "FT"), F.when(question.contains("part time") | (F.col("unit_load") == "PT"), "PT"), F.when(~question.rlike("full time|part time"), "All"),
    ))
    known = fields.where(F.col("field").startswith("C.1")).select("field", question.alias("_q"), sex.alias("sex"), F.coalesce(F.nullif("residency", F.lit("")), F.lit("All")).alias("residence"), spoken.alias("_loads"))
    known = known.select("field", "sex", "residence", "_loads", F.explode(F.filter(F.array(*map(F.lit, ("admitted", "applied", "enrolled"))), lambda a: F.col("_q").contains(a))).alias("action"))
    known = known.withColumn("load", F.explode(F.when(F.col("action") == "enrolled", F.col("_loads")).otherwise(F.array(F.lit("All")))))
    first = known.where("sex IS NOT NULL").groupBy("action", "sex", "residence", "load").agg(F.min("field").alias("field"))
    found = answers.join(first, ["action", "sex", "residence", "load"])
    return found.groupBy("file", "field").agg(F.max_by("value", "row").alias("value"))


def embedded_cell_map(cells: DataFrame, most_rows: int = 10, most_columns: int = 40) -> DataFrame:
    """``(file, field, sheet, cell)`` from sheets named CDS-... that have columns ``question number`` and ``answer`` in one of their first rows.

    Question numbers are taken as they stand, without white space around them.
    """
    part = grid(cells.where(F.col("sheet").startswith("CDS-")))
    label = F.trim(F.regexp_replace(F.lower("value"), "\\s+", " "))
    heads = part.where((F.col("row") <= most_rows) & (F.col("col") <= most_columns)).select("file", "sheet", "row", "col", label.alias("label"))
    number = F.coalesce(F.max(F.when(F.col("label") == "question number", F.col("col"))), F.max(F.when(F.col("label") == "question numer", F.col("col"))))
    found = heads.groupBy("file", "sheet", "row").agg(number.alias("_number"), F.max(F.when(F.col("label") == "answer", F.col("col"))).alias("_answer")).where("_number IS NOT NULL AND _answer IS NOT NULL")
    first = found.groupBy("file", "sheet").agg(F.min(F.struct("row", "_number", "_answer")).alias("h")).select("file", "sheet", "h.*").withColumnRenamed("row", "_head")
    asked = part.join(first, ["file", "sheet"]).where("row > _head AND col = _number AND trim(value) <> ''")
    return asked.select("file", F.trim("value").alias("field"), "sheet", F.concat(column_letters(F.col("_answer")), F.col("row").cast("string")).alias("cell"))


def column_letters(col: Column) -> Column:
    """1 as A, 26 as Z, 27 as AA, up to three letters."""
    def letter(n: Column) -> Column:
        return F.char(n + 65)

    one, two, three = (col - 1) % 26, F.floor((col - 27) / 26) % 26, F.floor((col - 703) / 676) % 26
    return F.concat(F.when(col > 702, letter(three)).otherwise(""), F.when(col > 26, letter(two)).otherwise(""), letter(one))


def with_recovered(found: DataFrame, recovered: DataFrame) -> DataFrame:
    """``(file, field, value)``: ``found`` with recovered values in place of its own, and without the fields that were recovered as null."""
    new = recovered.select("file", "field", F.col("value").alias("_new"), F.lit(True).alias("_seen"))
    both = found.select("file", "field", "value").join(new, ["file", "field"], "full")
    return both.select("file", "field", F.when(F.col("_seen"), F.col("_new")).otherwise(F.col("value")).alias("value")).where("value IS NOT NULL")
