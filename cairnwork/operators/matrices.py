"""Published tables rebuilt from field ids: a dictionary places each field in a row and column, and back.

The dictionary is written in this module, so its size is known and it may be broadcast. A document's fields
meet in one group, which the dictionary bounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnwork.functions.parsing import normalised_label
from cairnwork.operators.lines import spread

ABSENT = "Not reported"
#: A cell's key is its table's number, shifted by these bits, plus its number in the table.
CELL_BITS = 16


@dataclass(frozen=True)
class Matrix:
    """A table: its columns, and rows of (label, a field or None for each column).

    ``form`` is the layout of its section that it belongs to (``old`` or ``new``, None for both). Rows in ``percent``
    show a percent sign, all rows if it is None. A ``choice`` table has one field a row, whose value names a column.
    """

    name: str
    title: str
    columns: tuple[str, ...]
    rows: tuple[tuple[str, tuple[str | None, ...]], ...]
    form: str | None = None
    percent: tuple[str, ...] | None = ()
    choice: bool = False


def series(labels: Sequence[str], letter: str, first: int, steps: Sequence[int], stride: int = 1) -> tuple:
    """Rows whose fields are numbered on: row i has ``first + i * stride`` plus each of ``steps``."""
    return tuple((label, tuple(f"{letter}.{first + i * stride + step}" for step in steps)) for i, label in enumerate(labels))


def fields(*rows: str) -> tuple:
    """Rows written as ``label: field field -``, a dash for none."""
    return tuple((label, tuple(None if x == "-" else x for x in ids.split())) for label, ids in (r.rsplit(": ", 1) for r in rows))


# Titles, columns, row labels and field numbers of the published tables.
UNDERGRADUATES = (
    "first-time first-year degree-seeking", "other first-year degree-seeking", "all other degree-seeking", "total degree-seeking", "other credit-course undergraduates", "total undergraduates",
)
GRADUATES = ("first-time degree-seeking", "all other degree-seeking", "other credit-course graduates", "total graduates")
LOADS = tuple(f"{load} {kind}" for load in ("Full-time", "Part-time") for kind in UNDERGRADUATES)
GRADUATE_LOADS = tuple(f"{load} {kind}" for load in ("Full-time", "Part-time") for kind in GRADUATES)
NEW_SEXES, OLD_SEXES = ("Males", "Females", "Unknown", "Total"), ("Men", "Women", "Another gender", "Unknown", "Total")
COHORT = ("Initial cohort", "Did not persist", "Final cohort", "Completed in less than four years", "Completed in less than five years", "Completed in less than six years", "Total completers", "Six-year graduation rate")
AID = ("Pell Grant", "Subsidized Stafford, no Pell", "Neither Pell nor subsidized Stafford", "Total")
AID_COHORTS = ("First-year full-time", "All undergraduates full-time", "All undergraduates less-than-full-time")
DISCIPLINES = (
    "Agriculture", "Natural resources and conservation", "Architecture", "Area, ethnic, and gender studies", "Communication/journalism", "Communication technologies", "Computer and information sciences",
    "Personal and culinary services", "Education", "Engineering", "Engineering technologies", "Foreign languages, literatures, and linguistics", "Family and consumer sciences", "Law/legal studies", "English",
    "Liberal arts/general studies", "Library science", "Biological/life sciences", "Mathematics and statistics", "Military science and military technologies", "Interdisciplinary studies", "Parks and recreation",
    "Philosophy and religious studies", "Theology and religious vocations", "Physical sciences", "Science technologies", "Psychology", "Homeland Security, law enforcement, firefighting, and protective services",
    "Public administration and social services", "Social sciences", "Construction trades", "Mechanic and repair technologies", "Precision production", "Transportation and materials moving", "Visual and performing arts",
    "Health professions and related programs", "Business/marketing", "History", "Other", "Total",
)


def _totalled(rows: tuple, totals: dict[str, str]) -> tuple:
    """Rows with one more column, which only some rows fill."""
    return tuple((label, (*ids, totals.get(label))) for label, ids in rows)


def _enrollment(name: str, title: str, labels: Sequence[str], new: int, old: int, totals: dict[str, tuple[str, str]]) -> tuple[Matrix, Matrix]:
    """Enrollment of both layouts: the newer numbers sex by sex, 25 apart, the older row by row in fours; totals have numbers of their own."""
    return (
        Matrix(name, title, NEW_SEXES, _totalled(series(labels, "B", new, (0, 25, 50)), {k: v[0] for k, v in totals.items()}), "new"),
        Matrix(name, title, OLD_SEXES, _totalled(series(labels, "B", old, (0, 1, 2, 3), 4), {k: v[1] for k, v in totals.items()}), "old"),
    )


MATRICES: tuple[Matrix, ...] = (
    *_enrollment("b1-undergraduate", "B1 undergraduate enrollment", (*LOADS, "Total undergraduates"), 101, 101, {"Total undergraduates": ("B.176", "B.193")}),
    *_enrollment("b1-graduate", "B1 graduate enrollment", (*GRADUATE_LOADS, "Total graduate students"), 114, 153, {"Total graduate students": ("B.177", "B.194")}),
    Matrix("b1-overall", "B1 overall enrollment", NEW_SEXES, _totalled(series(("Total full-time students", "Total part-time students", "Grand total all students"), "B", 123, (0, 25, 50)), {"Grand total all students": "B.178"}), "new"),
    Matrix("b1-overall", "B1 overall enrollment", OLD_SEXES, fields("Grand total all students: B.189 B.190 B.191 B.192 B.195"), "old"),
    Matrix("b2-race-ethnicity", "B2 enrollment by race and ethnicity", ("First-time first-year", "Degree-seeking undergraduates", "Total undergraduates"), series((
        "Nonresidents", "Hispanic/Latino", "Black or African American, non-Hispanic", "White, non-Hispanic", "American Indian or Alaska Native, non-Hispanic", "Asian, non-Hispanic",
        "Native Hawaiian or other Pacific Islander, non-Hispanic", "Two or more races, non-Hispanic", "Race and/or ethnicity unknown", "Total",
    ), "B", 201, (0, 10, 20))),
    Matrix("b3-degrees-awarded", "B3 degrees awarded", ("Number awarded",), series((
        "Certificate/diploma", "Associate degrees", "Bachelor's degrees", "Postbachelor's certificates", "Master's degrees", "Post-master's certificates", "Doctoral degrees, research/scholarship",
        "Doctoral degrees, professional practice", "Doctoral degrees, other",
    ), "B", 301, (0,))),
    Matrix("b4-current-graduation-rates", "B4 current graduation-rate cohort", AID, series(COHORT, "B", 401, (0, 1, 2, 3), 4), percent=COHORT[-1:]),
    Matrix("b5-previous-graduation-rates", "B5 previous graduation-rate cohort", AID, series(COHORT, "B", 501, (0, 1, 2, 3), 4), percent=COHORT[-1:]),
    Matrix("b22-first-year-retention", "B22 first-year retention", ("Value",), series(("Entering cohort", "Still enrolled next fall", "Retention rate"), "B", 2201, (0,)), percent=("Retention rate",)),
    Matrix("b12-b21-two-year-graduation-rates", "B12-B21 two-year graduation rates", ("Current cohort", "Previous cohort"), series((
        "Initial cohort", "Did not persist", "Final cohort", "Completed program in less than two years", "Completed program in less than two years at 150% time", "Completed program in less than four years",
        "Completed program in less than four years at 150% time", "Transfers out", "Transfers to two-year institutions", "Transfers to four-year institutions",
    ), "B", 1201, (0, 1), 100)),
    Matrix("c1-admissions", "C1 first-year admissions", ("Males", "Females", "Unknown sex", "Total"), fields(
        "Applied: C.101 C.102 C.103 C.116", "Admitted: C.104 C.105 C.106 C.117", "Enrolled: C.107 C.108 C.109 C.118", "Enrolled full-time: C.110 C.112 C.114 -", "Enrolled part-time: C.111 C.113 C.115 -",
    ), "new"),
    Matrix("c1-admissions", "C1 first-year admissions", ("Men", "Women", "Another gender", "Unknown gender", "Total"), fields(
        "Applied: C.101 C.102 C.103 C.104 C.117", "Admitted: C.105 C.106 C.107 C.108 C.118", "Enrolled full-time: C.109 C.111 C.113 C.115 -", "Enrolled part-time: C.110 C.112 C.114 C.116 -",
        "Enrolled total: - - - - C.119",
    ), "old"),
    Matrix("c7-factors", "C7 basis for selection", ("Very important", "Important", "Considered", "Not considered"), series((
        "Rigor of secondary school record", "Class rank", "Academic GPA", "Standardized test scores", "Application essay", "Recommendations", "Interview", "Extracurricular activities", "Talent or ability",
        "Character and personal qualities", "First generation", "Alumni relation", "Geographical residence", "State residency", "Religious affiliation or commitment", "Volunteer work", "Work experience",
        "Level of applicant interest",
    ), "C", 701, (0, 0, 0, 0)), choice=True),
    Matrix("c9-submission", "C9 test-score submission", ("Percent", "Number"), series(("SAT", "ACT"), "C", 901, (0, 2))),
    Matrix("c9-percentiles", "C9 test-score percentiles", ("25th percentile", "50th percentile", "75th percentile"), series((
        "SAT composite", "SAT evidence-based reading and writing", "SAT math", "ACT composite", "ACT math", "ACT English", "ACT Writing", "ACT Science", "ACT Reading",
    ), "C", 905, (0, 1, 2), 3)),
    Matrix("d2-transfer-admissions", "D2 transfer admissions", NEW_SEXES, series(("Applied", "Admitted", "Enrolled"), "D", 201, (0, 1, 2, 3), 4), "new"),
    Matrix("d2-transfer-admissions", "D2 transfer admissions", ("Men", "Women", "Unknown", "Total"), series(("Applied", "Admitted", "Enrolled"), "D", 201, (0, 1, 2, 3), 4), "old"),
    Matrix("g1-undergraduate-costs", "G1 undergraduate costs", ("First-year", "All undergraduates"), (
        *fields("Tuition: G.101 G.102"), *series(("Tuition: in-district", "Tuition: in-state", "Tuition: out-of-state", "Tuition: nonresident"), "G", 103, (0, 4)),
        *series(("Required fees", "Food and housing, on-campus", "Housing only, on-campus", "Food only, on-campus meal plan"), "G", 111, (0, 4)), *fields("Comprehensive tuition, food, and housing: G.119 -", "Other: G.120 -"),
    )),
    Matrix("g5-estimated-expenses", "G5 estimated expenses", ("Residents", "Commuters living at home", "Commuters not living at home"), fields(
        "Books and supplies: G.501 G.504 G.508", "Food only: - G.505 G.510", "Housing only: - - G.509", "Food and housing total: - - G.511", "Transportation: G.502 G.506 G.512", "Other expenses: G.503 G.507 G.513",
    )),
    Matrix("h2-aid-awarded", "H2 students awarded aid", AID_COHORTS, series((
        "Degree-seeking undergraduates", "Applied for need-based aid", "Determined to have financial need", "Awarded any aid", "Awarded need-based scholarship or grant aid", "Awarded need-based self-help aid",
        "Awarded non-need-based scholarship or grant aid", "Need fully met", "Average percentage of need met", "Average financial aid package", "Average need-based scholarship or grant",
        "Average need-based self-help award", "Average need-based loan",
    ), "H", 201, (0, 13, 26))),
    Matrix("h2a-non-need-aid", "H2A non-need-based aid", AID_COHORTS, fields(
        "Institutional non-need grant recipients: H.2A01 H.2A05 H.2A09", "Average institutional non-need grant: H.2A02 H.2A06 H.2A10", "Athletic grant recipients: H.2A03 H.2A07 H.2A11", "Average athletic grant: H.2A04 H.2A08 H.2A12",
    )),
    Matrix("h5-student-loans", "H5 student loans", ("Number in class", "Percent of class", "Average per borrower"), series(("Any loan program", "Federal loan programs", "Institutional loan programs", "State loan programs", "Private student loans"), "H", 501, (0, 5, 10))),
    Matrix("i1-instructional-faculty", "I1 instructional faculty", ("Full-time", "Part-time", "Total"), series((
        "Total instructional faculty", "Members of minority groups", "Females", "Males", "Nonresidents", "Doctorate or other terminal degree", "Master's, but not terminal master's", "Bachelor's degree",
        "Unknown or other highest degree", "Stand-alone graduate/professional programs",
    ), "I", 101, (0, 10, 20))),
    Matrix("i3-undergraduate-class-size", "I3 undergraduate class size", ("Class sections", "Class subsections"), series(("2-9 students", "10-19 students", "20-29 students", "30-39 students", "40-49 students", "50-99 students", "100+ students", "Total"), "I", 301, (0, 8))),
    Matrix("j-degrees-conferred", "J degrees conferred by discipline", ("Certificate/diploma", "Associate", "Bachelor's"), series(DISCIPLINES, "J", 101, (0, 40, 80)), percent=None),
)
#: Sections whose table has an older layout, with what tells it: a field and a phrase of its question, or fields that only the older one has.
OLD_SIGNS = {
    "b1": ((("B.103", "another gender"),), tuple(f"B.{n}" for n in range(189, 196))),
    "c1": ((("C.103", "another gender"), ("C.104", "unknown gender who applied"), ("C.117", "students who applied")), ()),
    "d2": ((), ()),
}
OLD_SCHEMA = "2024-25"


def dictionary(spark: SparkSession, matrices: Sequence[Matrix] = MATRICES) -> DataFrame:
    """``(at, name, title, section, form, row, label, col, column, field, percent, choice)``: one row for each cell."""
    rows = [
        (at, m.name, m.title, m.name.split("-")[0], m.form, r, label, c, m.columns[c], field, m.percent is None or label in m.percent, m.choice)
        for at, m in enumerate(matrices)
        for r, (label, ids) in enumerate(m.rows)
        for c, field in enumerate(ids)
    ]
    return spark.createDataFrame(rows, "at int, name string, title string, section string, form string, row int, label string, col int, column string, field string, percent boolean, choice boolean")


def _reported(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return value.isNotNull() & ~low.isin("", "—", ABSENT.lower()) & ~low.contains("not provided")


def matrices(values: DataFrame, id_col: str, layouts: Sequence[Matrix] = MATRICES) -> DataFrame:
    """``(id_col, name, title, row, label, cells)``: the rows of each table in which a document reports anything.

    ``values`` has (id_col, field, value) and may have ``question`` and ``schema_version``. A section with two layouts
    takes the older one if the version is OLD_SCHEMA (C1 and D2) or the fields themselves tell it (B1 and C1). ``cells`` has
    (column, field, display, missing): a cell without a value shows that it isn't reported. Of repeated fields the
    least value counts; fields that stand in no table are left out.
    """
    cells = dictionary(values.sparkSession, layouts).withColumn("key", F.shiftleft("at", CELL_BITS) + F.row_number().over(Window.partitionBy("at").orderBy("row", "col")))
    blank = F.struct("column", F.when(~F.col("choice"), F.col("field")).alias("field"), F.lit(ABSENT).alias("display"), F.lit(True).alias("missing"))
    place = F.struct("col", "key", blank.alias("blank"), "field")
    rows = cells.groupBy("at", "name", "title", "section", "form", "row", "label").agg(F.array_sort(F.collect_list(place)).alias("places"))
    tables = rows.groupBy("at", "name", "title", "section", "form").agg(F.array_sort(F.collect_list(F.struct("row", "label", "places"))).alias("_rows"))

    text = {c: F.lower(F.col(c)) if c in values.columns else F.lit(None).cast("string") for c in ("question", "schema_version")}
    own = spread(values.select(id_col, "field", "value", text["question"].alias("_question"), text["schema_version"].alias("schema_version")), id_col)
    where = cells.where("field IS NOT NULL").select("key", "field", "percent", "choice", normalised_label(F.col("column")).alias("_column"))
    own = own.join(F.broadcast(where), "field")
    value = F.col("value")
    chosen = F.col("choice") & F.coalesce(normalised_label(value) == F.col("_column"), F.lit(False))
    sign = F.when(F.col("percent") & _reported(value) & ~value.endswith("%"), F.concat(value, F.lit("%"))).otherwise(F.when(F.trim(value) != "", value))
    choice = F.when(value.isNull(), ABSENT).when(chosen, "Yes").otherwise("—")
    display = F.when(F.col("choice"), choice).otherwise(F.coalesce(sign, F.lit(ABSENT)))
    missing = F.when(F.col("choice"), ~chosen).otherwise(~_reported(value))
    shown = F.struct("key", "value", display.alias("display"), missing.alias("missing"))

    version = F.max(F.col("schema_version") == OLD_SCHEMA)
    signs = {s: F.coalesce(F.bool_or(_sign(asked, only)), F.lit(False)) for s, (asked, only) in OLD_SIGNS.items()}
    docs = own.groupBy(id_col).agg(F.array_sort(F.collect_set(shown)).alias("_all"), F.coalesce(version, F.lit(False)).alias("_old"), *[v.alias(f"_{s}") for s, v in signs.items()])
    docs = docs.withColumns({"_c1": F.col("_c1") | F.col("_old"), "_d2": F.col("_old")})
    old = F.filter(F.array(*[F.when(F.col(f"_{s}"), s) for s in OLD_SIGNS]), lambda x: x.isNotNull())
    docs = docs.select(id_col, old.alias("_olds"), F.filter("_all", lambda e, i: (i == 0) | (F.get("_all", i - 1)["key"] != e["key"])).alias("_first"))
    reported = F.array_distinct(F.transform(F.filter("_first", lambda e: ~e["missing"]), lambda e: F.shiftright(e["key"], CELL_BITS)))
    by_key = F.map_from_entries(F.transform("_first", lambda e: F.struct(e["key"].alias("key"), F.struct(e["display"].alias("display"), e["missing"].alias("missing")).alias("shown"))))
    filled = docs.select(id_col, "_olds", by_key.alias("_shown"), F.explode(reported).alias("at")).join(F.broadcast(tables), "at")
    filled = filled.where("form IS NULL OR (form = 'old') = array_contains(_olds, section)")

    def cell(p: Column) -> Column:
        own = lambda x: F.struct(p["blank"]["column"].alias("column"), F.coalesce(p["blank"]["field"], F.when(~x["missing"], p["field"])).alias("field"), x["display"].alias("display"), x["missing"].alias("missing"))
        return F.transform(F.array(F.try_element_at("_shown", p["key"])), lambda x: F.when(x.isNull(), p["blank"]).otherwise(own(x)))[0]

    made = F.transform("_rows", lambda r: F.struct(r["row"].alias("row"), r["label"].alias("label"), F.transform(r["places"], cell).alias("cells")))
    return filled.select(id_col, "name", "title", F.inline(made))


def _sign(asked: Sequence[tuple[str, str]], only: Sequence[str]) -> Column:
    out = F.col("field").isin(*only) if only else F.lit(False)
    for field, phrase in asked:
        out = out | ((F.col("field") == field) & F.coalesce(F.col("_question").contains(phrase), F.lit(False)))
    return out


def field_values(made: DataFrame, id_col: str) -> DataFrame:
    """``(id_col, field, value)`` of the cells of ``matrices`` that are reported; percent signs that the table shows stay, a choice is its column."""
    cells = made.select(id_col, F.explode("cells").alias("c")).where("NOT c.missing AND c.field IS NOT NULL")
    return cells.select(id_col, "c.field", F.when(F.col("c.display") == "Yes", F.col("c.column")).otherwise(F.col("c.display")).alias("value"))


def markdown(made: DataFrame, id_col: str) -> DataFrame:
    """``(id_col, text)``: a document's tables as Markdown, each under its title as a heading; cells that aren't reported are empty, choices an X.

    Rows without any reported cell are left out: a label alone would be read as the beginning of the next one.
    """
    made = made.where(F.exists("cells", lambda c: ~c["missing"]))
    cell = F.transform("cells", lambda c: F.when(c["missing"], "").when(c["display"] == "Yes", "X").otherwise(F.replace(c["display"], F.lit("|"), F.lit("/"))))
    lines = made.select(id_col, "title", "row", F.concat(F.lit("| "), "label", F.lit(" | "), F.array_join(cell, " | "), F.lit(" |")).alias("line"), F.transform("cells", lambda c: c["column"]).alias("_heads"))
    tables = lines.groupBy(id_col, "title").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("_rows"), F.first("_heads").alias("_heads"))
    head = F.concat(F.lit("## "), "title", F.lit("\n| | "), F.array_join("_heads", " | "), F.lit(" |\n|"), F.repeat(F.lit("---|"), F.size("_heads") + 1))
    body = F.array_join(F.transform("_rows", lambda r: r["line"]), "\n")
    texts = tables.select(id_col, F.struct("title", F.concat(head, F.lit("\n"), body, F.lit("\n")).alias("text")).alias("t"))
    return texts.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), "").alias("text"))


def fields_of_tables(rows: DataFrame, id_col: str, layouts: Sequence[Matrix] = MATRICES) -> DataFrame:
    """``(id_col, field, value)`` of rows of ``pipe_tables`` whose heading is a table's title and whose headers are all its columns, by their label and the header above each cell; a marked choice gives its column."""
    heads = F.slice("headers", 2, F.greatest(F.size("headers") - 1, F.lit(0)))
    cells = rows.select(id_col, "section", "label", F.coalesce(F.array_join(heads, "|"), F.lit("")).alias("heads"), F.inline(F.arrays_zip(heads.alias("column"), F.col("values").alias("cell")))).where("trim(cell) <> ''")
    places = [(m.title, "|".join(m.columns), label, m.columns[c], field, m.choice) for m in layouts for label, ids in m.rows for c, field in enumerate(ids) if field]
    known = rows.sparkSession.createDataFrame(places, "section string, heads string, label string, column string, field string, choice boolean").distinct()
    found = cells.join(F.broadcast(known), ["section", "heads", "label", "column"])
    return found.select(id_col, "field", F.when(F.col("choice"), F.col("column")).otherwise(F.trim("cell")).alias("value")).distinct()
