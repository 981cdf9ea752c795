"""Filled forms as Markdown: pipe tables with headers, continued and wrapped rows, and the fields that their cells answer.

Tables are read inside the row: a text is cut into sections, sections into runs of lines, and
runs into rows, each step linear in the lines; nothing is shuffled but the texts, once. Resolvers
are joins of table rows with small dictionaries of labels, columns and fields; their claims are put
together by rank.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwork.functions.parsing import normalised_label
from cairnwork.operators.lines import spread
from cairnwork.operators.ranking import first_per_key

# Labels that stand alone although their values are empty, rows of the waiting list, importance levels by header, factors
# of the basis for selection with their categories, columns of the enrollment table, tests with the first of their percentile fields.
UNWRAPPED = (
    "sat composite", "sat evidence based reading and writing", "sat math", "act composite", "act math", "act english", "act writing", "act science", "act reading",
)
WAITING = {"number of qualified applicants offered": "C.202", "number accepting a place": "C.203", "number of wait listed students admitted": "C.204"}
LEVELS = {"very important": "Very Important", "important": "Important", "considered": "Considered", "not considered": "Not Considered", "not": "Not Considered"}
ACADEMIC = {
    "rigor of secondary school": "Rigor of secondary school record", "class rank": "Class rank", "academic gpa": "Academic GPA", "standardized test scores": "Standardized test scores",
    "application essay": "Application Essay", "recommendation": "Recommendation(s)",
}
NONACADEMIC = {
    "interview": "Interview", "extracurricular": "Extracurricular activities", "talent ability": "Talent/ability", "character personal qualities": "Character/personal qualities",
    "first generation": "First generation", "alumni ae relation": "Alumni/ae relation", "geographical residence": "Geographical residence", "state residency": "State residency",
    "religious affiliation": "Religious affiliation/commitment", "volunteer work": "Volunteer work", "work experience": "Work experience", "level of applicant": "Level of applicant’s interest",
}
COHORTS = {"total undergraduates": ("All", "All"), "degree seeking undergraduates": ("All", "Degree-seeking"), "first time first year": ("First-time, first-year", "Degree-seeking")}
TEST_FIELDS = {
    "sat composite": 905, "sat evidence based reading": 908, "sat math": 911, "act composite": 914, "act math": 917, "act english": 920,
}
SCORE_BOUNDS = (("sat composite", 400, 1600), ("sat", 200, 800), ("act", 1, 36))


def _cells(line: Column) -> Column:
    """What stands between the pipes of a line: nothing before the first and after the last counts. The line is split once for its parts and their number."""
    inner = lambda parts: F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.transform(F.transform(F.array(F.split(line, "\\|")), inner)[0], lambda x: F.trim(x))


def _places(items: str, condition: Callable[[Column, Column], Column]) -> Column:
    """The places, from 0, of the items of an array column that fulfil a condition on item and place."""
    return F.filter(F.transform(items, lambda x, i: F.when(condition(x, i), i)), lambda i: i.isNotNull())


def _stretch(items: str, places: str, first: Column, k: Column) -> Column:
    """The items from ``first`` up to the place after the k-th of ``places``."""
    return F.slice(items, first + 1, F.coalesce(F.get(places, k + 1), F.size(items)) - first)


def pipe_tables(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, section, start, at, label, values, headers): the rows of the pipe tables of each text.

    A table is a run of two or more lines from one with a second pipe on; ``start`` is its first
    line. The first line is the header unless a cell after the first has a digit and none names a
    percentile; then it is a row and headers are empty. The rule under the header is left out. A
    row without label continues the label before it. A row whose label stands without values before
    a row with both is the beginning of that row's label. The section is the latest ## heading.
    """
    docs = spread(docs.select(id_col, text_col), id_col)
    lines = F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("line")))
    kept = docs.select(id_col, F.filter(lines, lambda x: x["line"].startswith("|") | x["line"].startswith("## ")).alias("_kept"))

    # sections: -1 stands for what is before the first heading
    kept = kept.withColumn("_heads", F.concat(F.array(F.lit(-1)), _places("_kept", lambda x, i: x["line"].startswith("## "))))
    title = lambda p: F.coalesce(F.trim(F.regexp_replace(F.get("_kept", p)["line"], "^[# ]+", "")), F.lit(""))
    sections = F.transform("_heads", lambda p, k: F.struct(title(p).alias("section"), _stretch("_kept", "_heads", p + 1, k).alias("_piped")))
    parts = kept.select(id_col, F.inline(F.filter(sections, lambda x: F.size(x["_piped"]) >= 2)))

    # runs of adjacent lines; a table goes from the first line with a second pipe on, which is looked for inside the generator: filters can't repeat it
    parts = parts.withColumn("_breaks", _places("_piped", lambda x, i: (i == 0) | (F.get("_piped", i - 1)["at"] != x["at"] - 1)))
    begin = lambda run: F.array_position(F.transform(run, lambda x: F.substring(x["line"], 2, 1 << 30).contains("|")), True).cast("int")
    stretches = F.transform("_breaks", lambda p, k: _stretch("_piped", "_breaks", p, k))
    runs = parts.select(id_col, "section", F.inline(F.transform(stretches, lambda run: F.struct(run.alias("_run"), begin(run).alias("_begin"))))).where("_begin > 0 AND size(_run) > _begin")
    tables = runs.select(id_col, "section", F.slice("_run", F.greatest("_begin", F.lit(1)), F.size("_run")).alias("_run"))

    tables = tables.withColumns({"start": F.get("_run", F.lit(0))["at"], "_first": _cells(F.get("_run", F.lit(0))["line"])})
    rest = F.slice("_first", 2, F.greatest(F.size("_first") - 1, F.lit(0)))
    data_first = F.exists(rest, lambda x: x.rlike("\\d")) & ~F.exists(rest, lambda x: x.rlike("(?i)\\b(?:25|50|75)(?:th)?\\s+percentile\\b"))
    tables = tables.withColumn("_data", data_first)
    body = F.col("start") + F.when(F.col("_data"), 0).otherwise(1)
    rule = lambda x: (x["at"] == body) & x["line"].rlike("^\\|[\\s\\-:|]+\\|$")
    rows = F.transform(F.filter("_run", lambda x: (x["at"] >= body) & ~rule(x)), lambda x: F.struct(x["at"].alias("at"), _cells(x["line"]).alias("cells")))
    rows = F.transform(F.filter(rows, lambda x: F.size(x["cells"]) > 0), lambda x: F.struct(x["at"].alias("at"), x["cells"][0].alias("label"), F.slice(x["cells"], 2, F.greatest(F.size(x["cells"]) - 1, F.lit(0))).alias("values")))
    rows = F.transform(rows, lambda x: F.struct(x["at"].alias("at"), x["label"].alias("label"), x["values"].alias("values"), F.exists(x["values"], lambda v: v != "").alias("full")))
    headers = F.when(F.col("_data"), F.transform("_first", lambda x: F.lit(""))).otherwise(F.col("_first"))
    tables = tables.select(id_col, "section", "start", headers.alias("headers"), rows.alias("_rows"))

    def joined(x: Column, i: Column) -> Column:
        before = F.get("_rows", i - 1)
        joins = (x["label"] != "") & x["full"] & (before["label"] != "") & ~before["full"] & ~normalised_label(before["label"]).isin(*UNWRAPPED)
        return F.struct(*[x[c].alias(c) for c in ("at", "label", "values", "full")], F.coalesce(joins, F.lit(False)).alias("joins"))

    def whole(x: Column, i: Column) -> Column:
        label = F.when(x["joins"], F.concat_ws(" ", F.get("_rows", i - 1)["label"], x["label"])).otherwise(x["label"])
        return F.struct(x["at"].alias("at"), label.alias("label"), x["values"].alias("values"), x["full"].alias("full"), F.coalesce(F.get("_rows", i + 1)["joins"], F.lit(False)).alias("taken"))

    # stretches from one label to the next: a row without a label has that of its stretch
    tables = tables.withColumn("_rows", F.transform("_rows", joined)).withColumn("_rows", F.transform("_rows", whole))
    tables = tables.withColumn("_labels", _places("_rows", lambda x, i: (i == 0) | (x["label"] != "")))

    def labelled(p: Column, k: Column) -> Column:
        label = F.get("_rows", p)["label"]
        return F.transform(_stretch("_rows", "_labels", p, k), lambda x: F.struct(x["at"].alias("at"), F.when((x["label"] == "") & x["full"], label).otherwise(x["label"]).alias("label"), x["values"].alias("values"), x["taken"].alias("taken")))

    made = F.filter(F.flatten(F.transform("_labels", labelled)), lambda x: ~x["taken"])
    return tables.select(id_col, "section", "start", "headers", F.inline(made)).select(id_col, "section", "start", "at", "label", "values", "headers")


def cell_number(text: Column) -> Column:
    """The number in a cell without $ % and commas, as text; null if it isn't one."""
    bare = F.trim(F.regexp_replace(text, "[$%,]", ""))
    return F.when(bare.rlike("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"), bare)


def _first_of(text: Column, table: Mapping[str, str]) -> Column:
    """The value of the first key that the text holds; the text itself is made once for all keys."""
    first = lambda t: reduce(lambda out, x: F.when(t.contains(x[0]), x[1]).otherwise(out), reversed(table.items()), F.lit(None).cast("string"))
    return F.transform(F.array(text), first)[0]


def _joined(headers: Column) -> Column:
    return F.array_join(F.transform(headers, lambda h: normalised_label(h)), " ")


def claims_of(rows: DataFrame, id_col: str, field: Column, value: Column) -> DataFrame:
    """(id_col, field, value, start, at) of the rows that answer a field."""
    made = rows.withColumns({"field": field, "value": value})
    return made.where("field IS NOT NULL AND value IS NOT NULL").select(id_col, "field", "value", "start", "at")


def waiting_list(rows: DataFrame, id_col: str) -> DataFrame:
    """The counts of the waiting list, from tables whose header speaks of it."""
    listed = rows.where(_joined(F.col("headers")).contains("waiting list"))
    return claims_of(listed, id_col, _first_of(normalised_label(F.col("label")), WAITING), cell_number(F.try_element_at("values", F.lit(1))))


def selection_basis(rows: DataFrame, id_col: str, fields: DataFrame) -> DataFrame:
    """The importance of each factor, the header of the column that is marked in its row.

    A table counts if its header names the levels or if three of its rows are factors; without
    named levels four columns are all levels and three are all but the first. ``fields`` has
    (category, question, field).
    """
    label = normalised_label(F.col("label"))
    factor = F.coalesce(_first_of(label, ACADEMIC), _first_of(label, NONACADEMIC))
    category = F.when(_first_of(label, ACADEMIC).isNotNull(), "Academic Factors").otherwise("Nonacademic Factors")
    table = Window.partitionBy(id_col, "start")
    names = F.transform(F.slice("headers", 2, F.greatest(F.size("headers") - 1, F.lit(0))), lambda h: normalised_label(h))
    level = F.transform(names, lambda h: reduce(lambda out, x: F.when(h.startswith(x[0]), x[1]).otherwise(out), reversed(LEVELS.items()), F.lit(None).cast("string")))
    shown = F.exists(F.array(_joined(F.col("headers"))), lambda h: h.contains("very important") & h.contains("considered"))
    made = rows.withColumns({"question": factor, "category": category, "_levels": level})
    made = made.withColumns({"_rows": F.count("question").over(table), "_wide": F.max(F.size("values")).over(table)}).where(shown | (F.col("_rows") >= 3))
    plain = F.when(F.col("_wide") == 4, F.array(*map(F.lit, list(LEVELS.values())[:4]))).when(F.col("_wide") == 3, F.array(*map(F.lit, list(LEVELS.values())[1:4])))
    levels = F.when(F.exists("_levels", lambda x: x.isNotNull()), F.col("_levels")).otherwise(plain)
    marked = F.filter(F.arrays_zip(levels.alias("level"), F.col("values").alias("mark")), lambda z: z["level"].isNotNull() & (F.coalesce(z["mark"], F.lit("")) != "") & ((F.length(z["mark"]) <= 3) | (F.lower(z["mark"]) == "checked")))
    chosen = made.withColumn("value", F.try_element_at(F.transform(marked, lambda z: z["level"]), F.lit(1))).where("question IS NOT NULL AND value IS NOT NULL")
    return chosen.join(F.broadcast(fields), ["category", "question"]).select(id_col, "field", "value", "start", "at")


def enrollment_by_race(rows: DataFrame, id_col: str, fields: DataFrame) -> DataFrame:
    """B2: counts of each row in each cohort's column. ``fields`` has (cohort, category, question, field), matched by the normalised question."""
    heads = F.transform(F.slice("headers", 2, F.greatest(F.size("headers") - 1, F.lit(0))), lambda h: normalised_label(h))
    keys = F.transform(heads, lambda h: reduce(lambda out, x: F.when(h.contains(x[0]), "|".join(x[1])).otherwise(out), reversed(COHORTS.items()), F.lit(None).cast("string")))
    there = _joined(F.col("headers")).rlike("first time first year|degree seeking")
    cells = rows.where(there).select(id_col, "start", "at", normalised_label(F.col("label")).alias("_q"), F.posexplode(F.arrays_zip(keys.alias("key"), F.col("values").alias("cell"))).alias("place", "z"))
    known = fields.select(F.concat_ws("|", "cohort", "category").alias("key"), normalised_label(F.col("question")).alias("_q"), "field")
    found = cells.select(id_col, "start", "at", "_q", "z.key", cell_number(F.col("z.cell")).alias("value")).where("key IS NOT NULL AND value IS NOT NULL")
    return found.join(F.broadcast(known), ["key", "_q"]).select(id_col, "field", "value", "start", "at")


def score_percentiles(rows: DataFrame, id_col: str) -> DataFrame:
    """The 25th, 50th and 75th percentile of each test, by the header over each value; scores that can't be are left out."""
    label = normalised_label(F.col("label"))
    test = _first_of(label, {t: t for t in TEST_FIELDS})
    roles = F.transform(F.slice("headers", 2, F.greatest(F.size("headers") - 1, F.lit(0))), lambda h: F.regexp_extract(h, "(?i)\\b(25|50|75)(?:th)?\\s+percentile\\b", 1))
    cells = rows.withColumn("_test", test).where("_test IS NOT NULL").select(id_col, "start", "at", "_test", F.explode(F.arrays_zip(roles.alias("role"), F.col("values").alias("cell"))).alias("z"))
    cells = cells.select(id_col, "start", "at", "_test", "z.role", cell_number(F.col("z.cell")).alias("value")).where("role <> '' AND value IS NOT NULL")
    number = F.col("value").try_cast("double")
    fits = reduce(lambda out, b: F.when(F.col("_test").startswith(b[0]), number.between(b[1], b[2])).otherwise(out), reversed(SCORE_BOUNDS), F.lit(False))
    first = F.element_at(F.create_map(*[F.lit(x) for pair in TEST_FIELDS.items() for x in pair]), F.col("_test"))
    place = F.when(F.col("role") == "25", 0).when(F.col("role") == "50", 1).otherwise(2)
    return cells.where(fits).select(id_col, F.concat(F.lit("C."), (first + place).cast("string")).alias("field"), "value", "start", "at")


def cleaned(claims: Sequence[DataFrame], id_col: str, overriding: str | None = None) -> DataFrame:
    """(id_col, field, value, source): of the claims on a field the one of the first source wins, in a source the first in the text.

    Fields that the pattern ``overriding`` matches are taken from the last source instead.
    """
    ranked = reduce(DataFrame.unionByName, [c.withColumn("source", F.lit(i)) for i, c in enumerate(claims)])
    order = F.when(F.col("field").rlike(overriding), -F.col("source")).otherwise(F.col("source")) if overriding else F.col("source")
    return first_per_key(spread(ranked, id_col), [id_col, "field"], [order.asc(), F.asc("start"), F.asc("at")]).select(id_col, "field", "value", "source")
