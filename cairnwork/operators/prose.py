"""Fields of filled forms whose answers stand in prose and columns of text rather than in pipe tables.

Each resolver is a map over texts: it cuts the block of its section, reads answers by label, by the
row's code or by the column that a mark stands in, and returns claims ``(id_col, field, value)``.
Blocks are cut by patterns and read line by line inside the row; texts are dealt over tasks by
their id first. What several answers need of a text is a column of its own, made once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwork.functions.parsing import normalised_label
from cairnwork.operators.forms import _joined, cell_number, claims_of
from cairnwork.operators.lines import spread

# Rows of the degrees table, subjects of the units table, rows of the participation table, letters and columns of the faculty table, months, and options by field.
DEGREES = {
    "certificate diploma": "B.301", "associate degrees": "B.302", "bachelor's degrees": "B.303", "bachelors degrees": "B.303", "postbachelor's certificates": "B.304", "postbachelors certificates": "B.304",
    "master's degrees": "B.305", "masters degrees": "B.305", "post master's certificates": "B.306", "post masters certificates": "B.306", "doctoral degrees research scholarship": "B.307",
    "doctoral degrees professional practice": "B.308", "doctoral degrees other": "B.309",
}
SUBJECTS = {
    "total academic units": "Total academic units", "english": "English", "mathematics": "Mathematics", "foreign language": "Foreign language", "computer science": "Computer Science", "science": "Science",
    "units that must be lab": "Of these, units that must be lab", "social studies": "Social studies", "history": "History", "academic electives": "Academic electives",
    "visual performing arts": "Visual/Performing Arts", "other": "Other (specify)",
}
HALLMARKS = ("total academic units", "english", "mathematics", "foreign language")
PARTICIPATION = {
    "percent who are from out of state": ("F.101", "F.109"), "percent of men who join fraternities": ("F.102", "F.110"), "percent of women who join sororities": ("F.103", "F.111"),
    "percent who live in college owned": ("F.104", "F.112"), "percent who live off campus": ("F.105", "F.113"), "percent of students age 25": ("F.106", "F.114"),
    "average age of full time students": ("F.107", "F.115"), "average age of all students": ("F.108", "F.116"),
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
STUDY_OPTIONS = {
    "E.101": ("Accelerated program",), "E.102": ("Comprehensive transition",), "E.103": ("Cross-registration",), "E.104": ("Distance learning",), "E.105": ("Double major",), "E.106": ("Dual enrollment",),
    "E.107": ("English as a Second Language", "ESL"), "E.108": ("Exchange student program",), "E.109": ("External degree program",), "E.110": ("Honors program",), "E.111": ("Independent study",),
    "E.112": ("Internships",), "E.113": ("Liberal arts/career combination",), "E.114": ("Student-designed major",), "E.115": ("Study abroad",), "E.116": ("Teacher certification program",),
    "E.117": ("Undergraduate Research",), "E.118": ("Weekend college",),
}
AREAS = {
    "E.301": ("Arts/fine arts",), "E.302": ("Computer literacy",), "E.303": ("English (including composition)", "English"), "E.304": ("Foreign languages",), "E.305": ("History",), "E.306": ("Physical Education",),
    "E.307": ("Humanities",), "E.308": ("Intensive writing",), "E.309": ("Mathematics",), "E.310": ("Philosophy",), "E.311": ("Sciences (biological or physical)", "Sciences"), "E.312": ("Social science",),
}
ACTIVITIES = {
    "F.201": ("Campus Ministries",), "F.202": ("Choral groups",), "F.203": ("Concert band",), "F.204": ("Dance",), "F.205": ("Drama/theater",), "F.206": ("International Student Organization",),
    "F.207": ("Jazz band",), "F.208": ("Literary magazine",), "F.209": ("Marching band",), "F.210": ("Model UN",), "F.211": ("Music ensembles",), "F.212": ("Musical theater",), "F.213": ("Opera",),
    "F.214": ("Pep band",), "F.215": ("Radio station",), "F.216": ("Student government",), "F.217": ("Student newspaper",), "F.218": ("Student-run film society",), "F.219": ("Symphony orchestra",),
    "F.220": ("Television station",), "F.221": ("Yearbook",),
}
MARK = "(?<!\\w)[xX](?!\\w)|[☒✓✔]"
FEE = "Does your institution have an application fee\\?"
WAIVED = "Can it be waived for applicants with financial need\\?"
ONLINE = "Can on-line application fee be waived for applicants"
CLOSING = "Does your institution have an application closing date\\?"
GPA = "Average high school GPA of all degree-seeking"
SUBMITTED = "Percent of total first-time,\\s*first-year students who submitted"


def between(text: Column, start: str, end: str | None = None) -> Column:
    """What follows the first match of ``start``, up to the first match of ``end`` after it if there is one; empty without ``start``."""
    return F.coalesce(F.regexp_extract(text, f"(?is)(?:{start})(.*?)(?:{end}|\\z)" if end else f"(?is)(?:{start})(.*)", 1), F.lit(""))


def compact(text: Column) -> Column:
    """The text on one line, pipes and blanks as one blank."""
    return F.trim(F.regexp_replace(text, "[|\\s]+", " "))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def after_label(flat: Column, label: str, value: str) -> Column:
    """The value behind a label in a ``compact`` text, on whatever lines and in whatever cells both stood."""
    return found(flat, f"(?i){label}\\s*:?\\s*({value})")


def joined_answers(flat: Column) -> Column:
    """A ``compact`` text whose Yes and No have no blanks between their letters."""
    return F.regexp_replace(F.regexp_replace(flat, "(?i)\\bY\\s*e\\s*s\\b", "Yes"), "(?i)\\bN\\s*o\\b", "No")


def yes_no_after(joined: Column, label: str) -> Column:
    """Yes or No behind a label in a text of ``joined_answers``; N/A is No."""
    answer = F.lower(found(joined, f"(?i){label}\\s*:?\\s*(Yes|No|N/A|NA)\\b"))
    return F.when(answer == "yes", "Yes").when(answer.isNotNull(), "No")


def yes_no_columns(text: Column, question: str) -> Column:
    """Yes or No by the column in which the question's line has its last mark: the nearer of the words in the latest line that heads the two."""
    start = F.struct(F.lit(0).alias("yes"), F.lit(0).alias("no"), F.lit(None).cast("string").alias("answer"))

    def step(state: Column, line: Column) -> Column:
        heads = line.rlike("(?i)\\bYes\\b\\s+\\bNo\\b")
        asked = (state["yes"] > 0) & line.rlike(f"(?i){question}") & line.rlike(MARK)
        at = F.length(F.regexp_extract(line, f"^(.*)(?:{MARK})", 1)) + 1
        near = F.when(F.abs(at - state["yes"]) <= F.abs(at - state["no"]), "Yes").otherwise("No")
        return F.struct(
            F.when(heads, F.regexp_instr(line, F.lit("(?i)\\bYes\\b"))).otherwise(state["yes"]).alias("yes"),
            F.when(heads, F.regexp_instr(line, F.lit("(?i)\\bNo\\b"))).otherwise(state["no"]).alias("no"),
            F.when(state["answer"].isNull() & ~heads & asked, near).otherwise(state["answer"]).alias("answer"),
        )

    lines = F.split(F.coalesce(text, F.lit("")), "\\r?\\n")
    return F.aggregate(F.filter(lines, lambda x: x.rlike(f"(?i)\\bYes\\b\\s+\\bNo\\b|(?:{question})")), start, step, lambda s: s["answer"])


def month_and_day(date: Column) -> tuple[Column, Column]:
    """(month, day) as written numbers of 6/1, 1-Jun, Jun-1 or June 1, any text; nulls for anything else."""
    slash, first, last, spoken = "^(\\d{1,2})/(\\d{1,2})$", "^(\\d{1,2})-([A-Za-z]{3,4})$", "^([A-Za-z]{3,4})-(\\d{1,2})$", "^([A-Za-z]{3,9})\\s+(\\d{1,2})(?:,.*)?$"
    date = F.trim(date)
    name = F.lower(F.coalesce(found(date, first, 2), found(date, last), found(date, spoken)))
    # abbreviations between hyphens have three letters, or four for September alone; spoken names count by their first three
    whole = F.when(date.rlike(spoken), F.left(name, F.lit(3))).when(name == "sept", "sep").otherwise(name)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), whole)
    month = F.coalesce(found(date, slash), F.when(number > 0, number.cast("string")))
    day = F.coalesce(found(date, slash, 2), found(date, first), found(date, last, 2), found(date, spoken, 2))
    return month, F.when(month.isNotNull(), day)


def claimed(docs: DataFrame, id_col: str, fields: Mapping[str, Column]) -> DataFrame:
    """``(id_col, field, value)`` of the fields that have a value."""
    made = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields.items()])
    return docs.select(id_col, F.inline(F.filter(made, lambda c: c["value"].isNotNull())))


def _lines_of(docs: DataFrame, id_col: str, block: Column, name: str = "_lines") -> DataFrame:
    """The trimmed lines of a block of each text; the texts have been dealt over tasks."""
    return docs.select(id_col, F.transform(F.split(block, "\\r?\\n"), lambda x: F.trim(x)).alias(name))


def degrees_awarded(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The number at the end of a line whose label names one degree alone, the last such line of each; in texts without any, rows of tables under a heading that speaks of persistence."""
    docs = spread(docs.select(id_col, text_col), id_col)
    block = between(F.col(text_col), "\\bB3\\b\\s+Number of degrees awarded", "\\bB4\\b|\\bB4-B21\\b|Graduation Rates")

    def field_of(label: Column) -> Column:
        hits = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("field")) for k, v in DEGREES.items()]), lambda d: label.contains(d["key"]))
        return F.when(F.size(hits) == 1, hits[0]["field"])

    numbered = F.filter("_lines", lambda x: x.rlike("\\b\\d[\\d,]*\\b$"))
    labelled = F.transform(numbered, lambda x: F.struct(x.alias("line"), normalised_label(F.regexp_replace(x, "\\b\\d[\\d,]*\\b$", "")).alias("label")))
    answers = F.transform(labelled, lambda x: F.struct(field_of(x["label"]).alias("field"), cell_number(F.regexp_extract(x["line"], "\\b(\\d[\\d,]*)\\b$", 1)).alias("value")))
    spoken = _lines_of(docs, id_col, block).select(id_col, F.filter(answers, lambda a: a["field"].isNotNull()).alias("_answers"))

    def last(field: str) -> Column:
        return F.try_element_at(F.filter("_answers", lambda a: a["field"] == field), F.lit(-1))["value"]

    lines = claimed(spoken, id_col, {f: last(f) for f in dict.fromkeys(DEGREES.values())})
    listed = rows.where(normalised_label(F.col("section")).contains("persistence")).withColumn("_label", normalised_label(F.col("label")))
    cells = claims_of(listed, id_col, field_of(F.col("_label")), cell_number(F.try_element_at("values", F.lit(1))))
    latest = cells.groupBy(id_col, "field").agg(F.max_by("value", F.struct("start", "at")).alias("value"))
    return lines.unionByName(latest.join(spoken.where(F.size("_answers") > 0), id_col, "left_anti"))


def two_year_rates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first two numbers of a line behind its code: those after its last colon, or all if it has none, or those right behind the code."""
    docs = spread(docs.select(id_col, text_col), id_col)
    block = between(F.col(text_col), "For Two-Year Institutions", "\\bB22\\b")
    code = "^.*?\\b(?:B1[2-9]|B2[01])\\b"
    number = F.lit("(?<!\\d)\\d[\\d,]*(?!\\d)")

    coded = F.filter("_lines", lambda x: x.rlike("\\b(?:B1[2-9]|B2[01])\\b"))
    tails = F.transform(coded, lambda x: F.struct(found(x, "\\b(B1[2-9]|B2[01])\\b").alias("code"), F.regexp_replace(x, code, "").alias("tail")))

    def answer(x: Column) -> Column:
        tail = x["tail"]
        body = F.when(tail.contains(":"), F.substring_index(tail, ":", -1)).otherwise(tail)
        values = F.regexp_extract_all(body, number, 0)
        close = F.array_compact(F.array(found(tail, "^\\s*(\\d[\\d,]*)"), found(tail, "^\\s*\\d[\\d,]*\\s+(\\d[\\d,]*)")))
        return F.struct(x["code"].alias("code"), F.when(F.size(values) > 0, values).otherwise(close).alias("values"))

    rows = _lines_of(docs, id_col, block).select(id_col, F.transform(tails, answer).alias("_rows"))

    def last(n: int, k: int) -> Column:
        held = F.filter("_rows", lambda a: (a["code"] == f"B{n}") & (F.size(a["values"]) >= k))
        return cell_number(F.try_element_at(F.try_element_at(held, F.lit(-1))["values"], F.lit(k)))

    return claimed(rows, id_col, {f"B.{n}0{k}": last(n, k) for n in range(12, 22) for k in (1, 2)})


def retention_rate(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first percentage after the section's heading or first sentence, before the next heading or in 3,000 characters."""
    docs = spread(docs.select(id_col, text_col), id_col)
    tail = F.regexp_extract(F.col(text_col), "(?ims)(?:^#+\\s*B22\\b|\\bB22\\b(?=[^\\n]*retention|[^\\n]*\\bcohort\\b))(.*)", 1)
    docs, tail = docs.select(id_col, tail.alias("_tail")), F.col("_tail")
    window = F.when(tail.rlike("(?m)^##\\s"), F.regexp_extract(tail, "(?ms)\\A(.*?)^##\\s", 1)).otherwise(F.left(tail, F.lit(3000)))
    return claimed(docs, id_col, {"B.2203": found(window, "(\\d{1,3}(?:\\.\\d+)?)\\s*%")})


def _first_key(label: Column, keys: Sequence[str]) -> Column:
    return reduce(lambda out, k: F.when(label.contains(k), k).otherwise(out), reversed(keys), F.lit(None).cast("string"))


def _cells_by_head(rows: DataFrame, id_col: str, role: Column) -> DataFrame:
    """One row for each cell: (id_col, start, at, _key, place, role, value), the role by ``role`` of the normalised headers; cells without role or number are left out."""
    heads = F.slice("headers", 2, F.greatest(F.size("headers") - 1, F.lit(0)))
    roles = F.transform(heads, lambda h: role(normalised_label(h)))
    cells = rows.select(id_col, "start", "at", "_key", F.posexplode(F.arrays_zip(roles.alias("role"), F.col("values").alias("cell"))).alias("place", "z"))
    return cells.select(id_col, "start", "at", "_key", "place", "z.role", cell_number(F.col("z.cell")).alias("value")).where("role IS NOT NULL AND value IS NOT NULL")


def _first_claims(cells: DataFrame, id_col: str) -> DataFrame:
    """The first value in the text of each field."""
    return cells.groupBy(id_col, "field").agg(F.min_by("value", F.struct("start", "at", "place")).alias("value"))


def school_units(rows: DataFrame, id_col: str, fields: DataFrame) -> DataFrame:
    """Units of each subject, required and recommended, from tables with two or more of the hallmark subjects.

    A column headed by units alone is the required one if it is the first that counts.
    ``fields`` has (category, question, field) with the category ``Required`` or ``Recommended``.
    """
    label = normalised_label(F.col("label"))
    table = Window.partitionBy(id_col, "start")
    marked = rows.withColumns({"_key": _first_key(label, list(SUBJECTS)), "_hits": F.sum(_first_key(label, HALLMARKS).isNotNull().cast("int")).over(table)}).where("_hits >= 2 AND _key IS NOT NULL")
    kind = lambda h: F.when(h.contains("required"), "Required").when(h.contains("recommend"), "Recommended").when(h.contains("units"), "Units")
    names = F.transform(F.slice("headers", 2, F.greatest(F.size("headers") - 1, F.lit(0))), lambda h: kind(normalised_label(h)))
    first = F.try_element_at(F.filter(names, lambda x: x.isNotNull()), F.lit(1))
    cells = _cells_by_head(marked.withColumn("_first", first), id_col, kind)
    opening = marked.select(id_col, "at", F.array_position(names, F.lit("Units")).alias("_units"), first.alias("_first"))
    cells = cells.join(opening, [id_col, "at"]).where("role <> 'Units' OR (_first = 'Units' AND place + 1 = _units)")
    question = F.element_at(F.create_map(*[F.lit(x) for item in SUBJECTS.items() for x in item]), F.col("_key"))
    cells = cells.withColumns({"category": F.when(F.col("role") == "Units", "Required").otherwise(F.col("role")), "_q": normalised_label(question)})
    known = fields.select("category", normalised_label(F.col("question")).alias("_q"), "field")
    return _first_claims(cells.join(known, ["category", "_q"]), id_col)


def participation(rows: DataFrame, id_col: str) -> DataFrame:
    """shares and ages of first-year students and of all; a row whose label holds two of the table's rows is left out."""
    label = normalised_label(F.col("label"))
    heads = _joined(F.col("headers"))
    table = Window.partitionBy(id_col, "start")
    sign = label.rlike("percent who are from out of state|percent who live in college|average age")
    hits = reduce(lambda out, k: out + label.contains(k).cast("int"), PARTICIPATION, F.lit(0))
    there = rows.where(heads.contains("first time") & heads.contains("undergraduate")).withColumns({"_key": F.when(hits == 1, _first_key(label, list(PARTICIPATION))), "_sign": F.max(sign).over(table)})
    cells = _cells_by_head(there.where("_sign AND _key IS NOT NULL"), id_col, lambda h: F.when(h.contains("first"), "first").when(h.contains("undergraduate"), "all"))
    field = F.create_map(*[F.lit(x) for k, (a, b) in PARTICIPATION.items() for x in (f"{k}|first", a, f"{k}|all", b)])
    return _first_claims(cells.withColumn("field", F.element_at(field, F.concat_ws("|", "_key", "role"))), id_col)


def faculty_counts(rows: DataFrame, id_col: str, letters: str = "ABCDEFGHIJ", bases: Mapping[str, int] | None = None) -> DataFrame:
    """Full-time, part-time and total counts of the rows that are named by a letter, from tables with five or more of them."""
    bases = bases or {"full time": 101, "part time": 111, "total": 121}
    letter = F.trim("label")
    table = Window.partitionBy(id_col, "start")
    known = letter.isin(*letters)
    heads = _joined(F.col("headers"))
    there = rows.where(heads.contains("full time") & heads.contains("part time")).withColumn("_n", F.sum(known.cast("int")).over(table))
    role = lambda h: F.when(h == "full time", "full time").when(h == "part time", "part time").when(h.contains("total"), "total")
    cells = _cells_by_head(there.where((F.col("_n") >= 5) & known).withColumn("_key", letter), id_col, role)
    base = F.element_at(F.create_map(*[F.lit(x) for item in bases.items() for x in item]), F.col("role"))
    return _first_claims(cells.withColumn("field", F.concat(F.lit("I."), (base + F.instr(F.lit(letters), F.col("_key")) - 1).cast("string"))), id_col)


def faculty_ratio(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The ratio, students and faculty within 400 characters of each mention of the ratio; the first mention with a ratio or with ``based on`` that has a field gives it."""
    docs = spread(docs.select(id_col, text_col), id_col)
    windows = F.regexp_extract_all(F.col(text_col), F.lit("(?is)(?=(student\\s+to\\s+faculty\\s+ratio.{0,400}))"), 1)

    def answers(window: Column) -> Column:
        flat = compact(F.left(window, F.lit(400)))
        ratio = F.coalesce(found(flat, "(?i)student\\s+to\\s+faculty\\s+ratio\\s*:?\\s*(\\d{1,3}(?:\\.\\d+)?)\\s*(?:to|:)\\s*1\\b"), found(flat, "(?i)student\\s+to\\s+faculty\\s+ratio\\s*:?\\s*(\\d{1,3}(?:\\.\\d+)?)\\s*to\\b"))
        students = F.coalesce(found(flat, "(?i)\\bbased\\s+on\\s+(\\d[\\d,]*)\\s+students?\\b"), found(flat, "(?i)\\b(\\d[\\d,]*)\\s+students?\\b"))
        faculty = F.coalesce(found(flat, "(?i)\\band\\s+(\\d[\\d,]*)\\s+faculty\\b"), found(flat, "(?i)\\b(\\d[\\d,]*)\\s+faculty\\b"))
        counts = ratio.isNotNull() | flat.rlike("(?i)\\bbased\\s+on\\b")
        return F.struct(*[F.when(counts, cell_number(v)).alias(n) for n, v in (("ratio", ratio), ("students", students), ("faculty", faculty))])

    rows = docs.select(id_col, F.transform(windows, answers).alias("_found"))

    def first(name: str) -> Column:
        return F.try_element_at(F.filter(F.transform("_found", lambda a: a[name]), lambda v: v.isNotNull()), F.lit(1))

    return claimed(rows, id_col, {"I.201": first("ratio"), "I.202": first("students"), "I.203": first("faculty")})


def grade_average(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The average grade beside, before or at the end of the line of its question, or after it over several lines; and the share that submitted one."""
    block = F.regexp_extract(F.col(text_col), f"(?is)(.{{0,100}}{GPA}.*?)(?:C13\\b|\\z)", 1)
    docs = spread(docs.select(id_col, text_col), id_col).select(id_col, block.alias("_block"))
    block, grade = F.col("_block"), "[0-4](?:\\.\\d{1,2})?"
    average = F.coalesce(
        found(block, f"(?i)students who submitted GPA:\\s*({grade})\\b"),
        found(block, "(?i)\\b([0-4]\\.\\d{1,2})\\s*Average high school GPA"),
        found(block, f"(?im)^.*Average high school GPA.*?\\b({grade})\\s*$"),
        found(compact(block), f"(?i){GPA},\\s*first-time,\\s*first-year students who submitted(?: high school)?(?: GPA)?\\s*:?\\s*({grade})\\b"),
    )
    near = F.regexp_extract(block, f"(?is){SUBMITTED} high(.{{0,250}})", 1)
    share = F.coalesce(found(near, "\\b(\\d+(?:\\.\\d+)?)\\s*%"), found(compact(block), f"(?i){SUBMITTED}(?: high school)?(?: GPA)?\\s*:?\\s*(\\d+(?:\\.\\d+)?)\\s*%"))
    return claimed(docs, id_col, {"C.1201": average, "C.1202": share})


def application_policies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fee, amount, waivers, closing date and priority date, by columns of marks first and by words behind the question else."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = spread(docs.select(id_col, text_col), id_col)
    docs = docs.select(id_col, text.alias("_text"), between(text, "C13\\.?\\s+Application Fee", "C14\\.?\\b").alias("_fee"), between(text, "C14\\.?\\s+Application closing date", "C15\\.?\\b").alias("_closing"))
    docs = docs.withColumn("_dates", F.when(F.col("_closing") != "", F.col("_closing")).otherwise(F.col("_text")))
    text, fee, dates = F.col("_text"), F.col("_fee"), F.col("_dates")
    docs = docs.withColumns({"_fee_flat": compact(fee), "_dates_flat": compact(dates)})
    date = "\\d{1,2}/\\d{1,2}|\\d{1,2}-[A-Za-z]{3,4}|[A-Za-z]{3,9}-\\d{1,2}|[A-Za-z]{3,9}\\s+\\d{1,2}(?:,\\s*[^|]+)?"
    docs = docs.withColumns({
        "_fee_said": joined_answers(F.col("_fee_flat")), "_closes": after_label(F.col("_dates_flat"), "Application closing date \\(fall\\)", date), "_priority": after_label(F.col("_dates_flat"), "Priority Date", date),
    })
    said, closing, priority = F.col("_fee_said"), month_and_day(F.col("_closes")), month_and_day(F.col("_priority"))
    same = text.rlike("(?i)(?:^|\\n)\\s*(?:-\\s*\\[\\s*\\]\\s*)?x\\s+Same fee\\b") | fee.rlike("(?i)\\bSame fee\\b\\s*(?:\\|\\s*)?x\\b")
    return claimed(docs, id_col, {
        "C.1301": F.when(fee != "", F.coalesce(yes_no_columns(fee, FEE), yes_no_after(said, FEE))),
        "C.1302": cell_number(after_label(F.col("_fee_flat"), "Amount of application fee:\\s*\\$?", "\\d[\\d,]*")),
        "C.1303": F.when(text.rlike(f"(?is){WAIVED}.{{0,200}}\\bx\\b"), "Yes").otherwise(yes_no_after(said, WAIVED)),
        "C.1304": F.when(same, "X"),
        "C.1305": F.coalesce(yes_no_columns(text, ONLINE), yes_no_after(said, f"{ONLINE}(?: with(?: financial need)?)?")),
        "C.1401": F.coalesce(yes_no_columns(dates, CLOSING), yes_no_after(joined_answers(F.col("_dates_flat")), CLOSING)),
        "C.1402": closing[0], "C.1403": closing[1], "C.1404": priority[0], "C.1405": priority[1],
    })


def marked_lines(block: Column) -> Column:
    """The lines of a block that have a mark: (line, low, label, boxed), ``boxed`` if a box in it is ticked."""
    lines = F.filter(F.split(block, "\\r?\\n"), lambda x: x.rlike("[xX✔☒✓]"))
    return F.transform(lines, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low"), normalised_label(x).alias("label"), x.rlike("\\[[xX]\\]").alias("boxed")))


def option_marked(marked: Column, names: Sequence[str]) -> Column:
    """Whether one of ``marked_lines`` names an option behind its mark: the mark within 20 characters before the option's first word, a ticked box in the line, or a mark and a blank before that word."""
    def said(x: Column) -> Column:
        out = F.lit(False)
        for name in names:
            word = name.split()[0]
            at = F.instr(x["low"], word.lower())
            before = F.left(x["line"], F.when(at > 0, at).otherwise(F.length(x["line"])) - 1)
            quoted = "\\Q" + word + "\\E"
            close = x["boxed"] | F.right(before, F.lit(20)).rlike("[xX✔☒✓]") | x["line"].rlike(f"(?i)[xX✔☒✓]\\s+.*{quoted}")
            out = out | (x["label"].contains(normalised_label(F.lit(name))) & close)
        return out

    return F.exists(marked, said)


def marked_options(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """An X for each option that is marked in its section, and what is written behind other options."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = spread(docs.select(id_col, text_col), id_col).select(
        id_col, between(text, "E\\.\\s*ACADEMIC\\s+OFFERINGS\\s+AND\\s+POLICIES|E1\\b", "F\\.\\s*STUDENT\\s+LIFE|CDS-E").alias("_offers"),
        between(text, "F\\.\\s*STUDENT LIFE|F1\\b|F3\\b|F4\\b", "G\\.\\s*ANNUAL EXPENSES|CDS-G").alias("_all_life"),
    )
    offers, life = F.col("_offers"), F.col("_all_life")
    docs = docs.select(id_col, between(offers, "E1\\b|Special study options", "E2\\b|E3\\b").alias("_study"), between(offers, "E3\\b|Areas in which").alias("_areas"), between(life, "F2\\b|Activities offered", "F3\\b").alias("_life"),
                       between(life, "F4\\b|Housing:", "CDS-F|G1\\b|G\\.\\s*ANNUAL EXPENSES").alias("_housing"))
    kinds = (("_study", STUDY_OPTIONS), ("_areas", AREAS), ("_life", ACTIVITIES))
    docs = docs.withColumns({f"{block}_marked": marked_lines(F.col(block)) for block, _ in kinds})
    fields = {f: F.when(option_marked(F.col(f"{block}_marked"), names), "X") for block, options in kinds for f, names in options.items()}
    study, areas, alone = F.col("_study"), F.col("_areas"), "(?i)(?:^|\\n)\\s*(?:-\\s*\\[\\s*\\]\\s*)?x\\s+"
    fields["E.117"] = F.coalesce(fields["E.117"], F.when(study.rlike("(?i)(?:^|\\n)\\s*x\\s+Undergraduate Research\\b"), "X"))
    for block, kind, mark, words in ((study, "specify", "E.119", "E.120"), (areas, "describe", "E.313", "E.314")):
        marked = block.rlike(f"{alone}Other \\({kind}\\):")
        fields[mark] = F.when(marked, "X")
        fields[words] = F.when(marked, F.nullif(F.trim(F.regexp_extract(block, f"(?i)Other \\({kind}\\):\\s*\\n\\s*([^\\n]+)", 1)), F.lit("")))
    fields["F.401"] = F.when(F.col("_housing").rlike(f"{alone}Coed dorms\\b"), "X")
    return claimed(docs, id_col, fields)
