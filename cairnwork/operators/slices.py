"""Subsections of long texts: competing spans of lines for each wanted code, the best of them chosen.

Everything about a text is an expression over its own row: no line is shuffled, and a text costs
memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes of a form's subsections in their order, phrases that open a subsection whose code is missing, and the names of the strategies by rank.
CODES = tuple(
    f"{section}{number}"
    for section, numbers in (("B", (1, 2, 3, 4, 5, 22)), ("C", range(1, 23)), ("D", range(1, 17)), ("G", range(1, 7)), ("H", range(1, 11)), ("I", range(1, 4)), ("J", range(1, 4)))
    for number in numbers
)
PHRASES = {
    "C11": ("distribution of high school gpa", "high school grade point average"),
    "C13": ("application fee",),
    "C14": ("application closing date",),
    "C15": ("accepted for terms other than the fall",),
    "C16": ("notification to applicants of admission decision sent",),
    "C17": ("reply policy for admitted applicants",),
    "C18": ("deferred admission",),
    "C19": ("early admission of high school students",),
    "C21": ("early decision",),
    "C22": ("early action",),
    "D2": ("number of students who applied, were admitted, and enrolled as degree-seeking transfer",),
    "D13": ("maximum number of credits or courses that may be transferred from a two-year",),
    "D14": ("maximum number of credits or courses that may be transferred from a four-year",),
    "D15": ("transfers must complete at your institution to earn an associate degree",),
    "D16": ("transfers must complete at your institution to earn a bachelor",),
    "G5": ("provide the estimated expenses for a typical full-time undergraduate",),
    "H5": ("percent of students in class", "borrowing from federal, non-federal"),
    "H6": ("institutional scholarship and grant aid for undergraduate degree-seeking nonresidents",),
    "H7": ("financial aid forms nonresident first-year financial aid applicants",),
    "H8": ("financial aid forms domestic first-year financial aid applicants",),
}
STRATEGIES = ("h2_code", "h3_code", "bullet_code", "bold_code", "anchor_phrase", "bounded_window", "unresolved")
SPAN, WINDOW_SPAN, WINDOW_BELOW = 200, 400, 250

#: A line's code: the first word behind signs of headings, lists and bold letters, before a blank, a point, a colon or the end.
HEAD = "^\\s*(?:### \\s*)?(?:## \\s*)?(?:# \\s*)?(?:- \\s*)?(?:\\* \\s*)?(?:\\*\\*)?\\s*([A-Za-z]\\d+)(?=\\s*[.:]|\\s|$)"


def _style(line: Column) -> Column:
    """The place of a code line's style in STRATEGIES; lines without a sign count as list items."""
    bare = F.ltrim(line)
    return F.when(bare.startswith("## "), 0).when(bare.startswith("### "), 1).when(bare.startswith("**"), 3).otherwise(2)


def _marks(lines: Column, places: Column) -> Column:
    """Array of (at, code, place, style): the lines that begin with a known code."""
    heads = F.transform(lines, lambda line, at: F.struct(at.alias("at"), F.upper(F.regexp_extract(line, HEAD, 1)).alias("code"), _style(line).alias("style")))
    placed = F.transform(heads, lambda m: F.struct(m["at"].alias("at"), m["code"].alias("code"), F.try_element_at(places, m["code"]).alias("place"), m["style"].alias("style")))
    return F.filter(placed, lambda m: m["place"].isNotNull())


def _line_of(text: Column, phrase: Column) -> Column:
    """The number of the first line that holds a phrase without line breaks, null if none does."""
    at = F.instr(text, phrase)
    before = F.substring(text, F.lit(1), at)
    return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))))


def slices(docs: DataFrame, id_col: str, text_col: str, wanted: Sequence[str], codes: Sequence[str] = CODES, phrases: Mapping[str, Sequence[str]] = PHRASES) -> DataFrame:
    """``(id_col, code, strategy, rank, start, stop, text)``: for each text and wanted code the span of lines [start, stop) of the strategy that ranks first.

    Lines that begin with the code come first, by their style and then their place; else the first
    line that holds one of the code's phrases; else, as a window, the first line of the nearest code
    before it in ``codes`` that the text has. A span ends at the next line that begins with a later
    code, at most SPAN lines on (a window WINDOW_SPAN, and it must be under WINDOW_BELOW lines), and
    at the end of the text. A code that nothing finds is ``unresolved``, with nulls and an
    empty text; so is every code of a null text. Codes are a letter and a number.
    """
    unknown = [c for c in wanted if c not in codes]
    if unknown:
        raise ValueError(f"not among the codes: {', '.join(unknown)}")
    place = {c: i for i, c in enumerate(codes)}
    places = F.create_map(*[F.lit(x) for item in place.items() for x in item])
    specs = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(place[c]).alias("place"), F.array(*map(F.lit, phrases.get(c, ()))).cast("array<string>").alias("phrases")) for c in wanted])
    rows = docs.select(F.col(id_col), F.split(F.col(text_col), "\n").alias("_lines"), F.lower(F.col(text_col)).alias("_low"))
    rows = rows.withColumn("_marks", _marks(F.col("_lines"), places)).withColumn("_specs", specs)

    def proposed(s: Column) -> Column:
        own = F.array_min(F.transform(F.filter("_marks", lambda m: m["code"] == s["code"]), lambda m: F.struct(m["style"].alias("rank"), m["at"].alias("start"))))
        phrase = F.array_min(F.transform(s["phrases"], lambda p: _line_of(F.col("_low"), p)))
        before = F.array_min(F.transform(F.filter("_marks", lambda m: m["place"] < s["place"]), lambda m: F.struct((-m["place"]).alias("back"), m["at"].alias("start"))))
        best = F.coalesce(own, F.when(phrase.isNotNull(), F.struct(F.lit(4).alias("rank"), phrase.alias("start"))), F.when(before.isNotNull(), F.struct(F.lit(5).alias("rank"), before["start"].alias("start"))))
        return F.struct(s["code"].alias("code"), s["place"].alias("place"), best["rank"].alias("rank"), best["start"].alias("start"))

    def bounded(c: Column) -> Column:
        most = c["start"] + F.when(c["rank"] == 5, WINDOW_SPAN).otherwise(SPAN)
        later = F.array_min(F.transform(F.filter("_marks", lambda m: (m["at"] > c["start"]) & (m["at"] < most) & (m["place"] > c["place"])), lambda m: m["at"]))
        stop = F.least(F.coalesce(later, most), F.size("_lines"))
        return F.struct(c["code"].alias("code"), c["rank"].alias("rank"), c["start"].alias("start"), F.when(c["start"].isNotNull(), stop).alias("stop"))

    rows = rows.select(id_col, "_lines", "_marks", F.transform("_specs", proposed).alias("_proposed"))
    rows = rows.select(id_col, "_lines", F.inline(F.transform("_proposed", bounded)))
    found = F.col("start").isNotNull() & ((F.col("rank") < 5) | (F.col("stop") - F.col("start") < WINDOW_BELOW))
    rank = F.when(found, F.col("rank")).otherwise(len(STRATEGIES) - 1)
    return rows.select(
        id_col, "code", F.element_at(F.array(*map(F.lit, STRATEGIES)), rank + 1).alias("strategy"), rank.alias("rank"), F.when(found, F.col("start")).alias("start"), F.when(found, F.col("stop")).alias("stop"),
        F.when(found, F.array_join(F.slice("_lines", F.col("start") + 1, F.col("stop") - F.col("start")), "\n")).otherwise("").alias("text"),
    )
