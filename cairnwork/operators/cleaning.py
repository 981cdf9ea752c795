"""The whole reading of a filled form: answers by direct ids, a map of labels, score tables, lines, anchors in the text and section resolvers, first claim first.

Every reader makes claims ``(id_col, field, value, start, at)`` of its own; ``clean`` puts them in order. Tables are read and written once for all
readers; what reads the text itself stays inside the row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.functions.parsing import normalised_label, question_number
from cairnwork.operators.forms import SCORE_BOUNDS, cell_number, cleaned, pipe_tables, score_percentiles
from cairnwork.operators.lines import spread
from cairnwork.storage import materialize

VALUE = "(?i)(?:^|\\s)([xyn]|-?\\$?\\d[\\d,]*(?:\\.\\d+)?%?|\\d{1,2}-[a-z]{3,9})\\s*$"
TAIL = "(?i)^(?:[xyn]|-?\\$?\\d[\\d,]*(?:\\.\\d+)?%?|\\d{1,2}-[a-z]{3,9})$|^https?://"
NUMBER = "^-?\\$?\\d[\\d,]*(?:\\.\\d+)?%?$"
#: The first score field of a test in threes, by which a direct answer in a score field is judged.
SCORES = (("sat composite", 905, 907), ("sat", 908, 913), ("act", 914, 922))
WINDOW = 300


def direct_answers(rows: DataFrame, id_col: str, fields: DataFrame) -> DataFrame:
    """Claims of table rows that begin with a question number: the cell under a header of response or answer, else the last filled cell after the prompt.

    ``fields`` has the known ``field`` ids.
    """
    heads = F.slice("headers", 2, F.greatest(F.size("headers") - 1, F.lit(0)))
    paired = F.arrays_zip(F.transform(heads, lambda h: F.lower(F.trim(h))).alias("head"), F.transform("values", lambda v: F.trim(v)).alias("cell"))
    named = F.filter(paired, lambda z: (z["head"].contains("response") | z["head"].contains("answer")) & (F.coalesce(z["cell"], F.lit("")) != ""))
    after = F.when(F.size("values") > 1, F.slice("values", 2, F.greatest(F.size("values") - 1, F.lit(0)))).otherwise(F.col("values"))
    filled = F.filter(F.transform(after, lambda v: F.trim(v)), lambda v: v != "")
    value = F.coalesce(F.try_element_at(named, F.lit(1))["cell"], F.try_element_at(filled, F.lit(-1)))
    made = rows.select(id_col, question_number(F.col("label")).alias("field"), value.alias("value"), "start", "at").where("field IS NOT NULL AND value IS NOT NULL")
    return made.join(fields.select("field").distinct(), "field", "left_semi").select(id_col, "field", "value", "start", "at")


def mapped_answers(rows: DataFrame, id_col: str, labels: Sequence[tuple[str, str, int | str]]) -> DataFrame:
    """Claims of rows whose label holds a phrase: (phrase, field, column), the column by its place from 0 or by a phrase of its header, full-time ones first.

    A label that holds several phrases answers the field of each; only numbers count.
    """
    label = normalised_label(F.col("label"))
    heads = F.transform(F.slice("headers", 2, F.greatest(F.size("headers") - 1, F.lit(0))), lambda h: normalised_label(h))
    entries = F.array(*[F.struct(normalised_label(F.lit(p)).alias("phrase"), F.lit(f).alias("field"), F.lit(c if isinstance(c, int) else None).cast("int").alias("place"), normalised_label(F.lit(c if isinstance(c, str) else None).cast("string")).alias("head")) for p, f, c in labels])
    named = rows.withColumns({"_label": label, "_cells": F.arrays_zip(heads.alias("head"), F.col("values").alias("cell"))})

    def answer(e: Column) -> Column:
        under = F.filter("_cells", lambda z: F.coalesce(z["head"].contains(e["head"]), F.lit(False)) & z["cell"].isNotNull())
        full = F.filter(under, lambda z: z["head"].contains("full"))
        cell = F.coalesce(F.try_element_at(full, F.lit(1))["cell"], F.try_element_at(under, F.lit(1))["cell"])
        text = F.when(e["place"].isNotNull(), F.get("values", e["place"])).otherwise(cell)
        return F.struct(e["field"].alias("field"), cell_number(text).alias("value"))

    hits = F.filter(entries, lambda e: F.col("_label").contains(e["phrase"]))
    made = named.select(id_col, "start", "at", F.inline(F.transform(hits, answer)))
    return made.where("value IS NOT NULL").select(id_col, "field", "value", "start", "at")


def table_scores(rows: DataFrame, id_col: str) -> DataFrame:
    """Claims of percentile tables; rows with a range such as 700-800 or with a field of the score distribution are left out."""
    text = F.concat_ws(" ", "label", "values")
    plain = rows.where(~text.rlike("\\b\\d+\\s*[-–—]\\s*\\d+\\b") & ~text.rlike("(?i)\\bC\\.?\\s*9(?:2[3-9]|[3-5]\\d)\\b"))
    return score_percentiles(plain, id_col)


def _plausible(field: Column, value: Column) -> Column:
    """Whether a value may stand in its field: scores within their test's bounds, everything elsewhere."""
    number, out = F.regexp_extract(field, "^C\\.(9\\d\\d)$", 1).try_cast("int"), F.lit(True)
    bounds = {name: (low, high) for name, low, high in SCORE_BOUNDS}
    for test, first, last in SCORES:
        low, high = bounds[test]
        out = F.when(number.between(first, last), F.coalesce(value.try_cast("double").between(low, high), F.lit(False))).otherwise(out)
    return out


def line_answers(docs: DataFrame, id_col: str, text_col: str, fields: DataFrame) -> DataFrame:
    """Claims of lines that begin with a question number and end with an answer: what looks like one after the last colon, else the last word if it does.

    Numbers lose their commas and dollar signs; scores out of their bounds are left out.
    """
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\\r?\\n")).alias("at", "line")).where(F.col("line").rlike("(?i)^\\s*[A-J]\\.?\\d{1,3}[A-Z]?\\b\\s+\\S"))
    number = F.regexp_extract("line", "(?i)^\\s*([A-J]\\.?\\d{1,3}[A-Z]?)\\b", 1)
    rest = F.trim(F.regexp_extract("line", "(?i)^\\s*[A-J]\\.?\\d{1,3}[A-Z]?\\b\\s+(.*)$", 1))
    tail = F.trim(F.substring_index(rest, ":", -1))
    raw = F.when(rest.contains(":") & tail.rlike(TAIL), tail).otherwise(F.nullif(F.regexp_extract(rest, VALUE, 1), F.lit("")))
    value = F.when(raw.rlike(NUMBER), F.regexp_replace(raw, "[,$]", "")).otherwise(raw)
    made = lines.select(id_col, question_number(number).alias("field"), value.alias("value"), F.lit(0).alias("start"), "at").where("field IS NOT NULL AND value IS NOT NULL")
    known = made.join(fields.select("field").distinct(), "field", "left_semi")
    return known.where(_plausible(F.col("field"), F.col("value"))).select(id_col, "field", "value", "start", "at")


def anchored_answers(docs: DataFrame, id_col: str, text_col: str, anchors: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Claims of (anchor, value, field): the value's pattern in the WINDOW characters after the anchor's first match, both ignoring case.

    The value's pattern has one group. Of two entries for a field the first that finds something counts.
    """
    found = []
    for i, (anchor, value, field) in enumerate(anchors):
        window = F.regexp_extract(text_col, f"(?is)(?:{anchor})(.{{0,{WINDOW}}})", 1)
        found.append(F.struct(F.lit(field).alias("field"), F.nullif(F.regexp_extract(window, f"(?i){value}", 1), F.lit("")).alias("value"), F.lit(i).alias("at")))
    made = docs.select(id_col, F.inline(F.filter(F.array(*found), lambda x: x["value"].isNotNull())))
    return made.select(id_col, "field", "value", F.lit(0).alias("start"), "at")


Resolver = Callable[[DataFrame, DataFrame], DataFrame]


def clean(docs: DataFrame, id_col: str, text_col: str, fields: DataFrame, labels: Sequence[tuple[str, str, int | str]] = (), anchors: Sequence[tuple[str, str, str]] = (), resolvers: Sequence[Resolver] = (), overriding: str | None = None) -> DataFrame:
    """``(id_col, field, value, source)``: one answer for each field of each text.

    Tables come first, row by row (in a row the direct id, then the map of labels, then scores), then lines, then
    anchors, then ``resolvers`` in their order, which take the texts and their table rows. Fields that match ``overriding`` are taken from the
    last reader that has them. ``source`` is 0 for tables, 1 for lines, 2 for anchors and 3 on for resolvers. Null texts have no answers.
    """
    docs = spread(docs.select(id_col, text_col), id_col)
    rows = spread(materialize(pipe_tables(docs, id_col, text_col), "rows"), id_col)
    readers = [direct_answers(rows, id_col, fields), *([mapped_answers(rows, id_col, labels)] if labels else []), table_scores(rows, id_col)]
    tables = readers[0].withColumn("at", F.col("at") * len(readers))
    for i, claims in enumerate(readers[1:], 1):
        tables = tables.unionByName(claims.withColumn("at", F.col("at") * len(readers) + i))
    others = [line_answers(docs, id_col, text_col, fields), *([anchored_answers(docs, id_col, text_col, anchors)] if anchors else [docs.select(id_col, F.lit("").alias("field"), F.lit("").alias("value"), F.lit(0).alias("start"), F.lit(0).alias("at")).where(F.lit(False))])]
    for resolver in resolvers:
        claims = resolver(docs, rows)
        others.append(claims if "at" in claims.columns else claims.withColumns({"start": F.lit(0), "at": F.lit(0)}))
    every = [c.select(id_col, "field", "value", F.col("start").cast("int").alias("start"), F.col("at").cast("int").alias("at")) for c in (tables, *others)]
    return cleaned(every, id_col, overriding)
