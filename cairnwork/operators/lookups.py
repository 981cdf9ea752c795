"""Lookups: normalised labels, name agreement, crosswalks with redirects, two-hop maps, companions, and checks against expectations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwork.functions.parsing import numbers_match

# Labels of the coverage states.
COVERAGE_LABELS = {
    "cds_available_current": "CDS available", "cds_available_stale": "Older CDS available", "cds_found_processing": "CDS found; processing",
    "latest_found_extract_failed_with_prior_available": "Latest CDS needs review; older CDS available", "extract_failed": "CDS found; extraction needs review",
    "source_not_automatically_accessible": "Source could not be accessed automatically", "no_public_cds_found": "No public CDS found",
    "verified_absent": "CDS not published or not applicable", "not_checked": "Not checked yet", "out_of_scope": "Out of scope",
}


def mapped(key: Column, values: Mapping) -> Column:
    """The value of a small fixed map; null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def with_labels(rows: DataFrame, labels: DataFrame, keys: Sequence[str], label: str, name: str = "label") -> DataFrame:
    """``rows`` with the label of their keys, which match trimmed and in upper case; of several labels of one key the least."""

    def norm(c: str) -> Column:
        return F.upper(F.trim(F.col(c).cast("string")))

    known = labels.select(*[norm(k).alias(f"_{k}") for k in keys], F.col(label).alias("_label")).groupBy(*[f"_{k}" for k in keys]).agg(F.min("_label").alias(name))
    marked = rows.withColumns({f"_{k}": norm(k) for k in keys})
    return marked.join(known, [f"_{k}" for k in keys], "left").drop(*[f"_{k}" for k in keys])


def name_agreement(own: Column, official: Column) -> Column:
    """EXACT, EXACT (suffix-stripped) without what follows a comma or hyphen of the official name, PARTIAL if one holds the other, else MISMATCH; NOT_FOUND without an official name."""
    a, b = F.lower(F.trim(own)), F.lower(F.trim(official))
    stem = F.trim(F.substring_index(F.substring_index(b, ",", 1), "-", 1))
    held = b.contains(a) | a.contains(b)
    return F.when(official.isNull(), "NOT_FOUND").when(b == "", "MISMATCH").when(a == b, "EXACT").when(a == stem, "EXACT (suffix-stripped)").when(held, "PARTIAL").otherwise("MISMATCH")


def canonicalised(rows: DataFrame, crosswalk: DataFrame, id_col: str, official: str, name: str, scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with canonical names, redirects).

    ``crosswalk`` has (official, canonical), one canonical name for each official id. A row under
    another name is renamed if it is the only candidate for its canonical name in its ``scope``
    (columns that compare with null as a value) and no row stands there yet. Every name that
    isn't canonical gives a redirect (official, canonical, alias), whether its rows were renamed or not.
    """
    known = crosswalk.select(F.col(official), F.col("canonical").alias("_canonical"))
    moved = rows.join(known, official).where(F.col(name) != F.col("_canonical"))
    place = Window.partitionBy("_canonical", *scope)
    single = moved.withColumn("_n", F.count("*").over(place)).where("_n = 1")
    taken = rows.select(F.col(name).alias("_canonical"), *[F.col(c).alias(f"_t_{c}") for c in scope])
    free = single.join(taken, [single["_canonical"] == taken["_canonical"], *[F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in scope]], "left_anti")
    renamed = rows.join(free.select(id_col, "_canonical"), id_col, "left").withColumn(name, F.coalesce("_canonical", name)).select(*rows.columns)
    redirects = moved.select(official, F.col("_canonical").alias("canonical"), F.col(name).alias("alias")).distinct()
    return renamed, redirects


def by_prefix(rows: DataFrame, points: DataFrame, code: str, prefix: str, width: int = 3) -> DataFrame:
    """``rows`` with the columns of the point whose prefix a five-digit code starts with; null for other codes and unknown prefixes."""
    head = F.when(F.trim(code).rlike("^\\d{5}$"), F.substring(F.trim(code), 1, width))
    return rows.withColumn("_head", head).join(points.withColumnRenamed(prefix, "_head"), "_head", "left").drop("_head")


def fan_out(left: DataFrame, right: DataFrame, key: str, kept: Column) -> DataFrame:
    """``left`` with every match on a key that isn't unique, rows without a match too, of which those stay where ``kept`` holds."""
    return left.join(right, key, "left").where(kept)


def with_companion(values: DataFrame, keys: Sequence[str], metric: str, value: str, pairs: Mapping[str, str]) -> DataFrame:
    """(keys, metric, value, companion, companion_value) of the metrics in ``pairs``; the companion's value is null where it isn't given."""
    names = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    own = values.where(F.col(metric).isin(*pairs)).select(*keys, metric, value, F.element_at(names, F.col(metric)).alias("companion"))
    other = values.where(F.col(metric).isin(*set(pairs.values()))).select(*keys, F.col(metric).alias("companion"), F.col(value).alias("companion_value"))
    return own.join(other, [*keys, "companion"], "left").select(*keys, metric, value, "companion", "companion_value")


def checked(expected: DataFrame, id_map: DataFrame, output: DataFrame) -> DataFrame:
    """Expected values against an output, two hops away: (id, expected, critical, field, actual, match, reason).

    ``expected`` has (id, expected, critical), ``id_map`` (id, field) and ``output`` (field, actual).
    """
    rows = expected.join(id_map, "id", "left").join(output, "field", "left")
    same = F.coalesce(numbers_match(F.col("expected"), F.col("actual")), F.lit(False))
    reason = F.when(F.col("field").isNull(), "no id map entry").when(F.col("actual").isNull(), "not in output").when(~same, "value mismatch")
    return rows.select("id", "expected", "critical", "field", "actual", same.alias("match"), reason.alias("reason"))


def accuracy(results: DataFrame, *keys: str) -> DataFrame:
    """Totals, matches and percentages of ``checked`` rows, all and critical ones; 0 percent of nothing."""

    def share(n: Column, of: Column) -> Column:
        return F.when(of > 0, F.round(100 * n / of, 1)).otherwise(0.0)

    total, hits = F.count("*"), F.count_if("match")
    critical, critical_hits = F.count_if("critical"), F.count_if(F.col("critical") & F.col("match"))
    return results.groupBy(*keys).agg(
        total.alias("total"), hits.alias("matched"), share(hits, total).alias("pct"), critical.alias("critical"), critical_hits.alias("critical_matched"),
        share(critical_hits, critical).alias("critical_pct"), F.count_if(F.col("field").isNull()).alias("unmapped"),
    )


def search_text(*parts: Column) -> Column:
    """Lower-case text to search in: the parts with a blank between, null as empty."""
    return F.lower(reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.coalesce(p, F.lit("")) for p in parts]))


def coverage_summary(name: Column, status: Column, year: Column, walled: Column, note: Column) -> Column:
    """The paragraph that tells of a coverage state; ``walled`` says whether a newer source is behind a log-in."""
    # The sentences of each state.
    since = F.coalesce(F.concat(F.lit(" from "), year), F.lit(""))
    older = F.concat(F.lit("We have an older CDS for "), name, since)
    found = F.concat(F.lit("We found a possible CDS for "), name)
    return (
        F.when(status == "cds_available_current", F.concat(F.lit("We have a CDS for "), name, since, F.lit(".")))
        .when(
            status == "cds_available_stale",
            F.concat(older, F.when(walled, ". We found a possible newer source but it could not be accessed automatically.").otherwise("; we could not find a newer one in our latest scan.")),
        )
        .when(status == "cds_found_processing", F.concat(F.lit("We found a CDS for "), name, F.lit(" but our extraction has not yet completed.")))
        .when(status == "latest_found_extract_failed_with_prior_available", F.concat(older, F.lit("; the newer one we found could not be extracted automatically.")))
        .when(status == "extract_failed", F.concat(found, F.lit(" but our extraction failed and we have no older copy.")))
        .when(status == "source_not_automatically_accessible", F.concat(F.lit("We found a possible CDS source for "), name, F.lit(" but it could not be accessed automatically.")))
        .when(status == "no_public_cds_found", F.concat(F.lit("We could not find a public Common Data Set for "), name, F.lit(" in our latest scan.")))
        .when(status == "verified_absent", F.coalesce(note, F.concat(F.lit("We have no CDS for "), name, F.lit("; this school has not made one publicly available."))))
        .when(status == "not_checked", F.concat(name, F.lit(" is in our institution directory, but we have not completed a public CDS scan for it yet.")))
        .when(status == "out_of_scope", "")
    )


# Words of a fact's group and name, with the category that they put it into, in the order in which they are tried.
FACT_WORDS = (
    ("admissions", ("admission",)), ("cost", ("cost", "price", "tuition")), ("aid", ("aid", "loan", "pell")), ("outcomes", ("completion", "graduation", "outcome")), ("enrollment", ("enrollment",)),
)
MISALIGNED = ("near", "context_only", "not_cds_equivalent")


def fact_category(text: Column) -> Column:
    """The category of a fact by the words about it."""
    low = F.lower(text)
    return reduce(lambda out, x: F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in x[1]]), x[0]).otherwise(out), reversed(FACT_WORDS), F.lit("identity"))


def fact_flag(quality: Column, imputation: Column, alignment: Column, release: Column) -> Column:
    """What the public is told of a fact's quality: imputed, definition_mismatch, provisional, reported or not_available."""
    return (
        F.when((quality == "imputed") | (F.coalesce(imputation, F.lit("")) != ""), "imputed").when(alignment.isin(*MISALIGNED), "definition_mismatch")
        .when(release == "provisional", "provisional").when(quality == "reported", "reported").otherwise("not_available")
    )


def issue_list(issues: Sequence[tuple[Column, str]], none: str = "aligned") -> Column:
    """The names of all issues that hold, joined by commas; ``none`` if none does."""
    held = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for test, name in issues])), ",")
    return F.when(held == "", none).otherwise(held)


def unpivoted_facts(row: DataFrame, ids: Sequence[str], dictionary: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(ids, key, value, shown, flag): one row for each key of ``dictionary`` (column, kind) of every row, missing values too.

    Kinds are number, percent (above 1 counts as hundredths), money, boolean and string.
    """
    from cairnwork.functions.parsing import lenient_number, money_text, percent_text

    facts = []
    for key, (column, kind) in dictionary.items():
        text = F.col(column).cast("string")
        number = lenient_number(text)
        share = F.when(number > 1, number / 100).otherwise(number)
        shown = {
            "percent": percent_text(share), "money": money_text(number), "boolean": F.when(F.lower(text) == "true", "Yes").otherwise(F.when(text.isNotNull(), "No")), "string": text,
            "number": F.when(number == F.floor(number), F.format_number(number, 0)).otherwise(F.regexp_replace(F.format_number(F.round(number, 3), 3), "0+$", "")),
        }[kind]
        value = {"percent": share.cast("string"), "money": number.cast("string"), "number": number.cast("string"), "boolean": F.lower(text), "string": text}[kind]
        facts.append(F.struct(F.lit(key).alias("key"), value.alias("value"), F.coalesce(shown, F.lit("Not available")).alias("shown"), F.when(value.isNull(), "not_available").otherwise("reported").alias("flag")))
    return row.select(*ids, F.inline(F.array(*facts)))
