"""The life of extracted documents: routes, idempotency, quality, validation of suggested values, scoring, and what to extract again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwork.functions import parsing as P
from cairnwork.functions import scalars as X
from cairnwork.operators.lookups import mapped
from cairnwork.operators.picks import BAD_FLAGS, document_of_year

# The extractor for each format; fields that a filled section has, words that show the section, and words of two sections run together.
ROUTES = {"xlsx": "tier1", "pdf_fillable": "tier2", "docx": "tier3", "pdf_flat": "tier4", "pdf_scanned": "tier4", "html": "tier6"}
SECTION_FIELDS = (
    (("c1. first-time", "first-time, first-year student applicants", "first-time, first-year admission"), ("C.101", "C.102", "C.104", "C.105", "C.116", "C.117", "C.118", "C.119")),
    (("submitting sat scores", "c9. percent and number"), ("C.901", "C.902", "C.903", "C.904", "C.905", "C.906", "C.907", "C.914", "C.915", "C.916")),
)
RUNAWAY = ("instructionalfacultyandclasssize", "disciplinaryareasofdegreesconferred")


def routed(docs: DataFrame, fields_found: str = "form_fields") -> DataFrame:
    """``docs`` with ``route``: the extractor for the format; a fillable form without filled fields goes to the one for flat pages, unknown formats fail."""
    route = F.coalesce(mapped(F.col("source_format"), ROUTES), F.lit("failed"))
    empty_form = (route == "tier2") & (F.coalesce(fields_found, F.lit(0)) == 0)
    return docs.withColumn("route", F.when(empty_form, "tier4").otherwise(route))


def quality_flag(fields: Column, pages: Column, text: Column, found: Column, long_text: Column, least: int = 25) -> Column:
    """Why an extraction is weak, null if it isn't: hardly any fields, few for its pages, a section shown but not found, or a field that swallowed the next section.

    ``found`` is the array of fields found, ``long_text`` a field that is known to run on.
    """
    low, compact = F.lower(text), F.lower(F.regexp_replace(long_text, "\\s+", ""))
    shown = F.lit(False)
    for words, names in SECTION_FIELDS:
        there = F.lit(False)
        for w in words:
            there = there | low.contains(w)
        shown = shown | (there & ~F.arrays_overlap(found, F.array(*map(F.lit, names))))
    runaway = (F.length(long_text) > 5000) & (compact.contains(RUNAWAY[0]) | compact.contains(RUNAWAY[1]))
    return F.when(fields == 0, "blank_template").when(
        (fields < least) | ((pages >= 20) & (fields < 100)) | ((fields < 150) & F.coalesce(shown, F.lit(False))) | F.coalesce(runaway, F.lit(False)), "low_coverage"
    )


def to_extract(docs: DataFrame, artifacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The documents without a canonical artifact of the same ``keys`` (document, producer, version, schema and the source's checksum)."""
    made = artifacts.where("kind = 'canonical'").select(*keys).distinct()
    return docs.join(made, list(keys), "left_anti")


def on_current_bytes(docs: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``current``: whether a canonical artifact is as late as the first archive of the bytes that the document has now.

    False without a checksum, without a source artifact of it and without a canonical one. ``artifacts`` has (key, kind, sha, created_at).
    """
    sources = artifacts.where("kind = 'source'").groupBy(key, "sha").agg(F.min("created_at").alias("_archived"))
    latest = artifacts.where("kind = 'canonical'").groupBy(key).agg(F.max("created_at").alias("_made"))
    joined = docs.join(sources, [key, "sha"], "left").join(latest, key, "left")
    return joined.withColumn("current", F.coalesce(F.col("_made") >= F.col("_archived"), F.lit(False))).drop("_archived", "_made")


def archive_actions(fresh: DataFrame, stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """((key, action), the table after it) of an idempotent archive.

    ``fresh`` has (key, sha, url), ``stored`` (key, sha, url, file_there, verified): a key that isn't
    stored is inserted, other bytes are refreshed, the same bytes whose file is gone are
    repaired, else verified. ``verified`` counts how often.
    """
    old = stored.select(key, F.col("sha").alias("_sha"), F.col("url").alias("_url"), "file_there", "verified")
    both = fresh.join(old, key, "full_outer")
    action = (
        F.when(F.col("sha").isNull(), None).when(F.col("_sha").isNull(), "inserted").when(F.col("sha") != F.col("_sha"), "refreshed")
        .when(~F.col("file_there"), "unchanged_repaired").otherwise("unchanged_verified")
    )
    both = both.withColumn("action", action)
    again = F.col("action").startswith("unchanged").cast("int")
    after = both.select(
        key, F.coalesce("sha", "_sha").alias("sha"), F.coalesce("url", "_url").alias("url"), F.coalesce(F.col("action").isNotNull() | F.col("file_there"), F.lit(True)).alias("file_there"),
        (F.when(F.col("action") == "refreshed", 0).otherwise(F.coalesce("verified", F.lit(0))) + F.coalesce(again, F.lit(0))).alias("verified"),
    )
    return both.where("action IS NOT NULL").select(key, "action"), after


def validated(values: DataFrame, fields: DataFrame, texts: DataFrame, known: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Suggested values with ``value`` in canonical form and ``reason``, the first check that they fail, null if accepted.

    ``values`` has (doc, field, raw, evidence), ``fields`` those that may be suggested (field,
    kind, question), ``texts`` (doc, text), ``known`` the values that were there before (doc,
    field). Checks in order: already known, outside the scope, type, evidence in the text, value in
    the evidence, plausible range, evidence of one row only (``labels`` are normalised).
    """
    rows = values.join(fields, "field", "left").join(texts, "doc", "left").join(known.select("doc", "field").distinct().withColumn("_known", F.lit(True)), ["doc", "field"], "left")
    rows = rows.withColumn("value", P.typed_value(F.col("raw"), F.col("kind")))
    evidence = F.coalesce("evidence", F.lit(""))
    numeric = F.col("kind").isin("Number", "Nearest $1", "MM", "DD")
    bare = F.regexp_replace(evidence, "[,$]", "")
    reason = P.first_issue([
        (F.col("_known"), "already_extracted"),
        (F.col("kind").isNull(), "outside_scope"),
        (F.col("value").isNull(), "type_check_failed"),
        (~P.evidence_present(evidence, F.col("text")), "evidence_not_in_text"),
        (numeric & ~bare.contains(F.col("value")), "value_not_in_evidence"),
        (P.sane(F.col("value"), F.col("kind"), F.col("question")).isNotNull(), "sanity_failed"),
        (P.labels_in(evidence, F.array(*map(F.lit, labels))) >= 2, "row_merge_suspected"),
    ])
    return rows.select("doc", "field", "value", reason.alias("reason"))


def cache_key(columns: Sequence[str], missing: Column) -> Column:
    """The key of a cached answer: the parts that it depends on, and the missing fields in order."""
    fields = F.sha2(F.array_join(F.array_sort(missing), "\n"), 256)
    return F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], fields), 256)


def from_cache(asked: DataFrame, cache: DataFrame, key: str, now: Column, most_days: int) -> DataFrame:
    """``asked`` with the cached answer and ``state``: hit, stale (older than ``most_days``) or miss; of several answers the latest."""
    latest = cache.groupBy(key).agg(F.max_by("answer", "written_at").alias("answer"), F.max("written_at").alias("written_at"))
    age = F.timestamp_diff("DAY", F.col("written_at"), now)
    rows = asked.join(latest, key, "left").withColumn("state", F.when(F.col("written_at").isNull(), "miss").when(age > most_days, "stale").otherwise("hit"))
    return rows.withColumn("answer", F.when(F.col("state") == "hit", F.col("answer"))).drop("written_at")


def compared(native: DataFrame, cleaned: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, class) of two extractions of one document: same, different, native_only or cleaner_only; numbers compare as numbers."""
    both = native.select(*key, F.col("value").alias("_n")).join(cleaned.select(*key, F.col("value").alias("_c")), list(key), "full_outer")
    kind = F.when(F.col("_c").isNull(), "native_only").when(F.col("_n").isNull(), "cleaner_only").when(P.numbers_match(F.col("_n"), F.col("_c")), "same").otherwise("different")
    return both.select(*key, kind.alias("class"))


def captured(texts: DataFrame, rules: Mapping[str, str], id_col: str, text_col: str) -> DataFrame:
    """(id_col, rule, actual): what the first group of each rule's pattern takes from each text, null where it doesn't match."""
    found = [F.struct(F.lit(name).alias("rule"), F.nullif(F.regexp_extract(text_col, pattern, 1), F.lit("")).alias("actual")) for name, pattern in rules.items()]
    return texts.select(id_col, F.inline(F.array(*found)))


def rule_scores(captures: DataFrame, expected: DataFrame, id_col: str) -> DataFrame:
    """(rule, expected, matched, pct) of ``captured`` rows against ``expected (id_col, rule, expected)``; numbers with commas count as numbers."""
    rows = expected.join(captures, [id_col, "rule"], "left")
    same = F.coalesce(P.numbers_match(F.regexp_replace("expected", ",", ""), F.regexp_replace("actual", ",", "")), F.lit(False))
    return rows.groupBy("rule").agg(F.count("*").alias("expected"), F.count_if(same).alias("matched"), F.round(100 * F.count_if(same) / F.count("*"), 1).alias("pct"))


def first_rising_triplet(numbers: Column) -> Column:
    """The first three neighbours of an array of numbers that don't fall."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(numbers) - 3, F.lit(0))), lambda i: (numbers[i] <= numbers[i + 1]) & (numbers[i + 1] <= numbers[i + 2]))
    return F.when((F.size(numbers) >= 3) & (F.size(starts) > 0), F.slice(numbers, F.try_element_at(starts, F.lit(1)) + 1, F.lit(3)))


def targets(schools: DataFrame, selected: DataFrame, docs: DataFrame, prior: int, latest: int, version: str, formats: Sequence[str]) -> DataFrame:
    """What to extract again for the years ``prior`` and ``latest`` of each school: (school, doc, year, priority, reason).

    ``selected`` (school, year, doc, producer, producer_version) are the rows in use: one by an older
    version is stale. ``docs`` (school, year, doc, status, format, flag, discovered): for a year
    without a row the best document is taken if its format can be extracted. A document is listed once, for its earlier year.
    """
    years = F.col("year").isin(prior, latest)
    used = selected.where(years).join(schools, "school", "left_semi")
    both = used.groupBy("school").agg((F.count_distinct("year") == 2).alias("_pair"))
    stale = used.join(both, "school").where((F.col("producer") == "tier4") & (X.version_parts(F.col("producer_version")) < X.version_parts(F.lit(version))))
    first = stale.select("school", "doc", "year", F.when(F.col("_pair"), "pairable_stale").otherwise("stale_unpairable").alias("priority"), F.lit("selected_stale").alias("reason"))
    open_docs = docs.where(years).join(schools, "school", "left_semi").join(used.select("school", "year"), ["school", "year"], "left_anti")
    best = document_of_year(open_docs, ["school", "year"], "status", "format", "flag", "discovered", "doc").where(F.col("format").isin(*formats))
    gap = F.when(F.col("year") == latest, "latest_gap").otherwise("prior_gap")
    second = best.select("school", "doc", "year", gap.alias("priority"), F.concat(F.lit("missing_row_"), F.coalesce("status", F.lit("unknown"))).alias("reason"))
    place = F.row_number().over(Window.partitionBy("school", "doc").orderBy("year"))
    return first.unionByName(second).withColumn("_r", place).where("_r = 1").drop("_r")


def usable(flag: Column) -> Column:
    """Whether a row's flag lets it be shown."""
    return ~F.coalesce(flag.isin(*BAD_FLAGS), F.lit(False))


def section_scope(url: Column, hints: Mapping[str, Sequence[str]]) -> Column:
    """The first section all of whose hints stand in an address; empty if none."""
    low, out = F.lower(F.coalesce(url, F.lit(""))), F.lit("")
    for label, words in reversed(hints.items()):
        test = F.lit(True)
        for w in words:
            test = test & low.contains(w)
        out = F.when(test, label).otherwise(out)
    return out


def recently_probed(found: Column, probed: Column, now: Column, days: float) -> Column:
    """Whether to skip a site: found already, or probed within ``days``; a time that can't be read counts as long ago, a site never probed isn't skipped."""
    passed = F.coalesce(F.timestamp_diff("SECOND", probed.try_cast("timestamp_ntz"), now) / 86400, F.lit(999.0))
    return F.coalesce(found, F.lit(False)) | (probed.isNotNull() & (passed < days))


def rising_triplets(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """``(key, triplet)``: each key's first three values in a row that don't fall, null if there are none.

    Values come by ``order`` and are compared with the two after them as they pass: no key's values are collected.
    """
    by = Window.partitionBy(key).orderBy(*order)
    own, second, third = F.col(value), F.lead(value, 1).over(by), F.lead(value, 2).over(by)
    marked = df.select(key, *order, own.alias("_a"), second.alias("_b"), third.alias("_c"))
    rises = F.col("_a").isNotNull() & (F.col("_a") <= F.col("_b")) & (F.col("_b") <= F.col("_c"))
    return marked.groupBy(key).agg(F.min_by(F.array("_a", "_b", "_c"), F.when(rises, F.struct(*order))).alias("triplet"))
