"""Source divergence audit: joint count histograms of terms for pairs of sources.

Within a language every pair of sources is compared by the smoothed shares of all kept terms. A
term weighs by its two counts alone, so per pair the terms are tallied by (count, count) and the
difference is evaluated once for each combination, times its multiplicity. Cells in which one or
both counts are zero are never listed term by term: they follow from the sources' own histograms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwork.storage import materialize

#: Bytes outside terms become blanks and A-Z lower case; all of UTF-8's bytes above 127 belong to terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _batch(rows: list[tuple[str, str, bytes, int, int]]) -> pa.RecordBatch:
    lang, source, term, n, docs = zip(*rows, strict=True)
    columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", most_held: int = 200_000) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of a term in a group and the group's documents that have it.

    Nulls count as empty. Tasks count what they read and pass on at most ``most_held`` counts at a
    time, so a hot group is summed before it is shuffled. The rows are dealt out by language and
    term, so that what groups by these shuffles no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> list[tuple]:
            return [(*group, term, count, docs[term]) for group, (n, docs) in held.items() for term, count in n.items()]

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, docs = held.get((lang, source)) or held.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(text.translate(_LETTERS).split())
                n.update(own)
                docs.update(own.keys())
            if sum(len(n) for n, _ in held.values()) > most_held:
                out = rows()
                for at in range(0, len(out), 50_000):
                    yield _batch(out[at : at + 50_000])
                held = {}
        out = rows()
        for at in range(0, len(out), 50_000):
            yield _batch(out[at : at + 50_000])

    source = docs.select(_filled(lang_col).alias("lang"), _filled(source_col).alias("source"), _filled(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, COUNTS).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _tallied(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their multiplicities."""
    order = np.lexsort(rows.T[::-1])
    rows, times = rows[order], times[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    return rows[first], np.add.reduceat(times, first)


def joint_counts(kept: DataFrame, most_held: int = 1_000_000) -> DataFrame:
    """``(lang, a, b, count_a, count_b, times)``: for sources a < b the number of terms with these two counts, both above 0.

    ``kept`` has a row for each term with its sources, sorted, and their counts. A task tallies
    the terms that it reads, neighbours k apart in all lists at a time, and passes on tallies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held, size = [], 0

        def out(rows: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
            words = pa.array(list(names), pa.string())
            for at in range(0, len(rows), 50_000):
                part = rows[at : at + 50_000]
                columns = [*(words.take(pa.array(part[:, c])) for c in range(3)), *(pa.array(part[:, c]) for c in (3, 4)), pa.array(times[at : at + 50_000])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "count_a", "count_b", "times"])

        def codes(column: pa.Array) -> np.ndarray:
            coded = column.dictionary_encode()
            own = np.array([names.setdefault(w, len(names)) for w in coded.dictionary.to_pylist()] or [0], dtype=np.int64)
            return own[coded.indices.to_numpy()]

        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            lengths = np.diff(offsets)
            of = np.repeat(np.arange(len(lists)), lengths)
            lang, source, count = codes(batch.column(0))[of], codes(flat.field(0)), flat.field(1).to_numpy()
            for k in range(1, int(lengths.max(initial=0))):
                same = np.flatnonzero(of[:-k] == of[k:])
                if len(same):
                    rows = np.stack([lang[same], source[same], source[same + k], count[same], count[same + k]], axis=1)
                    held.append(_tallied(rows, np.ones(len(rows), dtype=np.int64)))
                    size += len(held[-1][0])
                if size > most_held:
                    rows, times = _tallied(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [(rows, times)], len(rows)
                    if size > most_held // 2:
                        yield from out(rows, times)
                        held, size = [], 0
        if held:
            yield from out(*_tallied(*(np.concatenate(x) for x in zip(*held, strict=True))))

    schema = "lang string, a string, b string, count_a bigint, count_b bigint, times bigint"
    tallied = kept.select("lang", "sources").mapInArrow(run, schema)
    return tallied.groupBy("lang", "a", "b", "count_a", "count_b").agg(F.sum("times").alias("times"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), by integers of any length."""
    above = (count + 5).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", above, (total + 5 * terms).cast("decimal(20,0)")) + 1


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, top: int = 50) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how a source's terms stand against its language's other sources, and the terms it has more of.

    Part ``pair`` has a row for each other source of the language, of any rank: the sum of the
    differences of smoothed shares over the terms that stand in ``least_docs`` or more of the language's
    documents (0 if there are none). Part ``term`` has the ``top`` terms that the source has and
    whose share is above the language's. Equal values rank by UTF-8 item.

    Null lang, source and text count as empty; repeated rows count as often as they stand; an
    empty table gives no rows; other columns are not read. What is grouped whole is a term's list of
    sources, no longer than the sources of a language, whose pairs are the result's own rows.
    """
    listed = term_counts(docs, lang_col, source_col, text_col).groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = materialize(listed.where(F.col("docs") >= least_docs).drop("docs"), "kept")
    single = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("sources").alias("s")).select("lang", "term", "lang_n", "s.source", F.col("s.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    there = docs.select(_filled(lang_col).alias("lang"), _filled(source_col).alias("source")).distinct()
    groups = there.join(single.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.na.fill(0, ["total", "terms", "lang_total"]), "groups")
    return _pairs(kept, single, groups).unionByName(_terms(single, groups, top))


def _pairs(kept: DataFrame, single: DataFrame, groups: DataFrame) -> DataFrame:
    first = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "terms")
    second = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
    pairs = materialize(first.join(second, "lang").where("a < b"), "pairs")
    own = single.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    joint = materialize(joint_counts(kept), "joint")
    cell = ["lang", "a", "b", "count_a", "count_b", "times"]
    of_a = pairs.join(own.select("lang", F.col("source").alias("a"), F.col("n").alias("count_a"), "times"), ["lang", "a"]).withColumn("count_b", F.lit(0))
    of_b = pairs.join(own.select("lang", F.col("source").alias("b"), F.col("n").alias("count_b"), "times"), ["lang", "b"]).withColumn("count_a", F.lit(0))
    none = pairs.select("lang", "a", "b", F.lit(0).alias("count_a"), F.lit(0).alias("count_b"), F.col("terms").alias("times"))
    # A term that both have is in neither zero cell; one that a source has isn't in the cell (0, 0).
    both = joint.select("lang", "a", "b", F.inline(F.array(*[F.struct(x.alias("count_a"), y.alias("count_b"), z.alias("times")) for x, y, z in _corrections()])))
    single_side = [x.select("lang", "a", "b", F.lit(0).alias("count_a"), F.lit(0).alias("count_b"), (-F.col("times")).alias("times")) for x in (of_a, of_b)]
    cells = joint.select(*cell)
    for part in (of_a.select(*cell), of_b.select(*cell), none, both, *single_side):
        cells = cells.unionByName(part.select(*[F.col(c).cast("bigint") if c not in ("lang", "a", "b") else F.col(c) for c in cell]))
    cells = cells.groupBy("lang", "a", "b", "count_a", "count_b").agg(F.sum("times").alias("times")).where("times <> 0")
    gap = F.abs(share(F.col("count_a"), F.col("total_a"), F.col("terms")) - share(F.col("count_b"), F.col("total_b"), F.col("terms")))
    summed = cells.join(pairs, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(gap * F.col("times")).alias("value"))
    whole = pairs.select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left").na.fill(0, ["value"])
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    rows = whole.select("lang", F.inline(sides), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _corrections() -> list[tuple[Column, Column, Column]]:
    a, b, times, zero = F.col("count_a"), F.col("count_b"), F.col("times"), F.lit(0).cast("bigint")
    return [(a, zero, -times), (zero, b, -times), (zero, zero, times)]


def _terms(single: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    terms = single.join(groups, ["lang", "source"])
    value = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = terms.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return above.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
