"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the expected number of copies of each of its
rows. Whole copies are certain; the fractional parts are rounded dependently: two rows
exchange words (one gains what the other loses, at random in proportion so that neither
expectation changes) until one of the two fractions is 0 or 1, and the other goes on to
the next row. Every bucket of a source leaves at most one fractional row; these meet in a
reduction tree until one row of the source is left, which is rounded alone. So a source's
words miss its target by less than the words of one row.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwork.llm.rows import COMMON, chosen, join_common, ordinals, places, row_table, stable
from cairnwork.storage import materialize, working

WORD = "[^\\x20\\x09-\\x0D]+"
MOST = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``(source, source_size, target)`` for ``sizes (source, size)``.

    Sources in code-point order, null last, take ``weights`` in turn. Targets share the sum
    of all sizes by weight; one above 3 times its source's size stops there and the excess
    goes to the others, until none is above. Each round of this is one aggregate over the
    table of sources; rounds end when no further source stops.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    placed = ordinals(totals, "_null", "source")
    parts = placed.groupBy("part").agg(F.count("*").alias("_n"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turn = (F.col("at") + F.col("_before")) % len(weights)
    weighed = placed.join(F.broadcast(before), "part").select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).alias("weight"))
    weighed = materialize(weighed, "weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rate, stopped = 0.0, -1
    while True:
        full = F.col("weight") * rate >= MOST * F.col("source_size") if stopped >= 0 else F.lit(False)
        row = weighed.agg(
            F.coalesce(F.sum(F.when(full, MOST * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.count_if(full)
        ).first()
        if row[2] == stopped:
            break
        stopped = row[2]
        rate = (total - row[0]) / row[1] if row[1] else float("inf")
        if not row[1]:
            break
    share = F.least(F.col("weight") * F.lit(rate), MOST * F.col("source_size").cast("double"))
    return weighed.select("source", "source_size", share.alias("target"))


def _draw(*parts: object) -> float:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest(), "big") / float(1 << 56)


def pivot(mass: np.ndarray, fraction: np.ndarray, keys: np.ndarray, eps: float = 1e-9) -> tuple[np.ndarray, int]:
    """Rounds ``fraction`` in order, moving words; returns the fractions and the place left between 0 and 1, or -1.

    The draw for a pair comes from the two rows' keys, so reruns agree.
    """
    f, held = fraction.astype(float).copy(), -1
    for i in range(len(f)):
        if f[i] <= eps or f[i] >= 1 - eps or mass[i] <= 0:
            f[i] = round(f[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - f[a]) * mass[a], f[b] * mass[b])  # words a can take from b
        down = min(f[a] * mass[a], (1 - f[b]) * mass[b])
        move = up if _draw(int(keys[a]), int(keys[b])) * (up + down) < down else -down
        f[a], f[b] = f[a] + move / mass[a], f[b] - move / mass[b]
        whole = [k for k in (a, b) if f[k] <= eps or f[k] >= 1 - eps]
        for k in whole:
            f[k] = round(f[k])
        held = next((k for k in (a, b) if k not in whole), -1)
    return f, held


SCHEMA = "source string, id string, size bigint, rows bigint, key bigint, base int, more bigint, frac double, bucket bigint, done boolean"


def _round_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    order = np.lexsort([pdf["key"], -pdf["size"]])  # the largest first, so that what is left is small
    pdf = pdf.iloc[order].reset_index(drop=True)
    frac, held = pivot(pdf["size"].to_numpy(float), pdf["frac"].to_numpy(float), pdf["key"].to_numpy())
    return pdf.assign(frac=frac, done=np.arange(len(pdf)) != held)


def _round_last(pdf: pd.DataFrame) -> pd.DataFrame:
    out = _round_bucket(pdf)
    last = [_draw("last", int(k)) < f for k, f in zip(out["key"], out["frac"], strict=True)]
    return out.assign(frac=np.where(out["done"], out["frac"], np.array(last, dtype=float)), done=True)


def _mark(source: str) -> Column:
    """A source as a key that is never null."""
    return F.struct(F.col(source).isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")).alias("mark")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", per_bucket: int = 2_000, fan_in: int = 64) -> DataFrame:
    """``(id_col, source, size, source_size, target, copies, extra, rows)``: one row for each distinct (id, source, size).

    ``rows`` says how many rows of ``docs`` have that id, source and size. Each takes ``copies``
    (0 to 3) and ``extra`` of them one more: rows that are alike share whole copies among
    them and only the part of one row that is left over is rounded. A source of any size is
    dealt by hash into buckets of about ``per_bucket`` rows, so a source with most rows is
    rounded by many tasks. Null sources are a source; null and empty texts have no words and
    take no part; null ids are one id. An empty table gives no rows; other columns are not read.
    """
    with working() as keep:
        kind = docs.schema[id_col].dataType.simpleString()
        sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
        units = materialize(sized.groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "units")
        targets = source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")))
        counts = units.groupBy("source").agg(F.count("*").alias("units"))
        totals = targets.select(_mark("source"), "source_size", "target").join(counts.select(_mark("source"), "units"), "mark")
        totals = materialize(totals.withColumn("buckets", F.ceil(F.col("units") / per_bucket).cast("bigint")), "targets")
        copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
        expected = join_common(units.withColumn("mark", _mark("source")), totals, ["mark"], "units").withColumn("share", F.when(F.col("size") > 0, copies).otherwise(0.0))
        key, over = F.xxhash64("id", "size"), (F.col("share") - F.floor("share")) * F.col("rows")
        dealt = expected.select(
            "source", F.col("id").cast("string").alias("id"), "size", "rows", key.alias("key"), F.floor("share").cast("int").alias("base"), F.floor(over).cast("bigint").alias("more"),
            (over - F.floor(over)).alias("frac"), F.pmod(F.xxhash64(key), "buckets").alias("bucket"), F.lit(False).alias("done"),
        )
        most = totals.agg(F.max("buckets")).first()[0] or 1
        state = materialize(dealt.groupBy("source", "bucket").applyInPandas(_round_bucket, SCHEMA), "rounded")
        finished = [state.where("done")]
        while most > 1:
            most = -(-most // fan_in)
            rest = state.where("NOT done").withColumn("bucket", F.floor(F.col("bucket") / fan_in))
            state = materialize(rest.groupBy("source", "bucket").applyInPandas(_round_bucket, SCHEMA), "residuals")
            finished.append(state.where("done"))
        finished.append(state.where("NOT done").groupBy("source").applyInPandas(_round_last, SCHEMA))
        rounded = finished[0]
        for more in finished[1:]:
            rounded = rounded.unionByName(more)
        out = join_common(rounded.withColumn("mark", _mark("source")), totals, ["mark"], "units")
        extra = (F.col("more") + F.round("frac")).cast("bigint")
        mixed = out.select(F.col("id").cast(kind).alias(id_col), "source", "size", "source_size", "target", F.col("base").cast("bigint").alias("copies"), extra.alias("extra"), "rows")
        return keep(materialize(mixed, "mix"))


def mixed_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: one row for each row of ``docs``; rows of one id, source and size may change places.

    Nulls, empty texts and empty tables as in ``mix``; ties between sources can't be, as they are distinct.
    """
    out = mix(docs)
    few = out.where(F.col("rows") <= COMMON).select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("place"))
    # a unit of very many rows is listed in parts, which are dealt out
    parts = out.where(F.col("rows") > COMMON).select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / COMMON))).alias("part")).repartition("doc_id", "source", "size", "part")
    many = parts.select("*", F.explode(F.sequence(F.col("part") * COMMON + 1, F.least(F.col("rows"), (F.col("part") + 1) * COMMON))).alias("place")).drop("part")
    out = few.unionByName(many)
    taken = (F.col("copies") + (F.col("place") <= F.col("extra")).cast("bigint")) * F.col("size")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", per_bucket: int = 2_000) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, in docs' columns, whatever their names.

    Rows without words are never taken. Of rows of one id, source and size the first by file
    and place take the extra copies. An empty table gives no rows.
    """
    docs = stable(docs)
    with working() as keep:
        plan = mix(docs, id_col, text_col, source_col, per_bucket).where("size > 0 AND copies + extra > 0")
        plan = plan.select(F.col(id_col).alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "copies", "extra", "rows")
        rows = row_table(docs, id=F.col(id_col), source=F.col(source_col).cast("string"), size=word_count(F.col(text_col)))
        dealt = rows.join(plan, F.expr("id <=> p_id AND source <=> p_source AND size = p_size"))
        dealt = materialize(dealt.select("row", F.to_json(F.struct("id", "source", "size")).alias("unit"), "copies", "extra", "rows"), "dealt")
        uneven, large = F.expr("extra > 0 AND extra < rows"), F.col("rows") > COMMON
        place = F.row_number().over(Window.partitionBy("unit").orderBy("row"))
        parts = [dealt.where(~uneven).withColumn("one", F.col("extra") > 0), dealt.where(uneven & ~large).withColumn("one", place <= F.col("extra"))]
        if not dealt.where(uneven & large).isEmpty():
            placed = places(dealt.where(uneven & large), "unit", "row")
            parts.append(placed.select(*dealt.columns, (F.col("place") <= F.col("extra")).alias("one")))
        taken = reduce(DataFrame.unionByName, parts).select("row", (F.col("copies") + F.col("one").cast("bigint")).alias("taken"))
        return chosen(docs, keep(materialize(taken.where("taken > 0"), "taken")), "taken")
