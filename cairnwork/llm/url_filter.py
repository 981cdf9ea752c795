"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A list holds rules (host, path, verdict). A rule fits its host and all subdomains, for paths that
start with its own; it is known by its canonical URL, host and path joined. A page's
candidates are the canonical URLs of the rules that could fit it: the last labels of its host
and the start of its path, in the shapes (labels, path length) that the list has. Candidates
that the filter can't rule out go to an exact join with the list, and the longest rule wins.

The filter is a table of blocks of eight 64-bit words; an entry sets one bit in each word of one
block. It has at most ``most_blocks`` rows, whatever the length of the list, so it may be
broadcast; a longer list costs more false positives, which the join removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm.rows import join_common, row_table, stable
from cairnwork.storage import materialize, working

WORDS = 8
BITS_PER_ENTRY = 16
MOST_BLOCKS = 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between ``://`` and the next ``/ ? #``, with A-Z in lower case, and from there to the next ``? #``; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A list ``(host, path, verdict)`` from Python tuples."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def canonical(rules: DataFrame) -> DataFrame:
    """``(key, verdict, labels, length)``: one row for each canonical URL of the list.

    Hosts are taken in lower case. A rule listed twice blocks if one of its verdicts is ``block``.
    Rules with a null, an empty host or a path that no page has (not starting with ``/``) fit nothing and go.
    """
    host = F.translate("host", UPPER, LOWER)
    rows = rules.where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL AND (path = '' OR path LIKE '/%')")
    rows = rows.select(F.concat(host, "path").alias("key"), "verdict", _labels(host).alias("labels"), F.length("path").alias("length"))
    return rows.groupBy("key").agg(F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise(F.min("verdict")).alias("verdict"), F.first("labels").alias("labels"), F.first("length").alias("length"))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)).cast("int")


def _bits(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1))


def _bit(bits: Column, word: int) -> Column:
    """The one bit of an entry in a word of its block: six bits of its second hash say which."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 6 * word).bitwiseAND(F.lit(63)).cast("int"))


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0, ..., w7)`` for the ``key`` column of ``keys``; blocks without entries have no row."""
    hashed = keys.select(_block(F.col("key"), blocks).alias("block"), _bits(F.col("key")).alias("bits"))
    return hashed.groupBy("block").agg(*[F.bit_or(_bit(F.col("bits"), w)).alias(f"w{w}") for w in range(WORDS)])


def possible(candidates: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``candidates`` whose ``key`` the filter holds: all that are listed and few others."""
    hashed = candidates.select("*", _block(F.col("key"), blocks).alias("block"), _bits(F.col("key")).alias("bits"))
    joined = hashed.join(F.broadcast(filter_blocks), "block")
    for w in range(WORDS):
        joined = joined.where(F.col(f"w{w}").bitwiseAND(_bit(F.col("bits"), w)) != 0)
    return joined.select(*candidates.columns)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow", bits_per_entry: int = BITS_PER_ENTRY, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for each row of ``pages``; ``rule`` is null and ``verdict`` is ``otherwise`` where no rule fits.

    Of the rules that fit, the longest canonical URL wins, then the longest host. Null urls and
    urls without ``://`` have an empty host and path and fit no rule. Null ids and repeated rows
    are kept; other columns are not read, unless ``pages`` is computed and so is written first.
    An empty list lets all pass. A rule that fits a third of all pages is joined by broadcast
    (``join_common``); only the list's distinct shapes, at most as many as the longest
    rule's labels times its length, are brought to the driver.
    """
    host, path = host_and_path(F.col(url_col))
    pages = stable(pages)
    rows = row_table(pages, id=F.col(id_col), host=host, path=path)
    with working() as keep:
        listed = materialize(canonical(rules), "listed")
        shapes = [tuple(r) for r in listed.select("labels", "length").distinct().sort("labels", "length").collect()]
        if not shapes:
            return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
        blocks = max(1, min(most_blocks, listed.count() * bits_per_entry // (64 * WORDS)))
        held = materialize(bloom_blocks(listed, blocks), "bloom")
        fitting = F.filter(F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("length")) for a, b in shapes]), lambda s: (s["labels"] <= _labels(F.col("host"))) & (s["length"] <= F.length("path")))
        key = F.transform(fitting, lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.left(F.col("path"), s["length"])))
        hits = keep(materialize(possible(rows.where("host <> ''").select("row", F.explode(key).alias("key")), held, blocks), "possible"))
        exact = keep(materialize(hits.groupBy("key").agg(F.count("*").alias("n")).join(listed, "key"), "exact"))
    rank = F.struct(F.length("key").alias("size"), (-F.col("length")).alias("host"), F.col("key"), F.col("verdict"))
    best = join_common(hits, exact, ["key"], "n").groupBy("row").agg(F.max(rank).alias("best"))
    out = rows.join(best, "row", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
