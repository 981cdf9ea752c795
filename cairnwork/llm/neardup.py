"""Near duplicates by the Jaccard similarity of word shingles: SimHash with Golay keys first, MinHash bands for the rest.

Two texts link if their sets of five-word shingles have a similarity of 0.8 or more.
Candidates come from the SimHash operator (fingerprints at two or fewer differing bits, by
Golay-code keys), which joins most of a large group of close copies at little cost. Pairs at
0.8 differ in about 10 of 64 bits, and keys that allow so many would be shared by most texts;
so the pairs that fingerprints can't reach share a MinHash band: of 25 bands of 5 least
hashes a pair at similarity 0.8 shares none with a chance of (1 - 0.8^5)^25 = 5 in 100,000,
and a pair above it with less. Each candidate is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.llm.components import connected_components
from cairnwork.llm.rows import chosen, join_common, row_table, stable
from cairnwork.llm.simhash import fingerprint_links
from cairnwork.storage import discard, materialize, working

# Shingle width in words, least similarity in hundredths, MinHash bands and hashes of a band.
WIDTH, PERCENT, BANDS, DEPTH = 5, 80, 25, 5
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, size=BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 1 << 12
SENT, BITMAP = 1 << 19, 32  # shingles that are sent at a time, and words of a set's bitmap


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text under ``width`` words is one shingle, one without words none."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w) for w in (text or b"").lower().split()], dtype=np.uint64)
    width = min(width, len(words))
    if not width:
        return words
    count = len(words) - width + 1
    h = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        h = _mixed(h + words[k : k + count])
    return np.unique(h)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(least, (FACTORS[:, None] * shingles[at : at + CHUNK]).min(axis=1), out=least)
    h = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, DEPTH).T:
        h = _mixed(h + column)
    return h.view(np.int64)


def print_of(shingles: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles; 0 for an empty one."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), CHUNK):
        ones += np.unpackbits(shingles[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, prints, sizes, keys = [], [], [], []
        for x in batch.column(1):
            s = shingle_set(x.as_py())
            fps.append(xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0)
            prints.append(print_of(s))
            sizes.append(len(s))
            keys.append(band_keys(s))
        fp = np.array(fps, dtype=np.uint64).view(np.int64)
        columns = [batch.column(0), pa.array(fp), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "fp", "print", "n", "keys"])
        pa.default_memory_pool().release_unused()


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """BITMAP 64-bit words with the bit of each shingle set."""
    bits = np.zeros(64 * BITMAP, dtype=np.uint8)
    bits[(shingles % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sent(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(ids, pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([bitmap(x) for x in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["fp", "shingles", "bits"])

    for batch in batches:
        ids, sets, held = [], [], 0
        for fp, x in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(fp)
            sets.append(shingle_set(x.as_py()))
            held += len(sets[-1])
            if held > SENT:
                yield sent(ids, sets)
                ids, sets, held = [], [], 0
        if ids:
            yield sent(ids, sets)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``(u, v)`` whose whole sets have the similarity."""
    left, right = sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(right, "v").join(left, "u").select("u", "v", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("common"))
    return both.where(f"common * 100 >= (n - common) * {PERCENT}").select("u", "v")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs u < v whose sizes alone allow the similarity."""
    fit = pairs.where(f"u <> v AND least(nu, nv) * 100 >= greatest(nu, nv) * {PERCENT}")
    return fit.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _print_candidates(classes: DataFrame) -> DataFrame:
    """Pairs of sets by the SimHash operator: of one fingerprint, each with the first; of linked fingerprints, their first ones."""
    first = materialize(classes.groupBy("print").agg(F.min(F.struct("fp", "n")).alias("first"), F.count("*").alias("m")), "prints")
    same = join_common(classes, first.where("m > 1"), ["print"], "m")
    pairs = same.select(F.col("first.fp").alias("u"), F.col("first.n").alias("nu"), F.col("fp").alias("v"), F.col("n").alias("nv"))
    links = fingerprint_links(first.select(F.col("print").alias("fp")))
    ends = [first.select(F.col("print").alias(c), F.col("first").alias(f"{c}_first")) for c in ("u", "v")]
    near = links.join(ends[0], "u").join(ends[1], "v")
    return pairs.union(near.select("u_first.fp", "u_first.n", "v_first.fp", "v_first.n"))


def _apart_pairs(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, nu, v, nv) of ``left (key, fp, n, root, main)`` that share a key, aren't in one component and may have the similarity.

    At 0.8 a pair has 4/9 of its shingles, counted together, in common. Each bit that one
    set's bitmap has and the other's lacks stands for a shingle that isn't common; so sizes and
    bitmaps bound what can be, and no pair with the similarity is lost. Only pairs within the bound
    are made; sizes are matched by bins. (Inside a key, sets that are apart are still held
    against each other, by their bitmaps.)
    """
    sized = materialize(left.join(sets.select("fp", "bits"), "fp").select("key", "fp", "n", "root", "main", "bits"), "sized")

    def bin_of(n: Column) -> Column:
        return F.floor(F.log(n) / F.log(F.lit(1.1)))

    low, high = F.ceil(F.col("n") * PERCENT / 100), F.floor(F.col("n") * 100 / PERCENT)
    few = sized.where("root <> main").withColumn("bin", F.explode(F.sequence(bin_of(low), bin_of(high)))).select(
        "key", "bin", F.col("fp").alias("u"), F.col("n").alias("nu"), F.col("root").alias("ru"), F.col("bits").alias("bu")
    )
    others = sized.select("key", bin_of(F.col("n")).alias("bin"), F.col("fp").alias("v"), F.col("n").alias("nv"), F.col("root").alias("rv"), F.col("bits").alias("bv"))

    def common_at_most(n: str, a: str, b: str) -> str:
        return f"({n} - ({' + '.join(f'bit_count({a}[{i}] & ~{b}[{i}])' for i in range(BITMAP))}))"

    fits = [f"{common_at_most(*x)} * (100 + {PERCENT}) >= (nu + nv) * {PERCENT}" for x in (("nu", "bu", "bv"), ("nv", "bv", "bu"))]
    return few.join(others, (few["key"] == others["key"]) & (few["bin"] == others["bin"]) & F.expr(f"ru <> rv AND {fits[0]} AND {fits[1]}")).select("u", "nu", "v", "nv")


def similar_links(classes: DataFrame, docs: DataFrame, text_col: str = "text", bucket: int = 16) -> DataFrame:
    """Links ``(u, v)`` whose closure joins all verified candidates among the distinct sets ``(fp, print, n, keys, row)``.

    SimHash candidates are verified first. All pairs of a band key with at most ``bucket`` sets
    are verified. In a fuller key each set is held against the most central one (a text that
    others were copied from shares more keys with them than they do with each other), then
    against the most central one of those that aren't in the key's largest component; after
    that only pairs that aren't yet in one component can add anything, and of those all that
    their sizes and bitmaps allow (``_apart_pairs``) are verified.
    """
    keyed = classes.select("fp", "n", "row", F.explode("keys").alias("key"))
    counts = materialize(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "band-counts")
    shared = materialize(join_common(keyed, counts, ["key"], "m"), "bands")
    printed = materialize(_ordered(_print_candidates(classes)), "print-candidates")
    wanted = shared.select("fp", "row").union(classes.join(printed.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "fp", "left_semi").select("fp", "row")).distinct()
    texts = row_table(docs, text=F.col(text_col).cast("binary"))
    sets = materialize(texts.join(wanted, "row").select("fp", "text").mapInArrow(_sets, "fp bigint, shingles array<bigint>, bits array<bigint>"), "shingle-sets")

    cold, hot = shared.where(F.col("m") <= bucket), shared.where(F.col("m") > bucket)
    u, v, nu, nv = F.col("fp").alias("u"), F.col("fp").alias("v"), F.col("n").alias("nu"), F.col("n").alias("nv")
    tested, links = printed, materialize(_verified(printed, sets), "links")

    def added(pairs: DataFrame) -> None:
        nonlocal links, tested
        new = materialize(_ordered(pairs).join(tested, ["u", "v"], "left_anti"), "candidates")
        tested, links = tested.union(new), links.union(materialize(_verified(new, sets), "links"))

    central = materialize(hot.join(hot.groupBy("fp").agg(F.sum("m").alias("weight")), "fp"), "central")
    leader = F.max_by(F.struct("fp", "n"), F.struct("weight", "fp"))
    leaders = materialize(central.groupBy("key").agg(leader.alias("one"), F.count("*").alias("members")), "leaders")
    first = join_common(central, leaders, ["key"], "members")
    listed = cold.select("key", u, nu).join(cold.select("key", v, nv), "key").where("u < v").drop("key")
    added(listed.union(first.select(F.col("one.fp").alias("u"), F.col("one.n").alias("nu"), v, nv)))
    if central.isEmpty():
        discard(sets, shared, counts, central)
        return links

    def placed() -> DataFrame:
        """Members of fuller keys that hold more than one component, with their component and the key's largest."""
        named = central.join(connected_components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
        named = materialize(named.select("key", "fp", "n", "weight", "root"), "placed")
        sizes = named.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"), F.sum("c").alias("members"))
        return join_common(named, materialize(sizes.where("roots > 1"), "apart"), ["key"], "members")

    apart = materialize(placed(), "apart")
    outside = apart.where("root <> main").groupBy("key").agg(leader.alias("two"), F.max("members").alias("members"))
    second = join_common(apart.drop("members"), materialize(outside, "leaders"), ["key"], "members")
    added(second.select(F.col("two.fp").alias("u"), F.col("two.n").alias("nu"), v, nv))
    left = materialize(placed(), "apart")
    added(_apart_pairs(left, sets))
    discard(sets, shared, counts, central)
    return links


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they are: of each component of links
    the row with the least id, the first by file and place of equal ones, a null id last. Texts
    without words (null, empty, blank) are one component. An empty table gives no rows."""
    docs = stable(docs)
    rows = row_table(docs, id=F.col(id_col), text=F.col(text_col).cast("binary"))
    rows = rows.select(F.struct(F.col("id").isNull().alias("z"), "id", "row").alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    with working() as keep:
        return chosen(docs, keep(materialize(_representatives(rows, docs, kind, text_col, bucket), "kept-rows")))


def _representatives(rows: DataFrame, docs: DataFrame, kind: str, text_col: str, bucket: int) -> DataFrame:
    """The ``row`` of the text that stays of each component."""
    signed = materialize(rows.mapInArrow(_signatures, f"row {kind}, fp bigint, print bigint, n int, keys array<bigint>"), "signatures")
    classes = materialize(signed.groupBy("fp").agg(F.first("print").alias("print"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("row").alias("rep")).withColumn("row", F.col("rep.row")), "classes")
    labels = connected_components(similar_links(classes, docs, text_col, bucket))
    rooted = classes.join(labels, classes.fp == labels.node, "left").select("rep", F.coalesce("label", "fp").alias("root"))
    return rooted.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.row").alias("row"))
