"""SimHash near-duplicate detection with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. If two
fingerprints differ in at most two bits, one segment is the same in both (pigeonhole)
and the next one differs in at most two bits. The binary Golay code of 23 bits decodes
every word to the one code word within three bits; a word and its 23 neighbours at one
bit decode to one or six code words, and two words at most two bits apart always share
one of them, because a word between them is a neighbour of both. So the pair
(exact segment, code-word index of the next segment) is a key that two linked
fingerprints must share, and each fingerprint has between 3 and 18 keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.llm.components import connected_components
from cairnwork.llm.rows import join_common
from cairnwork.storage import materialize, working

# The generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY_POLYNOMIAL = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CHUNK = 1 << 15


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, count, CHUNK):
        part = words[at : at + CHUNK + width - 1] if count > 1 else words
        shingles = zip(*(part[k:] for k in range(width)), strict=False) if len(words) >= width else [words]
        hashes = np.array([digest(b" ".join(s), seed) for s in shingles], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp bigint)`` for every row of ``docs``; the text goes through Arrow as UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"id {kind}, fp bigint")


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(remainder by the generator of each 12-bit high part, error pattern of each remainder)."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_POLYNOMIAL << (bit - 11)
        return word

    units = [1 << b for b in range(23)]
    errors = np.zeros(2048, dtype=np.int64)
    for i, a in enumerate(units):
        errors[remainder(a)] = a
        for j, b in enumerate(units[:i]):
            errors[remainder(a | b)] = a | b
            for c in units[:j]:
                errors[remainder(a | b | c)] = a | b | c
    return np.array([remainder(high << 11) for high in range(4096)], dtype=np.int64), errors


def golay_indices(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The code-word indices of each 23-bit word and its 23 neighbours: an array of shape (n, 24)."""
    high, errors = tables
    near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23, dtype=np.int64)])
    syndrome = high[near >> 11] ^ (near & 2047)
    return (near ^ errors[syndrome]) >> 11


def fuzzy_keys(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key) for the distinct keys of each fingerprint."""
    parts = [(fps.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        near = np.sort(golay_indices(parts[(i + 1) % 3], tables), axis=1)
        first = np.concatenate([np.ones((len(near), 1), dtype=bool), near[:, 1:] != near[:, :-1]], axis=1)
        row, col = np.nonzero(first)
        rows.append(row)
        keys.append((i << 34) | (parts[i][row] << 12) | near[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = golay_tables()
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        row, key = fuzzy_keys(fps, tables)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fps[row], pa.int64())], names=["key", "fp"])


def fingerprint_links(fps: DataFrame, bucket: int = 64) -> DataFrame:
    """Links ``(u, v)`` whose closure joins exactly the distinct ``fp`` at two or fewer differing bits.

    Keys shared by at most ``bucket`` fingerprints are joined and each pair is verified.
    The fingerprints of a fuller key are split further: each is expanded to the 65 words
    within one bit; two of them are within two bits exactly if they share such a word,
    and no word has more than 65 of them, so a star per word loses no link and no pairs
    of a large group are ever listed.
    """
    keys = fps.select("fp").mapInArrow(_key_batches, "key bigint, fp bigint")
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keys.join(counts, "key"), "fuzzy-keys")
    cold = shared.where(F.col("n") <= bucket)
    left, right = cold.select("key", F.col("fp").alias("u")), cold.select("key", F.col("fp").alias("v"))
    pairs = left.join(right, "key").where("u < v AND bit_count(u ^ v) <= 2").select("u", "v")
    hot = shared.where(F.col("n") > bucket).select("fp").distinct()
    balls = hot.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))")).alias("word"))
    stars = balls.groupBy("word").agg(F.sort_array(F.collect_list("fp")).alias("near")).where("size(near) > 1")
    spokes = stars.select(F.col("near")[0].alias("u"), F.explode(F.expr("slice(near, 2, size(near) - 1)")).alias("v"))
    return pairs.union(spokes)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id_col, fingerprint, component_id)``: one row for each row of ``docs``.

    ``component_id`` is the least id reachable over links of two or fewer differing bits.
    Rows without words (null, empty, blank) have fingerprint zero and link like any other;
    rows with a null id keep a row and take the component of their fingerprint, null if no
    row of the component has an id. Other columns are not read.
    """
    with working() as keep:
        fps = keep(materialize(with_fingerprints(docs, id_col, text_col, width), "fingerprints"))
        classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
        labels = connected_components(fingerprint_links(classes))
        rooted = classes.join(labels, classes.fp == labels.node, "left").select("fp", "rep", "n", F.coalesce("label", "fp").alias("root"))
        rooted = materialize(rooted, "rooted")
        least = materialize(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("classes")), "components")
        named = keep(materialize(join_common(rooted, least, ["root"], "classes").select("fp", "n", "component_id"), "named"))
    return join_common(fps, named, ["fp"], "n").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
