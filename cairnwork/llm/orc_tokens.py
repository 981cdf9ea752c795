"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, encoded in their partitions and written
one file a range, so files and stripes hold disjoint ranges of ids: a reader of some ids
prunes files and stripes by their statistics and by the Bloom filters, and reads the rest
stripe by stripe in parallel.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnwork.llm.bpe import PIECES, Memo, Splitter, byte_letters, chunked, uncollected
from cairnwork.storage import discard_folder, materialize, work_dir

ORC_OPTIONS = {
    "compression": "zstd", "orc.row.index.stride": "5000", "orc.stripe.size": str(64 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}


def library_words(path: str) -> Callable[[list[bytes]], Iterable[bytes]]:
    """Encodes distinct words as little-endian 32-bit ids: the library's model encodes their pieces, which are remembered."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, byte_letters()
    split = Splitter({t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}).pieces
    known: dict[bytes | int, bytes] = {}
    packed = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def piece(part: bytes | int) -> bytes:
        if isinstance(part, int):
            known[part] = found = packed[part]
        else:
            text = part.decode() if part.isalnum() else "".join([letters[b] for b in part])
            known[part] = found = b"".join([packed[t.id] for t in model.tokenize(text)])
        return found

    def encode(words: list[bytes]) -> Iterable[bytes]:
        if len(known) > PIECES:
            known.clear()
        get = known.get
        return [b"".join([get(p) or piece(p) for p in split(w)]) for w in words]

    return encode


@lru_cache(maxsize=2)
def library_memo(path: str) -> Memo:
    """One memo for each vocabulary in a Python worker."""
    return Memo(library_words(path), 500_000)


def write_tokens(docs: DataFrame, vocabulary: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``(place, doc_id, ids)`` as ORC files under ``out`` in ascending order of id.

    ``place`` rises with the order of rows over all files. A null id sorts first, rows of
    equal id by text; null texts count as empty and hold the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last = library_memo(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            with uncollected():
                rows = [b"".join(x) + last for part in chunked(batch.column(2)) for x in memo.words(part)]
            offsets = np.cumsum([0, *(len(r) >> 2 for r in rows)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), dtype="<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["place", "doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    placed = ordered.select(F.monotonically_increasing_id().alias("place"), "doc_id", F.col("text").cast("binary").alias("text"))
    placed.mapInArrow(run, f"place bigint, doc_id {kind}, ids array<int>").write.options(**ORC_OPTIONS).orc(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on ``doc_id`` prune files, stripes and row groups."""
    return spark.read.orc(path)


def token_table(tokens: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` for rows of ``read_tokens``.

    Starts are sums in each file's range plus the sums of the ranges before; the latter
    table, one row for each written file, is all that one task sums and that is broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
            sums = [zlib.crc32(values[a:b].data) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=["place", "doc_id", "n_tokens", "ids_crc32"]
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = tokens.select("place", "doc_id", "ids").mapInArrow(run, f"place bigint, doc_id {kind}, n_tokens bigint, ids_crc32 bigint")
    rows = materialize(rows.withColumn("part", F.shiftright("place", 33)), "token-rows")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("own", own).join(F.broadcast(before), "part").select("doc_id", (F.col("own") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokens_via_orc(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes the token files of ``docs`` in the shared folder and returns the table read back from them, which is written itself; then the files go.

    Null, empty and very long texts, repeated and null ids as in ``write_tokens``; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    out = f"{work_dir(spark)}/cairnwork/tokens-{uuid.uuid4().hex}"
    try:
        write_tokens(docs, vocabulary, out, end_id)
        return token_table(read_tokens(spark, out))
    finally:
        discard_folder(spark, out)
