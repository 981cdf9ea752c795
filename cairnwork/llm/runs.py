"""Periodic runs of words in linear time over a general ordered alphabet, after Ellert and Fischer.

A run's root that is a Lyndon word under the order of words or its reverse starts at places whose
next smaller suffix is just one period away. So both Lyndon arrays (as next smaller suffixes) name
every run. The arrays come from one pass from the left each, with words compared as they are: no
suffix array, no hash, no rank. The pass keeps the pairs of suffixes it compared with the length of
their match; inside the match that reaches farthest right, a pair is the copy of an earlier pair,
whose match is taken over and is extended only past that match's end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.llm.bpe import uncollected

Run = tuple[int, int, int]


def _extended(words: Sequence, a: int, b: int, known: int, n: int) -> int:
    """The length of the common prefix of the suffixes at a < b, of which ``known`` words are known to agree."""
    i, j, step = a + known, b + known, 1
    while j < n and words[i] == words[j]:
        i, j = i + 1, j + 1
        if step >= 8:
            while words[i : i + step] == words[j : j + step] and j + step <= n:
                i, j, step = i + step, j + step, step * 2
            step = 1
        step += 1
    return j - b


def lyndon_array(words: Sequence, up: bool = True) -> tuple[list[int], list[int]]:
    """(place of the next smaller suffix or n, words that the two have in common) for each place.

    Suffixes are compared by the order of words if ``up``, else by its reverse; the end is
    smaller than any word. The longest Lyndon word at a place ends before its next smaller suffix.
    """
    n = len(words)
    after, common = [n] * n, [0] * n
    before, shared = [-1] * n, [0] * n  # the previous smaller suffix and the match with it
    copy, back, end = 0, 0, 0  # words[copy:end] equal words[copy - back : end - back]
    for i in range(1, n):
        top, word = i - 1, words[i]
        while top >= 0:
            other = words[top]
            if other != word:
                if (other < word) is up:
                    break
                after[top] = i
                top = before[top]
                continue
            known = 1
            while True:
                if i < end:
                    j = i - back
                    if top >= copy and after[top - back] == j:
                        known = max(known, min(common[top - back], end - i))
                    elif top >= copy and before[j] == top - back or before[j] == top:
                        known = max(known, min(shared[j], end - i))
                match = _extended(words, top, i, known, n)
                if i + match > end:
                    copy, back, end = i, i - top, i + match
                if i + match < n and (words[top + match] < words[i + match]) is up:
                    shared[i] = match
                    break
                after[top], common[top] = i, match
                below, top = shared[top], before[top]
                while top >= 0 and below > match:
                    after[top], common[top] = i, match
                    below, top = shared[top], before[top]
                if top < 0 or below < match:
                    shared[i] = below if top >= 0 else 0
                    break
                known = match
            break
        before[i] = top
    return after, common


def runs_of(words: Sequence, least: int = 6, times: int = 4) -> list[Run]:
    """(start, length, period) of each maximal stretch of the smallest period q with length >= max(least, times * q), by start, then period.

    ``times`` is 3 or more: such a run holds its root times - 1 times in full, so places
    whose Lyndon word is followed by equally long ones are all that is looked at.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    n, found = len(words), set()
    if n < least:
        return []
    for up in (True, False):
        after, common = lyndon_array(words, up)
        ends = np.array([*after, n])
        length = ends - np.arange(n + 1)
        root, place = length[:-1] > 0, ends[:-1]
        for _ in range(times - 2):
            root &= length[place] == length[:-1]
            place = ends[place]
        for k in np.flatnonzero(root).tolist():
            q = after[k] - k
            if k >= q and after[k - q] == k and common[k - q] >= q:
                continue  # not the first root of its run
            start = k
            while start > 0 and words[start - 1] == words[start - 1 + q]:
                start -= 1
            stop = k + q + common[k]
            if stop - start >= max(least, times * q):
                found.add((start, stop - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[Run]) -> list:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def planted(words: list[bytes], key: str | None) -> list[bytes]:
    """``words`` with a periodic end for about every tenth key, by its CRC-32; a null key changes nothing."""
    h, n = zlib.crc32((key or "").encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[list[bytes]]:
    """The words of each text of a binary column; null has none. bytes.split() parts at space and U+0009 to U+000D."""
    for text in batch.column(at):
        yield (text.as_py() or b"").split()


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """``(id_col, start, length, period)``, one row for each run of words of each text of ``docs``.

    Words are stretches of characters other than space and U+0009 to U+000D, numbered from 0. A
    text is handled by one task in time and memory linear in its length. Null and empty texts
    have no runs; null ids and repeated rows are kept as they are; other columns are not read; an
    empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with uncollected():
                found = [(k, *r) for k, words in enumerate(_texts(batch, 1)) for r in runs_of(words, least, times)]
            table = np.array(found, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(table[:, 0])), *(pa.array(table[:, c]) for c in (1, 2, 3))], names=["id", "start", "length", "period"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"id {kind}, start bigint, length bigint, period bigint").withColumnRenamed("id", id_col)


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """``docs`` with each run of words in ``text_col`` cut to its first period; the words of such a text are then joined by one space.

    Texts without runs and null texts stay as they are, as do all other columns, whatever their names.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            with uncollected():
                for text in batch.column(at).to_pylist():
                    words = (text or "").encode().split()
                    runs = runs_of(words, least, times)
                    out.append(b" ".join(collapsed(words, runs)).decode() if runs else text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


DIGEST = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = True, least: int = 6, times: int = 4) -> DataFrame:
    """``(id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` for each row of ``docs``.

    The run is the longest (of equal ones the first, then of smallest period), nulls if there
    is none. ``plant`` first gives every tenth id's text a periodic end (``planted``). Null and
    empty texts have no words and no runs; a null id's text is left as it is; repeated rows
    have equal results; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def row(words: list[bytes]) -> tuple:
        runs = runs_of(words, least, times)
        start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        kept = sha256(b" ".join(collapsed(words, runs))).hexdigest()
        return len(runs), start, length, period, 1000 * length // period if runs else None, sha256(lines.encode()).hexdigest(), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        names = ["id", *(x.split()[0] for x in DIGEST.split(", "))]
        for batch in batches:
            with uncollected():
                keys = batch.column(1).to_pylist()
                rows = [row(planted(words, key) if plant else words) for key, words in zip(keys, _texts(batch, 2), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    source = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"id {kind}, {DIGEST}").withColumnRenamed("id", id_col)
