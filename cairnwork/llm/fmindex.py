"""Substring deduplication with a compressed FM-index per shard.

Every window of 35 words has an anchor: its leftmost 8-word gram of least hash. Equal
windows have equal anchors, so windows are only searched among those of the same anchor.
Runs of windows with one anchor are cut out as segments; segments whose anchor stands
nowhere else are done. The others are dealt to shards by anchor, equal ones once, and each
shard builds an FM-index over its segments: suffix array, Burrows-Wheeler transform and a
wavelet matrix of packed bit vectors. Segments are streamed through it from their right
end by backward search; the matching statistics (the longest match to the left of each
end that stands at least twice) give the intervals of repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.llm.rows import join_common, row_table, stable
from cairnwork.storage import discard, materialize

GRAM = 8
BLANK = np.zeros(256, dtype=bool)
BLANK[list(b" \t\n\x0b\x0c\r")] = True
#: Bytes of text whose words are hashed together; bytes of segments that a shard aims at and that one anchor may have.
BLOCK, SHARD, HOT = 1 << 22, 6 << 20, 2 << 20
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
EMPTY = sha256(b"").hexdigest()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Anchors:
    """Cuts texts into runs of windows with one anchor; holds the tables of powers."""

    def __init__(self, window: int):
        if window < 1:
            raise ValueError("a window has at least one word")
        self.window, self.gram, self.up, self.down = window, min(GRAM, window), _powers(_STEP, 1), _powers(_BACK, 1)

    def _word_hashes(self, text: bytes) -> np.ndarray:
        out, at = [], 0
        while at < len(text):
            end, stops = at, ()
            while end < len(text) and not len(stops):  # up to the last blank of the block; a longer word is taken whole
                end = min(len(text), end + BLOCK)
                raw = np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)
                blank = BLANK[raw]
                stops = np.flatnonzero(blank)
            if end < len(text):
                end = at + int(stops[-1]) + 1
                raw, blank = raw[: end - at], blank[: end - at]
            if len(raw) >= len(self.up):
                self.up, self.down = _powers(_STEP, 2 * len(raw)), _powers(_BACK, 2 * len(raw))
            edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)])])
            out.append(_mixed((sums[edges[1::2]] - sums[edges[::2]]) * self.down[edges[::2]]))
            at = end
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def runs(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, anchor) of each run; none for a text shorter than a window."""
        none = np.zeros(0, dtype=np.int64)
        words = self._word_hashes(text)
        n = len(words) - self.window + 1
        if n <= 0:
            return none, none, none
        grams = np.zeros(len(words) - self.gram + 1, dtype=np.uint64)
        for j in range(self.gram):
            grams = grams * np.uint64(_STEP) + words[j : j + len(grams)]
        least, place = _mixed(grams), np.arange(len(grams))
        width, span = self.window - self.gram + 1, 1
        while span < width:
            step = min(span, width - span)
            right = least[step:] < least[:-step]
            least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
            span += step
        first = np.flatnonzero(np.diff(place, prepend=-1))
        return first, np.diff(first, append=n), least[first].view(np.int64)


class Wavelet:
    """A wavelet matrix: for each bit of the symbols, from the highest, a packed bit vector with counts."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, now = [], symbols
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (now >> bit & 1).astype(bool)
            packed = np.packbits(np.pad(ones, (0, 128 - len(ones) % 64)), bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            zeros = len(now) - int(ones.sum())
            self.levels.append((bit, packed, before, zeros))
            now = np.concatenate([now[~ones], now[ones]])
        symbols = np.arange(size)
        self.base = self._descend(symbols, np.zeros(size, dtype=np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, packed, before, zeros in self.levels:
            block = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(packed[block] & low)
            at = np.where(symbols >> bit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._descend(symbols, at) - self.base[symbols]


class FMIndex:
    """Backward search over a sequence of word numbers in which 0 ends each segment.

    Suffixes are sorted by their first ``depth`` words or more, which is exact for patterns up to that length.
    """

    def __init__(self, sequence: np.ndarray, size: int, depth: int):
        n, span, rank = len(sequence), 1, sequence.astype(np.int64)
        order = np.argsort(rank, kind="stable")
        while span < depth:
            after = np.zeros(n, dtype=np.int64)
            after[: n - span] = rank[span:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + after
            order = np.argsort(key, kind="stable")
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) > 0)
            span *= 2
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=size))])
        self.wavelet, self.n = Wavelet(sequence[order - 1], size), n

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of the patterns with one more word on their left."""
        both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high])) + np.tile(self.first[symbols], 2)
        return both[: len(low)], both[len(low) :]


def repeated_words(segments: list[bytes], copies: np.ndarray, window: int) -> list[list[int]]:
    """For each distinct segment, its words that lie in a repeated window, as [start, end, start, end, ...].

    A window is repeated if it stands twice in the segments, a segment counting ``copies`` times.
    """
    if not segments:
        return []
    numbers: dict[bytes, int] = {}
    parts = [s.split() for s in segments]
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths + 1)
    sequence = np.zeros(int(ends[-1]), dtype=np.int64)
    words = np.ones(len(sequence), dtype=bool)
    words[ends - 1] = False
    sequence[words] = [numbers.setdefault(w, len(numbers) + 1) for p in parts for w in p]
    index = FMIndex(sequence, len(numbers) + 1, int(lengths.max()))
    begin, found = ends - 1 - lengths, np.zeros(len(sequence) + 1, dtype=np.int64)
    least = np.where(copies > 1, 1, 2)
    active = np.arange(len(segments))
    end, length = ends - 1, np.zeros(len(segments), dtype=np.int64)
    low, high = np.zeros(len(segments), dtype=np.int64), np.full(len(segments), index.n)
    active = active[lengths >= window]
    while len(active):
        at = end[active] - length[active] - 1
        inside = at >= begin[active]
        new_low, new_high = index.extend(np.where(inside, sequence[at], 0), low[active], high[active])
        longer = inside & (new_high - new_low >= least[active])
        grown, done = active[longer], active[~longer]
        low[grown], high[grown] = new_low[longer], new_high[longer]
        length[grown] += 1
        # a longest match of some length to the left of ``end``: its windows are repeated, and the next end to try lies before them
        more = np.maximum(0, length[done] - window + 1)
        hit = done[more > 0]
        np.add.at(found, end[hit] - length[hit], 1)
        np.add.at(found, end[hit], -1)
        end[done] -= np.maximum(1, more)
        low[done], high[done], length[done] = 0, index.n, 0
        active = active[(end - window >= begin)[active]]
    covered = np.cumsum(found)[:-1] > 0
    edges = np.flatnonzero(np.diff(covered & words, prepend=False, append=False))
    out: list[list[int]] = [[] for _ in segments]
    own = np.searchsorted(ends, edges[::2], side="right")
    for s, a, b in zip(own.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out[s] += [a - int(begin[s]), b - int(begin[s])]
    return out


def _described(texts: DataFrame, window: int) -> DataFrame:
    """(row, id, text_key, n_words, sha256 of all words, anchors of its runs) for ``texts (row, id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Anchors(window)
        for batch in batches:
            keys, counts, shas, anchors = [], [], [], []
            for x in batch.column(2):
                text = x.as_py() or b""
                words = text.split()
                keys.append(xxhash.xxh3_128_digest(text))
                counts.append(len(words))
                shas.append(sha256(b" ".join(words)).hexdigest())
                anchors.append(cutter.runs(text)[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(anchors, pa.list_(pa.int64()))],
                names=["row", "id", "text_key", "n_words", "sha", "anchors"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"row {ROW}, id {kind}, text_key binary, n_words bigint, sha string, anchors array<bigint>")


def _segments(texts: DataFrame, window: int) -> DataFrame:
    """The segments of ``texts (row, text, shared array of anchors)`` whose anchor is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Anchors(window)
        for batch in batches:
            rows, starts, keys, parts = [], [], [], []
            for row, (text, shared) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2)), strict=True)):
                first, many, anchor = cutter.runs(text)
                words = text.split()
                for k in np.flatnonzero(np.isin(anchor, np.array(shared, dtype=np.int64))).tolist():
                    a = int(first[k])
                    rows.append(row)
                    starts.append(a)
                    keys.append(int(anchor[k]))
                    parts.append(b" ".join(words[a : a + int(many[k]) + window - 1]))
            yield _segment_batch(batch.column(0).take(pa.array(rows, pa.int64())), starts, keys, parts)

    return texts.mapInArrow(run, SEGMENT)


ROW = "struct<file: bigint, at: bigint>"
SEGMENT = f"row {ROW}, start bigint, anchor bigint, segment binary, words binary"


def _segment_batch(rows: pa.Array, starts: list, keys: list, parts: list[bytes]) -> pa.RecordBatch:
    names = pa.array([xxhash.xxh3_128_digest(p) for p in parts], pa.binary())
    return pa.RecordBatch.from_arrays(
        [rows, pa.array(starts, pa.int64()), pa.array(keys, pa.int64()), names, pa.array(parts, pa.binary())], names=["row", "start", "anchor", "segment", "words"]
    )


def _single_windows(segments: DataFrame, window: int) -> DataFrame:
    """Segments cut into their windows, each its own anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, parts = [], [], []
            for row, (start, own) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 4)), strict=True)):
                words = own.split()
                for a in range(len(words) - window + 1):
                    rows.append(row)
                    starts.append(start + a)
                    parts.append(b" ".join(words[a : a + window]))
            yield _segment_batch(batch.column(0).take(pa.array(rows, pa.int64())), starts, [xxhash.xxh64_intdigest(p) - (1 << 63) for p in parts], parts)

    return segments.select("row", "start", "anchor", "segment", "words").mapInArrow(run, SEGMENT)


def _searched(contents: DataFrame, window: int, shards: int) -> DataFrame:
    """``(segment, ranges, copies)`` of the distinct segments that have repeated windows; one FM-index a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, copies = [], [], []
        for batch in batches:
            names += batch.column(1).to_pylist()
            parts += batch.column(2).to_pylist()
            copies += batch.column(3).to_pylist()
        ranges = repeated_words(parts, np.array(copies), window)
        kept = [k for k, r in enumerate(ranges) if r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[k] for k in kept], pa.binary()), pa.array([ranges[k] for k in kept], pa.list_(pa.int64())), pa.array([copies[k] for k in kept], pa.int64())],
            names=["segment", "ranges", "copies"],
        )

    dealt = contents.select("anchor", "segment", "words", "copies").repartition(shards, "anchor")
    return dealt.mapInArrow(run, "segment binary, ranges array<bigint>, copies bigint")


def _cut(texts: DataFrame) -> DataFrame:
    """(row, n_removed, sha256 of the words left) for ``texts (row, text, ranges)``; ranges may overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                left, at, words = [], 0, text.split()
                for a, b in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
                    left += words[at:a]
                    at = max(at, b)
                left += words[at:]
                removed.append(len(words) - len(left))
                shas.append(sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["row", "n_removed", "kept"])

    return texts.mapInArrow(run, f"row {ROW}, n_removed bigint, kept string")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> tuple[DataFrame, DataFrame]:
    """(described rows, ``(row, ranges)``: words of each distinct text that lie in repeated windows) for a frame that ``stable`` returned.

    Of texts that are the same throughout, one is searched; a text of at least ``window``
    words that stands twice is repeated as a whole, which the caller adds.
    """
    base = row_table(docs, id=F.col(id_col), text=F.col(text_col).cast("binary"))
    described = materialize(_described(base, window), "described", "zstd")
    reps = described.groupBy("text_key").agg(F.min("row").alias("row"))
    anchors = materialize(described.join(reps, ["text_key", "row"], "left_semi").select("row", F.explode("anchors").alias("anchor")), "anchors")
    shared = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "shared-anchors")
    wanted = join_common(anchors, shared, ["anchor"], "n").groupBy("row").agg(F.collect_set("anchor").alias("shared"))
    segments = materialize(_segments(base.select("row", "text").join(wanted, "row").select("row", "text", "shared"), window), "segments", "zstd")
    discard(anchors, shared)
    contents = materialize(_contents(segments), "contents", "zstd")
    hot = materialize(contents.groupBy("anchor").agg(F.sum(F.length("words")).alias("bytes")).where(F.col("bytes") > HOT).select("anchor"), "hot-anchors")
    made = [segments, contents, hot]
    if not hot.isEmpty():
        # an anchor with too much text for one shard: its segments go as single windows, dealt by their own hashes
        windows = materialize(_single_windows(segments.join(hot, "anchor"), window), "windows", "zstd")
        single = materialize(_contents(windows), "contents", "zstd")
        made += [windows, single]
        segments = segments.join(hot, "anchor", "left_anti").unionByName(windows)
        contents = contents.join(hot, "anchor", "left_anti").unionByName(single)
    total = contents.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
    found = materialize(_searched(contents, window, max(1, -(-total // SHARD))), "matches")
    placed = join_common(segments.select("segment", "row", "start"), found, ["segment"], "copies")
    ranges = placed.select("row", F.expr("transform(ranges, r -> r + start)").alias("ranges"))
    ranges = materialize(ranges.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "ranges")
    discard(*made, found)
    return described, ranges


def _contents(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(F.first("anchor").alias("anchor"), F.first("words").alias("words"), F.count("*").alias("copies"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """``(id_col, n_words, n_removed, kept_sha256)`` for each row of ``docs``.

    Each word of a window of ``window`` words whose sequence starts anywhere else, in the
    same text too, is removed; windows are judged on the input. Null and blank texts have no
    words; texts shorter than a window keep all; equal rows count as elsewhere to each other;
    null and equal ids are kept as they are. An empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    docs = stable(docs)
    described, ranges = repeated_passages(docs, id_col, text_col, window)
    base = row_table(docs, text=F.col(text_col).cast("binary"))
    cut = materialize(_cut(base.join(ranges, "row").select("row", "text", "ranges")), "cut")
    texts = described.groupBy("text_key").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    per_text = materialize(texts.join(cut, "row", "left").select("text_key", "copies", "n_removed", "kept"), "texts")
    rows = join_common(described.select("id", "text_key", "n_words", "sha"), per_text, ["text_key"], "copies")
    discard(ranges, cut)
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
