"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct word pieces of a block of texts are laid out as one linked list of symbols.
An index maps each mergeable pair to all positions where it stands. Ranks that have
positions are active; the lowest active rank is applied to all its positions from left to
right, and each merge enters the two pairs it creates into the index. A rank is taken
once for the whole block, however many texts hold its pair.
"""

from __future__ import annotations

import gc
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The vocabulary file's pre-tokenizer pattern.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END = "</w>"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHIFT = 20
#: Words and pieces remembered by a Python worker, words in one pair index, and bytes of text taken at a time.
MEMO, PIECES, BLOCK, CHUNK = 300_000, 400_000, 60_000, 4 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 letters for themselves, the rest from U+0100 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Splitter:
    """Words as pre-tokens: NFC, lower case, and the pre-tokenizer's pattern; special tokens stand for themselves."""

    def __init__(self, special: dict[str, int]):
        self.special = special
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def pieces(self, word: bytes) -> list[bytes | int]:
        """The pre-tokens of a word (text between white space) in UTF-8; special tokens as ids."""
        if word.isalpha():
            return [word.lower()]
        if word[:-1].isalpha() and word[-1] < 128 and not word[-1:].isalnum():
            return [word[:-1].lower(), word[-1:]]
        text, out = word.decode("utf-8", "replace"), []
        head = text.rstrip(SIGNS)
        if head.isalpha() and unicodedata.is_normalized("NFC", head) and "Σ" not in head and "İ" not in head:
            # letters and then signs, if any: two pieces, as no contraction begins without a letter behind its sign
            return [head.lower().encode(), text[len(head) :].encode()] if len(head) < len(text) else [head.lower().encode()]
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = unicodedata.normalize("NFC", part)
                part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
                out += [x.encode() for x in PIECE.findall(part)]
        return out


class Vocabulary(Splitter):
    """A word-end BPE vocabulary: byte symbols, ranked pairs, token strings and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        ids = data["model"]["vocab"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in (ids | special).items():
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = [ids[x] for x in letters]
        self.last = [ids[x + END] for x in letters]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.rank = {a << SHIFT | b: r for r, (a, b, _) in enumerate(self.merges)}
        self.pair_keys = np.array(sorted(self.rank), dtype=np.int64)
        self.pair_ranks = np.array([self.rank[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        super().__init__(special)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each piece, all pieces through one pair occurrence index."""
        if not pieces:
            return []
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        symbols = np.array(self.inner, dtype=np.int64)[raw]
        symbols[ends - 1] = np.array(self.last, dtype=np.int64)[raw[ends - 1]]
        after = np.arange(1, len(raw) + 1)
        after[ends - 1] = -1
        before = np.arange(-1, len(raw) - 1)
        before[ends - lengths] = -1
        keys = symbols[:-1] << SHIFT | symbols[1:]
        found = np.searchsorted(self.pair_keys, keys)
        found[found == len(self.pair_keys)] = 0
        at = np.flatnonzero((self.pair_keys[found] == keys) & (after[:-1] >= 0)) if len(self.pair_keys) else np.zeros(0, dtype=np.int64)
        ranks = self.pair_ranks[found[at]] if len(at) else at
        order = np.argsort(ranks, kind="stable")
        active, starts = np.unique(ranks[order], return_index=True)
        where = dict(zip(active.tolist(), (x.tolist() for x in np.split(at[order], starts[1:])), strict=True)) if len(at) else {}
        symbol, nxt, prv = symbols.tolist(), after.tolist(), before.tolist()
        heap, rank_of = sorted(where), self.rank.get
        while heap:
            rank = heapq.heappop(heap)
            left, right, new = self.merges[rank]
            for i in sorted(where.pop(rank)):
                j = nxt[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue  # an earlier merge took one of the two
                symbol[i], symbol[j] = new, -1
                k, p = nxt[j], prv[i]
                nxt[i] = k
                if k >= 0:
                    prv[k] = i
                    made = rank_of(new << SHIFT | symbol[k])
                    if made is not None:
                        if made not in where:
                            where[made] = []
                            heapq.heappush(heap, made)
                        where[made].append(i)
                if p >= 0:
                    made = rank_of(symbol[p] << SHIFT | new)
                    if made is not None:
                        if made not in where:
                            where[made] = []
                            heapq.heappush(heap, made)
                        where[made].append(p)
        left_over = np.array(symbol, dtype=np.int64)
        alive = left_over >= 0
        until = np.cumsum(alive)[ends - 1].tolist()
        ids = left_over[alive].tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *until], until, strict=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memo:
    """Token ids of words, remembered over the texts of a worker up to a bound.

    Encoding a text is joining the ids of its words, because the vocabulary drops white
    space: no piece, special token or composed character reaches over it.
    """

    def __init__(self, encode: Callable[[list[bytes]], Iterable], most: int = MEMO):
        self.encode, self.most, self.known = encode, most, {}

    def texts(self, texts: list[bytes]) -> Iterator[Iterator[int]]:
        """The ids of each text."""
        return map(chain.from_iterable, self.words(texts))

    def words(self, texts: list[bytes]) -> Iterator[Iterator]:
        """What is remembered for each word of each text."""
        words = [t.split() for t in texts]
        new = list(set(chain.from_iterable(words)).difference(self.known))
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(set(chain.from_iterable(words)))
        for at in range(0, len(new), BLOCK):
            part = new[at : at + BLOCK]
            self.known.update(zip(part, self.encode(part), strict=True))
        get = self.known.__getitem__
        for own in words:
            yield map(get, own)


def pair_index_words(vocab: Vocabulary) -> Callable[[list[bytes]], Iterable[tuple[int, ...]]]:
    """Encodes distinct words: their distinct pieces go through one pair occurrence index, and are remembered up to PIECES."""
    ids: dict[bytes | int, tuple[int, ...]] = {}

    def encode(words: list[bytes]) -> Iterable[tuple[int, ...]]:
        parts = [vocab.pieces(w) for w in words]
        wanted = set(chain.from_iterable(parts))
        if len(ids) + len(wanted) > PIECES:
            ids.clear()
        new = wanted.difference(ids)
        pieces = [p for p in new if isinstance(p, bytes)]
        ids.update(zip(pieces, vocab.merge(pieces), strict=True))
        ids.update((p, (p,)) for p in new if not isinstance(p, bytes))
        get = ids.__getitem__
        return [tuple(chain.from_iterable(map(get, own))) for own in parts]

    return encode


def chunked(values: pa.Array) -> Iterator[list[bytes]]:
    """Texts of a batch (null as empty), about CHUNK bytes at a time."""
    part, held = [], 0
    for x in values:
        part.append(x.as_py() or b"")
        held += len(part[-1])
        if held >= CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles meanwhile: the many small tuples of words make none, and would be gone through again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_memos: dict[str, Memo] = {}


def worker_memo(path: str) -> Memo:
    """One memo for each vocabulary in a Python worker; it holds nothing that a rerun would miss."""
    if path not in _memos:
        _memos[path] = Memo(pair_index_words(vocabulary(path)))
    return _memos[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` for each row; null and empty texts give an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo(path)
        for batch in batches:
            ids = pa.array([list(x) for part in chunked(batch.column(1)) for x in memo.texts(part)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)``: the token strings joined by spaces, as this vocabulary without a decoder reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(path).tokens.__getitem__
        for batch in batches:
            texts = pa.array([" ".join(map(token, x.as_py() or [])) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)`` for each row of ``docs``.

    Ids are made and decoded again in one pass, so no tokens are shuffled or stored. Null
    texts count as empty; the other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, tokens = worker_memo(path), vocabulary(path).tokens
        token, number = tokens.__getitem__, [str(i) for i in range(len(tokens))].__getitem__
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            with uncollected():
                for part in chunked(batch.column(1)):
                    for x in memo.texts(part):
                        ids = list(x)
                        n.append(len(ids))
                        ids_sha.append(sha256(" ".join(map(number, ids)).encode()).hexdigest())
                        text_sha.append(sha256(" ".join(map(token, ids)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(id_col, F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
