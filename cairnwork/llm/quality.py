"""Quality classification by Bradley-Terry pairwise ranking.

Each text is described by rates of characters, words and lines. A linear worth function is
learnt from preference pairs (a text labelled good is preferred to one labelled bad): the
probability of a preference is the logistic function of the difference of worths, so the
loss is logistic on feature differences. The threshold is a quantile of the worths of the
labelled sample, and the score maps that threshold to 0.3.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.3
#: Groups of bytes whose rates per byte are features.
BYTE_GROUPS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"?", b".", b",", b";:", b"|", b"$%&#*", b"@", b"=_^~`\\", b"+-", b"/", b"<>", b"()[]{}", b"'\"", b"\n", b" \t",
    bytes(range(128, 256)),
)
FEATURES = len(BYTE_GROUPS) + 11
_GROUP_OF = np.full(256, len(BYTE_GROUPS), dtype=np.intp)
for _i, _group in enumerate(BYTE_GROUPS):
    _GROUP_OF[list(_group)] = _i


def features(text: bytes | None) -> list[float]:
    """The description of one whole text; all zero for null and empty texts."""
    if not text:
        return [0.0] * FEATURES
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    rates = np.bincount(_GROUP_OF, weights=counts, minlength=len(BYTE_GROUPS) + 1)[: len(BYTE_GROUPS)] / len(text)
    words = text.split()
    lines = text.split(b"\n")
    n = max(1, len(words))
    kinds = len(set(words))
    used = counts[counts > 0] / len(text)
    filled = [x for x in lines if x.strip()]
    rest = [
        math.log1p(len(words)), math.log1p(len(lines)), min(len(text) / n, 60) / 10, kinds / n, math.log1p(n / max(1, kinds)),
        1 - len(set(filled)) / max(1, len(filled)), math.log1p(len(words) / max(1, len(filled))),
        float(-(used * np.log(used)).sum()), math.log1p(len(max(words, key=len, default=b""))), (len(text) - sum(map(len, words))) / len(text), 1.0 / n,
    ]
    return [math.log1p(100 * float(r)) for r in rates] + rest


@dataclass(frozen=True)
class Ranker:
    """Standardised weights, the worth at the threshold and the steepness of the score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    steepness: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the worth; 0.3 at the threshold."""
        at = self.steepness * (self.worth(x) - self.threshold) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = 40_000, ridge: float = 1e-2, seed: int = 7) -> Ranker:
    """Fits the worths on ``pairs`` (good, bad) rows of ``x``; with one label only, every score is 0.5."""
    n = x.shape[1] if x.ndim == 2 and len(x) else FEATURES
    if not len(x) or good.all() or not good.any():
        return Ranker(np.zeros(n), np.ones(n), np.zeros(n), math.log(THRESHOLD / (1 - THRESHOLD)), 1.0)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    diff, w = z[better] - z[worse], np.zeros(n)
    for _ in range(25):  # Newton steps on mean log(1 + exp(-diff.w)) + ridge/2 |w|^2
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(n), diff.T @ p / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    worth = z @ w
    # the quantile of worths that parts the labelled rows best, both labels counting alike
    cuts = np.quantile(worth, np.linspace(0.002, 0.998, 499))
    gain = [(worth[good] >= c).mean() + (worth[~good] < c).mean() for c in cuts]
    top = np.flatnonzero(np.array(gain) >= max(gain) - 1e-12)
    return Ranker(mean, scale, w, float(cuts[top[0]]), 1.5 / max(1e-6, float(worth.std())))


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text is divisible by 5 (a null id is not held out)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "good"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> Ranker:
    """Fits a ranker on at most ``sample`` labelled rows, the least by a hash of the id.

    Rows that ``held_out`` names and rows with a null id or label are not used; an id with
    several labels takes their rounded mean, an id with several texts the least one. The
    sample, bounded by the parameter, is broadcast to find its texts, and only its features
    come to the driver. Only the id and the text of ``docs`` and doc_id and quality of ``labels`` are read.
    """
    known = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg((F.avg("quality") >= 0.5).alias("good"))
    known = known.where(F.col("id").isNotNull() & ~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).cast("binary").alias("text"), F.first("good").alias("good"))
    got = found.select("text", "good").mapInArrow(_feature_batches, "x array<double>, good boolean").toArrow()
    if not got.num_rows:
        return fit_pairs(np.zeros((0, FEATURES)), np.zeros(0, dtype=bool))
    x = np.array(got.column("x").to_pylist(), dtype=float)
    good = np.array(got.column("good").to_pylist(), dtype=bool)
    order = np.lexsort([*x.T, good])  # the fit doesn't depend on the order in which rows arrive
    return fit_pairs(x[order], good[order])


def _scored(docs: DataFrame, ranker: Ranker, text: Column, carried: Column) -> DataFrame:
    """``(carried, score)`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t.as_py()) for t in batch.column(1)], dtype=float)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.score(x), pa.float64())], names=["carried", "score"])

    source = docs.select(carried.alias("carried"), text.cast("binary").alias("text"))
    return source.mapInArrow(run, source.select("carried", F.lit(0.0).alias("score")).schema)


def score(docs: DataFrame, ranker: Ranker, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``, which it must not have yet; the score reads the text alone. Null texts score as empty ones."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name}")
    return _scored(docs, ranker, F.col(text_col), F.struct("*")).select("carried.*", F.col("score").alias(name))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` for each row of ``docs``.

    Null and empty texts are scored as texts without features; equal texts score alike; a row
    with a null id is scored and not held out. An empty table gives no rows; without labels of
    both kinds every score is 0.5. Other columns, whatever their names, are not read.
    """
    scored = _scored(docs, train(docs, labels, id_col, text_col, sample), F.col(text_col), F.col(id_col))
    return scored.select(F.col("carried").alias(id_col), held_out(F.col("carried")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``classify`` predicts good, in docs' columns, whatever their names."""
    scored = _scored(docs, train(docs, labels, id_col, text_col), F.col(text_col), F.struct("*"))
    return scored.where(F.col("score") >= THRESHOLD).select("carried.*")
