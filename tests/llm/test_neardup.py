"""The near-dedup stage against brute force at a similarity of 0.8 on five-word shingles."""

import random

import numpy as np
import pytest

from cairnwork.llm import neardup
from cairnwork.storage import materialize


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """Row numbers that stay: the least id of each component, null ids last."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    best = {}
    for i, (doc, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0, len(rows))), (doc is None, doc or 0, i))
    return sorted(str(rows[x[2]]) for x in best.values())


@pytest.mark.parametrize("bucket", [1, 16])
def test_drops_all_at_similarity(spark, bucket):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "one two three"), (None, "one two three")]
    base = [[rng.choice(words) for _ in range(rng.randint(60, 400))] for _ in range(40)]
    for k in range(200):  # similarities from 0.6 to 1, many between 0.8 and 0.95
        text = list(base[k % 40])
        for _ in range(rng.randint(0, len(text) // 28)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((rng.randrange(10_000), " ".join(text)))
    for _ in range(60):  # one large group
        text = list(base[0])
        text[rng.randrange(len(text))] = "x"
        rows.append((rng.randrange(10_000), " ".join(text)))
    docs = materialize(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), "test")
    got = sorted(str((r.doc_id, r.text)) for r in neardup.drop_near_duplicates(docs, bucket=bucket).collect())
    assert got == kept(rows)


def test_bands_find_similarity():
    rng = np.random.default_rng(1)
    found = 0
    for _ in range(1000):
        x = rng.integers(0, 1 << 63, size=240, dtype=np.uint64)
        a, b = x[:216], np.concatenate([x[:192], x[216:]])  # 192 of 240 in common
        found += bool(np.any(neardup.band_keys(np.sort(a)) == neardup.band_keys(np.sort(b))))
    assert found >= 998


def test_no_rows(spark):
    none = materialize(spark.createDataFrame([], "doc_id bigint, text string"), "test")
    assert neardup.drop_near_duplicates(none).count() == 0
