"""Runs of words against a definition that tries every period, and linear work on repetitive texts."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cairnwork.llm import runs
from cairnwork.storage import load, materialize

SF = "/root/testdata/sf0.001"


def plain_runs(s, least=6, times=4):
    """Every period q, every maximal stretch of equal words q apart, unless a smaller period holds it too."""
    found = set()
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            word = s[i : j + q]
            if j > i and len(word) >= max(least, times * q) and not any(word[r:] == word[:-r] for r in range(1, q)):
                found.add((i, len(word), q))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_array(s, up):
    rank = {w: k for k, w in enumerate(sorted(set(s), reverse=not up))}
    codes = [rank[w] for w in s]
    after = [next((j for j in range(i + 1, len(s)) if codes[j:] < codes[i:]), len(s)) for i in range(len(s))]
    common = []
    for i, j in enumerate(after):
        k = 0
        while j + k < len(s) and s[i + k] == s[j + k]:
            k += 1
        common.append(k)
    return after, common


def samples():
    draw = random.Random(7)
    for _ in range(1500):
        s = [b"%d" % draw.randrange(draw.choice([1, 2, 2, 3, 6])) for _ in range(draw.randrange(40))]
        if s and draw.random() < 0.6:
            at, p = draw.randrange(len(s)), draw.randint(1, 7)
            s = s[:at] + (s[at : at + p] * 50)[: draw.randrange(60)] + s[at:]
        yield s


def test_arrays_and_runs_equal_the_definition():
    for s in samples():
        for up in (True, False):
            assert runs.lyndon_array(s, up) == plain_array(s, up)
        for least, times in ((6, 4), (6, 3), (2, 5)):
            assert runs.runs_of(s, least, times) == plain_runs(s, least, times)
    with pytest.raises(ValueError):
        runs.runs_of([b"a"] * 9, times=2)


class Counted(bytes):
    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return bytes.__eq__(self, other)

    def __ne__(self, other):
        Counted.seen += 1
        return bytes.__ne__(self, other)

    __hash__ = bytes.__hash__


def fibonacci(n):
    a, b = "b", "a"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize(
    "text",
    [
        lambda n: "a" * n,
        lambda n: "ab" * (n // 2),
        fibonacci,
        lambda n: "".join("ab"[bin(i).count("1") % 2] for i in range(n)),
        lambda n: ("a" * (n // 2) + "b") * 2,
        lambda n: ("a" * int(n**0.5) + "b") * int(n**0.5),
        lambda n: "".join("a" * i + "b" for i in range(int((2 * n) ** 0.5))),
        lambda n: "".join(chr(97 + (i & -i).bit_length()) for i in range(1, n)),
    ],
    ids=["one", "two", "fibonacci", "thue", "halves", "roots", "rising", "ruler"],
)
def test_comparisons_grow_with_the_length(text):
    each = []
    for n in (2_000, 16_000):
        s = [Counted(c.encode()) for c in text(n)]
        Counted.seen = 0
        runs.lyndon_array(s, True), runs.lyndon_array(s, False)
        each.append(Counted.seen / n)
    assert max(each) < 10 and each[1] < 1.3 * each[0]


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {k for start, length, q in found for k in range(start + q, start + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


def test_digest_equals_the_definition_with_nulls_empty_and_repeated_rows(spark):
    own = [(None, "a a a a a a a"), (1, None), (2, ""), (2, ""), (3, " \t\n"), (4, "x " * 9 + "y"), (5, "é ü " * 6), (6, "a\u00a0b " * 7), (7, "a b c a b c a b c a b c a"), (None, None)]
    texts = [(r.doc_id, r.text) for r in load(spark, SF, "documents").select("doc_id", "text").where("length(text) < 6000").collect()]
    docs = spark.createDataFrame(own + texts, "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("n_runs", F.lit("x"))
    got = sorted(map(tuple, runs.run_digest(docs).collect()), key=repr)
    assert got == sorted((plain_digest(*r) for r in own + texts), key=repr)
    assert sum(r[1] > 0 for r in got) > 5
    assert runs.run_digest(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "la " * 300_000 + "end"), (2, "do re mi " * 100_000)], "doc_id bigint, text string")
    assert sorted(map(tuple, runs.word_runs(docs).collect())) == [(1, 0, 300_000, 1), (2, 0, 300_000, 3)]


def test_collapsed_texts_keep_other_columns(spark):
    rows = [(1, "so so so so so so it goes", 5), (2, "no  runs\there", 6), (3, None, 7)]
    docs = materialize(spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` int"), "test")
    assert sorted(map(tuple, runs.collapse_runs(docs).collect())) == [(1, "so it goes", 5), (2, "no  runs\there", 6), (3, None, 7)]
