"""Every stage of the pipeline against a plain version, on a table with nulls, ties, repeated rows and planted copies, and the whole run against its stages."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_neardup import kept
from tokenizers import Tokenizer

import corpus_pipeline
from cairnwork.llm import quality
from cairnwork.llm.queries import vocabulary_path
from cairnwork.storage import load, materialize

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data directory: documents of the smallest one, and rows made from them."""
    rng, path = random.Random(9), str(tmp_path_factory.mktemp("data"))
    rows = [tuple(r) for r in load(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect() if len(r.text or "") < 4000]
    good = [r for r in rows if r[1].count(" ") > 60][:12]
    made = []
    for i, (_, text, lang, source, n) in enumerate(good):
        words = text.split()
        made.append((90_000 + i, "  ".join(words) + "\n", lang, source, n))  # the same without white space, and longer
        made.append((50_000 - i, text, lang, None, n))  # the same text under another id and no source
        near = list(words)
        near[rng.randrange(len(near))] = "changed"
        made.append((70_000 + i, " ".join(near), lang, source, n))
        if i % 3 == 0:
            made.append((None, " ".join(near + ["more"]), None, "é", None))
            made += [(60_000, text + " tail", lang, source, n)] * 2  # one row twice
    odd = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0), (2, " \t\n", "en", "a", 3), (3, "word " * 3000, "en", "a", None)]
    schema = load(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").schema
    spark.createDataFrame(rows + made + odd, schema).repartition(3, "doc_id").write.parquet(f"{path}/documents.parquet")
    load(spark, SF, "labels").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def tables(spark, folder):
    """What each stage read and returned, by its place."""
    out = [load(spark, folder, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], folder), "test"))
    return out


def _rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_quality_keeps_what_scores_high_enough(spark, folder, tables):
    ranker = quality.train(tables[0], load(spark, folder, "labels"))
    rows = _rows(tables[0])
    scores = ranker.score(np.array([quality.features((r[1] or "").encode()) for r in rows], dtype=float))
    want = Counter(str(r) for r, s in zip(rows, scores, strict=True) if s >= 0.3)
    assert Counter(map(str, _rows(tables[1]))) == want and 0 < sum(want.values()) < len(rows)


def test_exact_dedup_keeps_one_of_each_text(tables):
    groups = defaultdict(list)
    for r in _rows(tables[1]):
        groups[re.sub(r"[\x20\x09-\x0D]+", "", r[1] or "")].append(r)
    best = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    got = _rows(tables[2])
    assert Counter((r[0], r[1] or "") for r in got) == Counter((r[0], r[1] or "") for r in best)
    assert len(got) < len(_rows(tables[1]))


def test_near_dedup_keeps_one_of_each_component(tables):
    before = [(r[0], r[1]) for r in _rows(tables[2])]
    got = sorted(str((r[0], r[1])) for r in _rows(tables[3]))
    assert got == kept(before) and len(got) < len(before)


def test_the_mix_meets_its_targets(tables):
    rows, taken = _rows(tables[3]), Counter(_rows(tables[4]))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight, stopped = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        left, rest = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped), sum(weight[s] for s in order if s not in stopped)
        over = {s for s in order if s not in stopped and left * weight[s] >= 3 * sizes[s] * rest}
        if not over:
            break
        stopped |= over
    there = Counter(rows)
    for s in order:
        target = 3.0 * sizes[s] if s in stopped else left * weight[s] / rest
        own = {r: n for r, n in there.items() if r[3] == s}
        words = sum(taken[r] * len(WORD.findall(r[1] or "")) for r in own)
        assert abs(words - target) <= max(len(WORD.findall(r[1] or "")) for r in own)
        share = min(3.0, target / sizes[s]) if sizes[s] else 0
        for r, n in own.items():
            assert int(share) * n <= taken[r] <= (int(share) + 1) * n if WORD.search(r[1] or "") else taken[r] == 0
    assert set(taken) <= set(there)


def test_encoding_equals_the_library(tables):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = Counter()
    for doc, text, *_ in _rows(tables[4]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in tables[5].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_the_run_is_its_stages(spark, folder, tables):
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, tables[5].collect()))
