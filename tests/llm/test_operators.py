"""Corpus operators against brute force on small tables with nulls, blanks, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairnwork.llm import bpe, components, exact, fmindex, licences, mixing, orc_tokens, quality, sharding, simhash, webp
from cairnwork.llm.queries import vocabulary_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, row string, fp int"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, rows):
    """Documents with extra columns whose names clash with those that operators use inside."""
    return materialized(spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 1) for i, t, s in rows], SCHEMA))


def materialized(df):
    from cairnwork.storage import materialize

    return materialize(df.coalesce(1), "test")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(40, 120))) for _ in range(12)]
    out = [(0, None, "a"), (1, "", None), (2, " \t\n", "a"), (3, "one", "b"), (4, "Two words", "b"), (None, base[0], "b")]
    for k in range(60):
        text = base[k % 12].split(" ")
        for _ in range(k % 3):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((10 + k, (" " if k % 2 else "\n").join(text), "abc"[k % 3]))
    out += [out[-1], (200, "a b " * 60, "é"), (201, base[3] + " " + base[4], "é"), (202, "Déjà vu — <|endoftext|> ΑΣ don't 12 ½", "z"), (203, "long " * 30_000, "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_simhash(docs, rows):
    prints = []
    for _, text, _ in rows:
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
        prints.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)))
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    expected = sorted(((rows[i][0], f"{prints[i]:016x}", least[root[i]]) for i in range(len(rows))), key=str)
    assert got(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected


def test_full_buckets_lose_no_link(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(63)}
    for _ in range(300):
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)))
    fps |= {rng.getrandbits(63) for _ in range(50)}
    frame = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for bucket in (1, 64):
        labels = dict(tuple(r) for r in components.connected_components(simhash.fingerprint_links(frame, bucket)).collect())
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2:
                    assert labels.get(a, a) == labels.get(b, b)


def test_exact(docs, rows):
    keys = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in rows]
    best = {}
    for (i, t, _), k in zip(rows, keys, strict=True):
        best[k] = min(best.get(k, (1, True, 0)), (-len(t or ""), i is None, i or 0))
    sizes, out = Counter(keys), exact.exact_duplicates(docs, size=64)
    expected = sorted(((i, best[k][2] if not best[k][1] else None, sizes[k], hashlib.sha256(k.encode()).hexdigest()) for (i, _, _), k in zip(rows, keys, strict=True)), key=str)
    assert got(out, "doc_id", "keep_id", "group_size", "text_sha256") == expected
    assert out.where("kept").count() == len(best) == exact.drop_exact_duplicates(docs).count()


def test_substrings(docs, rows):
    counts, texts = Counter(), [re.findall(WORD, t or "") for _, t, _ in rows]
    for w in texts:
        counts.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    expected = []
    for (i, _, _), w in zip(rows, texts, strict=True):
        gone = {x for k in range(len(w) - 34) if counts[tuple(w[k : k + 35])] > 1 for x in range(k, k + 35)}
        expected.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    for hot in (1 << 21, 500):  # the second cuts the segments of full anchors into windows
        fmindex.HOT = hot
        assert got(fmindex.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=str)
    fmindex.HOT = 1 << 21


def test_mixing(docs, rows):
    out = mixing.mixed_digest(docs).toPandas()
    assert len(out) == len(rows) and sorted(out["size"]) == sorted(len(re.findall(WORD, t or "")) for _, t, _ in rows)
    assert (out["taken"] <= 3 * out["size"]).all() and (out["target"] <= 3 * out["source_size"] + 1e-6).all()
    for (_, target), own in out.groupby(["source_size", "target"]):
        assert abs(own["taken"].sum() - target) <= own["size"].max() * 2
    again = mixing.mixed_digest(docs).toPandas()
    assert sorted(map(str, out.values.tolist())) == sorted(map(str, again.values.tolist()))
    assert mixing.mixed_documents(docs).agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == out["taken"].sum()


def test_pivot_keeps_the_mass():
    mass, fraction = np.arange(1.0, 60), np.linspace(0.05, 0.9, 59)
    out, held = mixing.pivot(mass, fraction, np.arange(59))
    assert abs((out * mass).sum() - (fraction * mass).sum()) < 1e-6
    assert all(x in (0, 1) for k, x in enumerate(out) if k != held)


def test_quality(spark, docs):
    train = table(spark, [(k, ("good calm words " if k % 2 else "BAD!! $$$ %%% ") * (5 + k % 7), "s") for k in range(200)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.classify(train, labels).toPandas()
    assert (out.predicted == out.doc_id % 2).all() and out.held_out.any() and out.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out, strict=True))
    assert quality.classify(docs, labels).count() == docs.count()
    assert quality.classify(docs, labels.limit(0)).where("score = 0.5").count() == docs.count()


def test_tokens(docs, rows):
    library, path = Tokenizer.from_file(vocabulary_path()), vocabulary_path()
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(i, len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for (i, _, _), x in zip(rows, ids, strict=True)]
    assert got(bpe.round_trip_digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=str)
    assert sorted(r.ids for r in bpe.encode(docs, path).collect()) == sorted(ids)
    start, out = 0, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, (rows[k][1] or "").encode()))
    for k in order:
        x = [*ids[k], 2]
        out.append((rows[k][0], start, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
        start += len(x)
    assert got(orc_tokens.tokens_via_orc(docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(out, key=str)


def test_sharding(docs, rows):
    out = sharding.shard_documents(docs, 16).toPandas()
    assert len(out) == len(rows) and out["shard"].between(0, 15).all()
    assert ((out.grown_shard == out["shard"]) | (out.grown_shard == 16)).all()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_tree_moves_only_into_the_new_shard(spark):
    keys = spark.range(20_000)
    for n in (16, 17, 23):
        out = sharding.assign(keys, "id", n, grown=n + 1).where("grown_shard <> shard").select("grown_shard").distinct().collect()
        assert [r[0] for r in out] == [n]
    counts = [r["count"] for r in sharding.assign(keys, "id", 4, weights=[1, 1, 1, 3]).groupBy("shard").count().orderBy("shard").collect()]
    assert abs(counts[3] / 20_000 - 0.5) < 0.02


def test_licences(spark):
    mit = "\n".join(licences.SENTENCES[k] for k in ("mit-grant", "mit-keep", "mit-asis", "mit-liability"))
    rows = [(0, None, "a"), (1, "", "a"), (2, mit, "a"), (3, "x | y\nReleased under the\nMIT Licence.\nLicensed under CC BY-NC 4.0.", "a"), (4, "the MIT License is nice.", "a")]
    out = {r.doc_id: (r.n_sentences, r.n_matches, r.licences) for r in licences.licence_table(table(spark, rows)).collect()}
    assert out == {0: (0, 0, ""), 1: (0, 0, ""), 2: (4, 1, "MIT"), 3: (2, 2, "CC-BY-NC-4.0,MIT"), 4: (0, 0, "")}


@pytest.mark.parametrize("text", [b"", b"a", b"\xff" * 576, b"ab" * 400, b"abcd" * 300, b"abcdefghijk" * 99, bytes(range(256)) * 20, random.Random(1).randbytes(3000), random.Random(2).randbytes(200_000), b"\xff" * 300_000, "é ü ".encode() * 40_000, b"xyz " * 2_600_000])
def test_webp_round_trip(text):
    samples = webp.load_samples(webp.store(text)).tobytes()
    assert samples[: len(text)] == text and len(samples) % 576 == 0 and len(samples) > 0 and set(samples[len(text) :]) <= {255}


def test_empty_tables(spark, docs):
    none, labels = docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int")
    none = materialized(none)
    for out in (
        simhash.near_duplicates(none), quality.classify(none, labels), mixing.mixed_digest(none), licences.licence_table(none), fmindex.remove_repeats(none), exact.exact_duplicates(none),
        bpe.round_trip_digests(none, vocabulary_path()), orc_tokens.tokens_via_orc(none, vocabulary_path()), sharding.shard_documents(none, 16), webp.media_table(none),
    ):
        assert out.count() == 0
