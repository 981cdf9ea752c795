"""Quality, mixing and licences against recomputation outside Spark, on the documents of the smallest directory and odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnwork.llm import licences, mixing, orc_tokens, quality
from cairnwork.llm.queries import ORACLE_SQL, QUERIES, vocabulary_path
from cairnwork.storage import load, materialize

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(None, "w " * 40, None), (None, "w " * 40, None), (None, "x " * 40, None), (7, None, "é"), (8, "", "z"), (9, "long " * 30_000, "z"), (3, "one two three", "Z")]
    frame = spark.createDataFrame(odd, "doc_id bigint, text string, source string")
    return materialize(load(spark, SF, "documents").select("doc_id", "text", "source").unionByName(frame).repartition(3), "test")


def test_targets_and_takes(docs):
    rows = [(r.doc_id, r.source, len(re.findall(WORD, r.text or ""))) for r in docs.collect()]
    sizes = Counter()
    for _, source, n in rows:
        sizes[source] += n
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        rest = sum(weight[s] for s in order if s not in stopped)
        over = {s for s in order if s not in stopped and left * weight[s] / rest >= 3 * sizes[s]} if rest else set()
        if not over:
            break
        stopped |= over
    target = {s: float(3 * sizes[s]) if s in stopped else left * weight[s] / rest for s in order}
    plan = mixing.mix(docs, per_bucket=40, fan_in=4).collect()
    assert {(r.source, r.source_size) for r in plan} == {(s, sizes[s]) for s in order}
    for r in plan:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.extra <= r.rows and 0 <= r.copies + (r.extra > 0) <= 3
    for s in order:
        taken = sum(r.size * (r.copies * r.rows + r.extra) for r in plan if r.source == s)
        assert abs(taken - target[s]) <= max(r.size for r in plan if r.source == s)  # less than the words of one row
    got = Counter((r.doc_id, r["size"]) for r in mixing.mixed_digest(docs).collect())
    assert got == Counter((i, n) for i, _, n in rows)
    assert all(r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"] for r in mixing.mixed_digest(docs).collect())


def test_draws_keep_expectations():
    rng = np.random.default_rng(3)
    mass, fraction = rng.integers(1, 40, 30).astype(float), rng.random(30)
    hits = np.zeros(30)
    for seed in range(600):
        keys = np.array([seed * 1000 + k for k in range(30)])
        out, held = mixing.pivot(mass, fraction, keys)
        if held >= 0:
            out[held] = mixing._draw("last", int(keys[held])) < out[held]
        hits += out
    assert np.abs(hits / 600 - fraction).max() < 5 * 0.5 / math.sqrt(600)


def test_quality_fit_and_scores(spark, docs):
    labels = load(spark, SF, "labels")
    ranker = quality.train(docs, labels)
    texts = {}
    for r in docs.where("doc_id IS NOT NULL").collect():
        texts[r.doc_id] = min(texts.get(r.doc_id, r.text or ""), r.text or "")
    marks = {}
    for r in labels.collect():
        marks.setdefault(r.doc_id, []).append(r.quality)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    known = [(texts[i].encode(), np.mean(m) >= 0.5) for i, m in marks.items() if i in texts and not held[i]]
    x, good = np.array([quality.features(t) for t, _ in known]), np.array([g for _, g in known])
    order = np.lexsort([*x.T, good])
    x, good = x[order], good[order]
    assert np.allclose(x.mean(0), ranker.mean) and len(x) > 50
    # the fit is where the gradient of the logistic loss on differences of preference pairs vanishes
    z = np.clip((x - ranker.mean) / ranker.scale, -6, 6)
    rng = np.random.default_rng(7)
    better, worse = rng.choice(np.flatnonzero(good), 40_000), rng.choice(np.flatnonzero(~good), 40_000)
    gap = (z[better] - z[worse]) @ ranker.weights
    gradient = -((z[better] - z[worse]) * (1 / (1 + np.exp(gap)))[:, None]).mean(0) + 1e-2 * ranker.weights
    assert np.abs(gradient).max() < 1e-6
    single = materialize(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "test")
    ranker = quality.train(single, labels)
    out = {r.doc_id: r for r in quality.classify(single, labels).collect()}
    for r in single.collect()[:60]:
        f = np.array(quality.features((r.text or "").encode()))
        worth = float(np.clip((f - ranker.mean) / ranker.scale, -6, 6) @ ranker.weights)
        score = 1 / (1 + math.exp(-max(-30, min(30, ranker.steepness * (worth - ranker.threshold) + math.log(0.3 / 0.7)))))
        assert math.isclose(out[r.doc_id].score, score, rel_tol=1e-9)
        assert out[r.doc_id].predicted == (score >= 0.3) and out[r.doc_id].held_out == held[r.doc_id]
    unseen = [(out[i].score, marks[i][0]) for i in marks if i in out and held.get(i)]
    wins = [(a > b) + 0.5 * (a == b) for a, p in unseen if p == 1 for b, q in unseen if q == 0]
    assert np.mean(wins) > 0.95


def plain_licences(text, known, rules, gap=3):
    """Sentences by trying every run of pieces, then rules by trying every rule at every place."""
    pieces = [p for p in re.split(r"(?:[.!?;:]+(?=\s|$)|\n)", text) if licences.normalise(p)]
    found, i = [], 0
    while i < len(pieces):
        ends = [j for j in range(i, min(len(pieces), i + 30)) if " ".join(licences.normalise(p) for p in pieces[i : j + 1]) in known]
        if ends:
            found.append((known[" ".join(licences.normalise(p) for p in pieces[i : ends[-1] + 1])], i, ends[-1]))
        i = ends[-1] + 1 if ends else i + 1
    names, out, i = [f[0] for f in found], [], 0
    while i < len(found):
        for licence, wanted in rules:
            own = found[i : i + len(wanted)]
            if tuple(names[i : i + len(wanted)]) == wanted and all(b[1] - a[2] <= gap + 1 for a, b in zip(own, own[1:], strict=False)):
                out.append(licence)
                i += len(wanted) - 1
                break
        i += 1
    return names, out


def test_licences_against_trying_everything(spark, docs):
    rng = random.Random(8)
    made = licences.Recogniser()
    texts = [r.text for r in docs.collect()]
    prose = [t for t in texts if t][:40]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 6)):
            sentence = rng.choice(list(licences.SENTENCES.values()))
            if rng.random() < 0.4:
                at = rng.randrange(len(sentence))
                cut = sentence.find(" ", at)
                sentence = sentence if cut < 0 else sentence[:cut] + "\n" + rng.choice(["", "# ", " * "]) + sentence[cut + 1 :]
            parts += [sentence, *([rng.choice(prose)[:80]] * rng.randint(0, 5))]
        texts.append("\n".join(parts))
    frame = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("matches", F.lit(1)), "test")
    got = {r.doc_id: (r.sentences, [m.licence for m in r.matches]) for r in licences.scan(frame).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == plain_licences(text or "", made.known, licences.RULES), text
    assert sum(len(m) for _, m in got.values()) > 100


def test_orc_files_have_indexes_and_prune(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    ids = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), (F.col("id") % 50).cast("string")).alias("text"))
    orc_tokens.write_tokens(ids, vocabulary_path(), path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    ranges = []
    for f in folder.getFileSystem(conf).listStatus(folder):
        if not f.getPath().getName().endswith(".orc"):
            continue
        reader = jvm.org.apache.orc.OrcFile.createReader(f.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 5000 and reader.getCompressionKind().toString() == "ZSTD" and reader.getNumberOfRows() > 0
        rows = reader.rows()
        footer = rows.readStripeFooter(reader.getStripes().get(0))
        streams = {footer.getStreams(k).getKind().toString() for k in range(footer.getStreamsCount())}
        encodings = {footer.getColumns(k).getKind().toString() for k in range(footer.getColumnsCount())}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= streams and "DIRECT_V2" in encodings  # DIRECT_V2: integer run-length encoding, version 2
        rows.close()
        ranges.append(tuple(spark.read.orc(f.getPath().toString()).agg(F.min("doc_id"), F.max("doc_id")).first()))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))  # files hold disjoint ranges
    one = orc_tokens.read_tokens(spark, path).where("doc_id = 12345")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,12345)]" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    assert [sorted(map(str, x[columns].itertuples(index=False, name=None))) for x in (ours,)] == [sorted(map(str, theirs[columns].itertuples(index=False, name=None)))]
