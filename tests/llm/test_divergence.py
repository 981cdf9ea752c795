"""The source audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cairnwork.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least=30, top=50):
    n, total_n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = ["".join(c.lower() if c < "\x80" else c for c in w) for w in TERM.findall(text or "")]
        groups.add((lang, source))
        n[lang, source].update(words)
        total_n[lang].update(words)
        docs[lang].update(set(words))
    kept = {lang: [t for t, d in docs[lang].items() if d >= least] for lang, _ in groups}
    share = lambda c, terms: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in terms) + 5 * len(terms)) for t in terms}
    p = {g: share(n[g], kept[g[0]]) for g in groups}
    out = []
    for lang, source in groups:
        own, q = p[lang, source], share(total_n[lang], kept[lang])
        pairs = [(s, sum(abs(own[t] - p[lang, s][t]) for t in kept[lang])) for x, s in groups if x == lang and s != source]
        terms = [(t, own[t] - q[t]) for t in kept[lang] if n[lang, source][t] and own[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def made(seed, rows=900):
    draw = random.Random(seed)
    words = ["the", "The", "é", "É", "naïve", "a1b", "x-y", "don't", "\u00a0", "ß\u2028z", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120))]
    for _ in range(rows):
        lang = draw.choice(["en", "en", "de", None])
        source = draw.choice(["s0", "s0", "s1", "S1", "é", None])
        text = " ".join(words[min(len(words) - 1, int(draw.expovariate(0.05)))] for _ in range(draw.randrange(60)))
        yield lang, source, draw.choice([text] * 12 + [None, "", "12 34 _"])
    yield from [("rare", "a", "one two"), ("rare", "b", "two"), ("none", "a", None), ("none", "b", "")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").withColumn("n", F.lit(1)).withColumn("times", F.lit("x")).repartition(3)


def test_audit_equals_plain_counting(spark):
    rows = list(made(1))
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == plain(rows)
    assert sorted(map(tuple, divergence.audit(frame(spark, rows), least_docs=3, top=7).collect())) == plain(rows, 3, 7)


def test_repeated_rows_and_an_empty_table(spark):
    rows = list(made(2, 60)) * 40
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == plain(rows)
    assert divergence.audit(frame(spark, rows[:1]).limit(0)).count() == 0


def test_tallies_passed_on_early_change_nothing(spark):
    rows = list(made(3))
    docs = frame(spark, rows)
    few = sorted(map(str, divergence.term_counts(docs, most_held=20).collect()))
    assert few == sorted(map(str, divergence.term_counts(docs).collect()))
    listed = divergence.term_counts(docs).groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources"))
    assert sorted(map(str, divergence.joint_counts(listed, most_held=5).collect())) == sorted(map(str, divergence.joint_counts(listed).collect()))
