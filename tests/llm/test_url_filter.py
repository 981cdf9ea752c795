"""Verdicts of URL rules against a plain scan of the list, and the Bloom filter's two kinds of answers."""

import random

from pyspark.sql import functions as F

from cairnwork.llm import url_filter
from cairnwork.llm.queries import URL_RULES
from cairnwork.storage import load, materialize

SF = "/root/testdata/sf0.001"


def plain(url, rules, otherwise="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else otherwise


def judged(spark, urls, rules):
    pages = materialize(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit(3)).withColumn("row", F.lit("x")), "test")
    out = url_filter.judge(pages, url_filter.rule_table(spark, rules))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    return {r[0]: tuple(r)[1:] for r in out.collect()}


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x", "http://internet/", "http://a.net?q=/", "https://a.example.net/en/1#top", "https://a.example.net/EN/1",
    "ftp://x.example.com/de/", "http://example.com/de", "http://a.org/fr/://net/", "://net/a", "http://a..net/", "http://net./", "http://.net/", "http://ÄÖ.net/", "http://u:p@a.net:80/", "a://b://c.net/",
    "http://x.net/en/\nmore", "http://" + "a." * 3000 + "net/" + "p/" * 3000, "http://a.net/", "http://a.net/",
]


def test_verdicts_equal_a_scan_of_the_list(spark):
    assert judged(spark, URLS, URL_RULES) == {k: plain(u, URL_RULES) for k, u in enumerate(URLS)}


def test_many_rules_of_many_shapes(spark):
    draw = random.Random(3)
    labels = ["a", "b", "cc", "net"]
    rules = {(".".join(draw.choices(labels, k=draw.randint(1, 3))), "/" + "".join(draw.choices("xy/", k=draw.randint(0, 4)))) for _ in range(150)}
    rules = [(h, p, draw.choice(["allow", "block"])) for h, p in sorted(rules)]
    urls = [f"http://{'.'.join(draw.choices(labels, k=draw.randint(1, 5)))}/{''.join(draw.choices('xy/', k=6))}?{k}" for k in range(800)]
    assert judged(spark, urls, rules) == {k: plain(u, rules) for k, u in enumerate(urls)}


def test_lists_that_are_empty_repeat_themselves_or_hold_nulls(spark):
    assert set(judged(spark, URLS, []).values()) == {(*plain(u, [])[:2], None, "allow") for u in URLS}
    rules = [("NET", "/", "allow"), ("net", "/", "block"), (None, "/", "block"), ("org", None, "block"), ("", "/", "block"), ("org", "fr", "block"), ("com", "/", None)]
    assert judged(spark, URLS, rules) == {k: plain(u, [("net", "/", "block")]) for k, u in enumerate(URLS)}


def test_no_pages(spark):
    pages = load(spark, SF, "pages")
    assert url_filter.judge(pages.where("page_id < 0"), url_filter.rule_table(spark, URL_RULES)).count() == 0


def test_the_filter_loses_nothing_and_lets_few_pass(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("key"))
    blocks = 5000 * url_filter.BITS_PER_ENTRY // 512
    held = materialize(url_filter.bloom_blocks(listed, blocks), "test")
    assert held.count() <= blocks
    assert url_filter.possible(listed, held, blocks).count() == 5000
    others = spark.range(5000, 105_000).select(F.concat(F.lit("h"), "id").alias("key"))
    assert url_filter.possible(others, held, blocks).count() < 1000
    tight = materialize(url_filter.bloom_blocks(listed, 2), "test")
    assert tight.count() == 2 and url_filter.possible(listed, tight, 2).count() == 5000
