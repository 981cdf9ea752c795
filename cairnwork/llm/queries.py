"""The queries of the corpus operators over a data directory, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnwork.llm import bpe, divergence, exact, fmindex, licences, mixing, orc_tokens, quality, runs, sharding, simhash, url_filter, webp
from cairnwork.llm.rows import short_batches
from cairnwork.storage import load

VOCABULARY = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return load(spark, sf_dir, "documents")


def op1_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op2_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), load(spark, sf_dir, "labels"))


def op3_mix_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_digest(_documents(spark, sf_dir))


def op4_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_table(_documents(spark, sf_dir))


def op5_substring_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.remove_repeats(_documents(spark, sf_dir))


def op6_exact_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_documents(spark, sf_dir))


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed package of public tokenizers has a file; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_documents(spark, sf_dir), vocabulary_path())


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.tokens_via_orc(_documents(spark, sf_dir), vocabulary_path())


def op9_shard_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir), 16)


def op10_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_table(_documents(spark, sf_dir))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(_documents(spark, sf_dir))


# The list of the query (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_bloom_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_golay,
        op2_quality_bradley_terry,
        op3_mix_pivotal,
        op4_licence_sentences,
        op5_substring_fm_index,
        op6_exact_block_names,
        op7_bpe_pair_index,
        op8_orc_tokens,
        op9_shard_hash_tree,
        op10_lossless_webp,
        op11_word_runs,
        op12_url_bloom_join,
        op13_source_divergence,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_block_names": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]', '', 'g') AS packed FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY packed ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY packed) AS group_size,
               row_number() OVER (PARTITION BY packed ORDER BY points DESC, doc_id) = 1 AS kept,
               sha256(packed) AS text_sha256
        FROM t""",
    "op5_substring_fm_index": r"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM t)),
        repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1),
        gone AS (SELECT DISTINCT r, i + k AS p FROM repeated, range(35) s(k)),
        words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
        kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (r, p) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (r)""",
    "op12_url_bloom_join": r"""
        WITH t AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
        rules(h, s, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (SELECT r, max_by(h || s, length(h || s)) AS rule, max_by(v, length(h || s)) AS verdict
                 FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY r)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fits USING (r)""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        words AS (SELECT r, lang, source, term FROM (SELECT r, lang, source, unnest(w) AS term FROM d) WHERE term <> ''),
        kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 30),
        size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        own AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN own USING (lang, source) GROUP BY ALL),
        share AS (SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n, 1 + ((coalesce(own.n, 0) + 5)::HUGEINT * 1000000000) // (g.total + 5 * v)::HUGEINT AS p,
                         1 + ((k.n + 5)::HUGEINT * 1000000000) // (size.total + 5 * v)::HUGEINT AS q
                  FROM g JOIN kept k ON k.lang = g.lang JOIN size ON size.lang = g.lang LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
        gap AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
                 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gap ON gap.lang = a.lang AND gap.source = a.source AND gap.item = b.source),
        rows AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM share WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM rows QUALIFY part = 'pair' OR rank <= 50""",
}
