"""The corpus pipeline: quality filter, exact and near deduplication, source mix and token encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnwork.llm import bpe, exact, mixing, neardup, quality
from cairnwork.llm.queries import vocabulary_path
from cairnwork.llm.rows import short_batches
from cairnwork.storage import discard, load, materialize, working


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry ranker scores at 0.3 or more.

    The ranker learns from ``labels`` of the texts at hand. Null texts score as empty ones, equal texts
    alike, texts are read whole, rows of null id too; without labels of both kinds all stay. Columns
    come back as they are, whatever their names; an empty table gives no rows.
    """
    short_batches(spark)
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the one with most code points, then the least id.

    A null text is an empty one; a null id comes last; of rows that tie the first by file and place
    stays. Texts are compared whole; columns come back as they are; an empty table gives no rows.
    """
    return exact.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are 0.8 similar or more: the one of least id.

    Texts without words (null, empty, blank) are one component; texts of fewer than five words are
    one shingle; a null id comes last, then the first by file and place stays. Texts are compared whole; columns come back
    as they are; an empty table gives no rows.
    """
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times.

    A null source is one more source; documents without words are never taken; rows of one id, source
    and size share whole copies, and the first by file and place take what is over. Columns come back as they
    are; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text, for each row of the mix.

    Null texts count as empty; texts are encoded whole, repeated rows alike; only doc_id and text are read; an empty table gives no rows.
    """
    return bpe.round_trip_digests(docs, vocabulary_path())


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact),
    ("near-dedup", drop_near),
    ("mixing sources", mix_sources),
    ("bpe encoding", encode_texts),
]

#: SQL can't express a trained ranker, dependent rounding or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    short_batches(spark)
    docs = load(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES[:-1]:
        with working() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
