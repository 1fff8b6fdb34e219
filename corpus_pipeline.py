"""The corpus pipeline: toxic documents out, near copies out, repeated passages out, leaks out, then encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of `documents`. A stage decides on rows, not on ids: it numbers its rows itself
(`row_keyed`), so null and repeated ids are judged one row at a time.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from limelight.llm import byte_bpe, decontamination, simhash, suffix_dedup, toxicity  # noqa: E402
from limelight.llm.common import row_keyed, table  # noqa: E402
from limelight.sources.scratch import materialise  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    return row_keyed(docs, "lang", "source", "n_chars")


def _without(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    return keyed.join(rows, "row", "left_anti").select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not call toxic: null and empty texts score alike, repeated rows fare alike."""
    keyed = _keyed(docs)
    return _without(keyed, toxicity.toxic_rows(keyed, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, the first of those; a null id comes last."""
    keyed = _keyed(docs)
    return _without(keyed, simhash.copies(keyed))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of fifty words, or 400 bytes, that occur twice.

    A document may be left with an empty text; a null text becomes empty; the texts of repeated rows go whole.
    """
    left = suffix_dedup.trimmed(docs, "lang", "source", length=suffix_dedup.PASSAGE, words=suffix_dedup.WORDS)
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item; null and empty texts have none, repeated rows fare alike."""
    keyed = _keyed(docs)
    numbered = keyed.select(F.col("row").alias("doc_id"), "text")
    leaks = decontamination.contamination(numbered, table(spark, sf_dir, "benchmark")).filter("size(hits) > 0")
    return _without(keyed, leaks.select(F.col("doc_id").alias("row")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document left."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_digests(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
