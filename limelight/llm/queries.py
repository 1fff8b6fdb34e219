"""The named queries of the operators, each over its whole table, next to their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limelight.llm import byte_bpe, decontamination, hard_negatives, hilbert, language_id, license_scan
from limelight.llm import merkle, simhash, suffix_dedup, suffix_tree_lm, toxicity, warc, whitening
from limelight.llm.common import table

OP6 = r"""
WITH d AS (
    SELECT rowid_ AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)
), b AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), p AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), s AS (
    SELECT row, m, i, array_to_string(w[i : i + m - 1], ' ') AS phrase
    FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS i
          FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
), hit AS (
    SELECT row, s.m, i, item_id FROM s JOIN p ON s.phrase = p.phrase AND s.m = p.m
), words AS (
    SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS pos FROM hit) GROUP BY row
), items AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM hit) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""

OP8 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

Query = Callable[[SparkSession, str], DataFrame]


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every seventh vector is filed under the next label.
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=label)


def runnable() -> dict[str, Query]:
    return {
        "op1_hilbert_shards": op1_hilbert_shards,
        "op2_license_scan": op2_license_scan,
        "op3_merkle": op3_merkle,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_suffix_tree_lm": op5_suffix_tree_lm,
        "op6_decontamination": op6_decontamination,
        "op7_toxicity": op7_toxicity,
        "op8_warc": op8_warc,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_simhash": op10_simhash,
        "op11_whitening": op11_whitening,
        "op12_language_id": op12_language_id,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracles() -> dict[str, str]:
    return {"op2_license_scan": license_scan.oracle(), "op6_decontamination": OP6, "op8_warc": OP8}
