"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns: a row out for a row in."""

import hashlib

import pytest

import corpus_pipeline
import public_tokenizers
from limelight.llm import byte_bpe, decontamination, hilbert, license_scan, merkle, simhash, suffix_dedup
from limelight.llm import suffix_tree_lm, toxicity, warc

from .helpers import TROUBLE, documents, prose


def labels(spark, rows=((5, 1, 0), (7, 0, None), (None, 1, 1), (8, None, 1), (8, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def items(spark):
    return spark.createDataFrame(
        [(1, prose(1, 40)), (2, "one"), (3, None), (4, ""), (None, "w1 w2")], "item_id bigint, text string"
    )


OPERATORS = {
    "hilbert": lambda d: hilbert.shard_documents(d, 3),
    "merkle": merkle.fingerprints,
    "bpe": lambda d: byte_bpe.encode_digests(
        d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ),
    "lm": lambda d: suffix_tree_lm.score(d, 1 << 16),
    "decontamination": lambda d: decontamination.contamination_digests(d, items(d.sparkSession)),
    "toxicity": lambda d: toxicity.classify(d, labels(d.sparkSession)),
    "dedup": suffix_dedup.removal_digests,
    "simhash": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    found = OPERATORS[name](documents(spark, TROUBLE)).collect()
    key = lambda i: (i is not None, i or 0)
    assert sorted((r["doc_id"] for r in found), key=key) == sorted((i for i, _ in TROUBLE), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark, [])).collect() == []


def test_scan_and_archives_of_nothing(spark):
    assert license_scan.scan(documents(spark, [])).collect() == []
    assert license_scan.scan(documents(spark, TROUBLE)).collect() == []
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive_and_read(pages).collect() == []


def test_no_labels_no_items(spark):
    few = documents(spark, TROUBLE[:5])
    assert {r["score"] for r in toxicity.classify(few, labels(spark, [])).collect()} == {0.5}
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r["contaminated"] for r in decontamination.contamination_digests(few, none).collect())


def test_pages_with_trouble(spark):
    long = "x" * 200
    rows = [(3, "u", long), (1, None, long), (1, None, long), (None, "a b\n", long), (4, "u", None), (5, "u", ""), (6, "", "short"), (7, "u", "short"), (8, "u", "\r\n\r\nWARC/1.1\r\n" + "é" * 3_000_000)]
    found = warc.archive_and_read(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found)
    assert [k for k in kinds if k[2]] == [(0, "revisit", 1, 200), (3, "revisit", 1, 200)]
    assert [(k[0], k[3]) for k in kinds if not k[2]] == [(1, 200), (1, 200), (4, 0), (5, 0), (6, 5), (7, 5), (8, 6_000_014)]


def test_pipeline_judges_rows(spark, tmp_path):
    item, copy, other = prose(78, 14, 5_000), prose(90, 150, 5_000), prose(91, 150, 5_000)
    bad = lambda seed: f"nastyone {prose(seed, 40, 5_000)} nastytwo"
    clean = {i: prose(i, 80, 5_000) for i in range(100, 140)}
    texts = [*TROUBLE, *((i, bad(i) if i % 4 == 0 else t) for i, t in clean.items())]
    texts += [(20, copy), (20, copy), (None, other), (None, other)]
    texts += [(None, bad(7)), (30, bad(8)), (30, prose(92, 60, 5_000))]
    leak = f"{prose(61, 30, 5_000)} {item} end"
    texts += [(None, leak), (31, f"{prose(63, 30, 5_000)} {item} end"), (31, prose(93, 60, 5_000))]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(i, 1, int(i % 4 == 0)) for i in clean]).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    # Of rows with one text one is left, of those without words that with the smallest id; nothing else is a near copy.
    kept = {t: i for i, t in reversed(texts) if t and t.strip() and "nastyone" not in t and item not in t}
    expected = [(i, digest(t)) for t, i in kept.items()] + [(1, digest(""))]
    key = lambda pair: (pair[0] is not None, pair[0] or 0, pair[1])
    assert sorted(((r["doc_id"], r["decoded_sha256"]) for r in found), key=key) == sorted(expected, key=key)
