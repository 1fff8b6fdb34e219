"""The registered queries on the smallest tables, against SQL where there is some, and the pipeline against brute force."""

import hashlib
import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from limelight.llm import decontamination, queries, simhash, suffix_dedup, toxicity

from .helpers import prose
from .test_operators import LIBRARY, check_digests, covered, naive_hits, passage_edges

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "pages", "benchmark", "labels")


def as_text(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in places)) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    cursor = connection.execute(queries.oracles()[name])
    columns = [d[0] for d in cursor.description]
    df = queries.runnable()[name](spark, SF_DIR)
    assert as_text(df.collect(), df.columns) == as_text(cursor.fetchall(), columns)


def test_items_without_id_equal_the_sql(spark, tmp_path):
    a, b, c = (prose(i, 14, 5_000) for i in (78, 79, 80))
    texts = [(1, f"x {a} y"), (2, f"{a} {b}"), (3, b), (4, "nothing"), (None, a), (5, f"{a} {c}")]
    rows = [(i, t, "en", "s", len(t)) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(None, a), (7, b), (None, c), (8, b)], "item_id bigint, text string")
    items.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    cursor = connection.execute(queries.oracles()["op6_decontamination"])
    columns = [d[0] for d in cursor.description]
    df = queries.runnable()["op6_decontamination"](spark, str(tmp_path))
    found = df.collect()
    assert as_text(found, df.columns) == as_text(cursor.fetchall(), columns)
    assert {r["doc_id"]: (r["n_items"], r["contaminated"]) for r in found} == {
        1: (1, True), 2: (3, True), 3: (2, True), 4: (0, False), None: (1, True), 5: (1, True)
    }


def test_repeats_of_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op9_suffix_dedup(spark, sf_dir).collect()
    assert len(found) == len(texts)
    check_digests({r["doc_id"]: r for r in found}, texts)


def test_stages_follow_the_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "suffix_array_dedup", "decontamination", "byte_bpe"
    ]


def test_pipeline_against_brute_force(spark, tmp_path):
    passage = prose(77, 120, 5_000)
    item = prose(78, 14, 5_000)
    texts = {i: prose(i, 80, 5_000) for i in range(40)}
    marks = []
    for i in range(0, 40, 4):
        texts[i] = f"nastyone {texts[i]} nastytwo"
    marks = [(i, 1, int(i % 4 == 0)) for i in range(40)]
    texts |= {50: texts[1], 51: texts[2] + " more", 52: f"{texts[3]} {passage}", 53: f"é{passage} {prose(60, 9)}"}
    texts |= {54: f"{prose(61, 30, 5_000)} {item} end", 55: "", 56: prose(62, 40, 5_000)}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    sf_dir = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")

    # Stage by stage in plain Python; the classifier's verdicts are its own.
    verdicts = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, labels).collect()}
    kept = {i: t for i, t in texts.items() if not verdicts[i]}
    assert 0 < len(kept) < len(texts) and 56 in kept
    prints = {i: simhash.simhash(t) % 2**64 for i, t in kept.items()}
    group = {i: i for i in kept}
    for _ in kept:
        for i in kept:
            for j in kept:
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    kept = {i: t for i, t in kept.items() if group[i] == i}
    data = [t.encode() for t in kept.values()]
    for i, t, mark in zip(list(kept), data, covered(data, 200)):
        edges = passage_edges(t, mark)
        kept[i] = suffix_dedup.whole_characters(t, [a for a, _ in edges], [b for _, b in edges])
    assert len(kept[52]) < len(texts[52]) and len(kept[53]) < len(texts[53])
    hits = naive_hits(kept, {1: item}, decontamination.WINDOW)
    kept = {i: t for i, t in kept.items() if not hits[i][1]}
    assert 54 not in kept

    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(found) == set(kept)
    for i, text in kept.items():
        ids = np.array(LIBRARY.encode_ordinary(text), dtype="<u4").tobytes()
        assert found[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
