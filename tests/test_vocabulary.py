import math
import random
from collections import Counter

import pytest

from limelight.operators import vocabulary as V
from limelight.plans import skew
from limelight.plans.skew import hot_keys, lookup_join


@pytest.fixture(params=["broadcast", "split"], autouse=True)
def join_path(request, monkeypatch):
    """Both ways of the lookup join: the whole lookup broadcast, and hot and other keys apart."""
    if request.param == "split":
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    return request.param


@pytest.fixture(scope="module")
def corpus(spark):
    """'the' is in every text and makes up a third of all words."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = {}
    for doc in range(120):
        body = [rng.choice(words) for _ in range(40)]
        body += ["The"] * 20 + (["cats"] if doc % 2 else ["cat"])
        rng.shuffle(body)
        texts[doc] = " ".join(body)
    texts[200], texts[201] = "", "single"
    return texts, spark.createDataFrame(list(texts.items()), "doc bigint, text string")


def split(text):
    return [w for w in text.lower().split(" ") if w]


@pytest.mark.parametrize("join_path", ["broadcast"], indirect=True)
def test_counts(corpus):
    texts, df = corpus
    bags = {d: Counter(split(t)) for d, t in texts.items()}
    want = sum(bags.values(), Counter())
    assert {r.token: r.n for r in V.token_counts(df, "doc", "text").collect()} == want
    got = {(r.doc, r.token): r.n for r in V.bag_of_words(df, "doc", "text").collect()}
    assert got == {(d, w): n for d, bag in bags.items() for w, n in bag.items()}
    pairs = Counter()
    for text in texts.values():
        words = split(text)
        pairs.update(f"{a} {b}" for a, b in zip(words, words[1:]))
    assert {r.bigram: r.n for r in V.bigram_counts(df, "doc", "text").collect()} == pairs


@pytest.mark.parametrize("join_path", ["broadcast"], indirect=True)
def test_vocabulary(corpus):
    texts, df = corpus
    frequency = Counter(w for t in texts.values() for w in set(split(t)))
    n = len(texts)
    want = {w: f for w, f in frequency.items() if 0.01 * n <= f <= 0.6 * n and w != "cat"}
    got = {r.token: r.df for r in V.vocabulary(df, "doc", "text", 0.01, 0.6, ["cat"]).collect()}
    assert got == want and "the" not in got
    assert V.vocabulary(df, "doc", "text").count() == len(frequency)


def test_tf_idf(corpus):
    texts, df = corpus
    frequency = Counter(w for t in texts.values() for w in set(split(t)))
    got = {(r.doc, r.token): (r.tf, r.df, r.tfidf) for r in V.tf_idf(df, "doc", "text").collect()}
    seen = 0
    for doc, text in texts.items():
        for word, tf in Counter(split(text)).items():
            want = tf * math.log((len(texts) + 1) / (frequency[word] + 1))
            assert got[doc, word][:2] == (tf, frequency[word])
            assert math.isclose(got[doc, word][2], want, abs_tol=1e-12)
            seen += 1
    assert seen == len(got)


def test_tf_idf_equals_spark_ml(spark, corpus):
    from pyspark.ml.feature import IDF, CountVectorizer
    from limelight.functions.text import tokens
    from pyspark.sql import functions as F

    _, df = corpus
    words = df.select("doc", tokens(F.col("text")).alias("words"))
    counter = CountVectorizer(inputCol="words", outputCol="tf").fit(words)
    counted, known = counter.transform(words), counter.vocabulary
    ml = IDF(inputCol="tf", outputCol="v").fit(counted).transform(counted).collect()
    want = {(r.doc, known[i]): x for r in ml for i, x in zip(r.v.indices, r.v.values)}
    got = {(r.doc, r.token): r.tfidf for r in V.tf_idf(df, "doc", "text").collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)


def test_lemmas(spark, corpus):
    texts, df = corpus
    dictionary = spark.createDataFrame([("cats", "cat"), ("the", "def"), ("unused", "x")], "token string, lemma string")
    lemma = {"cats": "cat", "the": "def"}
    bags = {d: Counter(lemma.get(w, w) for w in split(t)) for d, t in texts.items()}
    got = {r.lemma: r.n for r in V.lemma_counts(df, "doc", "text", dictionary).collect()}
    assert got == sum(bags.values(), Counter())
    got = {(r.doc, r.lemma): r.n for r in V.lemma_bags(df, "doc", "text", dictionary).collect()}
    assert got == {(d, w): n for d, bag in bags.items() for w, n in bag.items()}


def test_lookup_join(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, v int")
    lookup = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 1500, 2)], "k string, x int")
    weights = df.groupBy("k").count()
    assert [r.k for r in hot_keys(weights, "count").collect()] == ["hot"]
    for how in ("inner", "left"):
        got = sorted(map(str, lookup_join(df, lookup, "k", lambda: weights, "count", how).collect()))
        assert got == sorted(map(str, df.join(lookup, "k", how).collect()))


@pytest.mark.parametrize("join_path", ["broadcast"], indirect=True)
def test_bags_of_single_rows_are_not_moved(spark, corpus, plan, monkeypatch):
    monkeypatch.setattr(V, "spread", lambda df, key: df)
    for bags in (V.bag_of_words(corpus[1], "doc", "text"), V.tf_idf(corpus[1], "doc", "text")):
        assert "hashpartitioning(doc" not in plan(bags)


def test_rows_of_one_key_make_one_bag(spark):
    """Also those without a key, and texts that are null, empty or without a token."""
    rows = [(1, "b a b"), (2, "c"), (1, "a d"), (None, "a"), (None, "a b"), (3, None), (4, ""), (5, "!"), (3, "z z")]
    df = spark.createDataFrame(rows, "doc bigint, text string")
    want = {(1, "a"): 2, (1, "b"): 2, (1, "d"): 1, (2, "c"): 1, (None, "a"): 2, (None, "b"): 1, (3, "z"): 2}
    got = [(r.doc, r.token, r.n) for r in V.bag_of_words(df, "doc", "text").collect()]
    assert len(got) == len(want) and {(d, t): n for d, t, n in got} == want
    weights = {(r.doc, r.token): r.df for r in V.tf_idf(df, "doc", "text").collect()}
    assert weights == {(d, t): sum(u == t for _, u in want) for d, t in want}
    lemmas = spark.createDataFrame([("a", "b"), ("c", "x")], "token string, lemma string")
    got = {(r.doc, r.lemma): r.n for r in V.lemma_bags(df, "doc", "text", lemmas).collect()}
    assert got == {(1, "b"): 4, (1, "d"): 1, (2, "x"): 1, (None, "b"): 3, (3, "z"): 2}
