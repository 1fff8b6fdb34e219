"""Language mixtures: n-grams and shares against brute force, held-out labels, mixed texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from limelight.llm import language_id, queries

from .helpers import TROUBLE, documents

SYLLABLES = {"aa": "ka lo mi tu ne".split(), "bb": "shr org wen dat fjo".split(), "cc": "éu xo çi ña öl".split()}


def speech(lang, seed, words=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


def corpus(spark, more=(), each=30):
    rows = [(i, speech(lang, i), lang) for i, lang in enumerate(l for l in SYLLABLES for _ in range(each))]
    return spark.createDataFrame(
        [(i, t, l, "g", 1, 0.5, True) for i, t, l in [*rows, *more]],
        "doc_id bigint, text string, lang string, gram string, n int, score double, held_out boolean",
    )


def brute_bag(text):
    """Windows of three bytes that touch no separator but at their ends."""
    data = b" " + text.lower().encode().translate(language_id.LETTERS) + b" "
    return Counter(data[i : i + 3] for i in range(len(data) - 2) if data[i + 1] != 32)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="abZ é世1.\n", max_size=30), max_size=6), st.sampled_from([8, 1 << 20]))
def test_bags(texts, limit):
    before, language_id.TEXT_SLICE = language_id.TEXT_SLICE, limit
    try:
        got = {}
        for places, owner, grams, count in language_id.bags(texts):
            assert (np.diff(owner) >= 0).all()
            for p in places:
                got[p] = Counter()
            for o, n in zip(owner, count):
                got[places[o]]["all"] += n
                got[places[o]]["kinds"] += 1
    finally:
        language_id.TEXT_SLICE = before
    assert sorted(got) == list(range(len(texts)))
    for place, text in enumerate(texts):
        bag = brute_bag(text)
        assert got[place]["all"] == sum(bag.values())
        assert got[place]["kinds"] <= len(bag)  # hashes may meet


def slow_mixture(model, grams, count):
    """One text by plain loops over the same rules."""
    p = model.frequency[:, grams].astype(float)
    total = count.sum()
    penalty = language_id.PENALTY * math.log(max(total, 2))
    theta = np.zeros(len(p))
    theta[np.argmax((count * np.log(p)).sum(axis=1) + np.log(model.prior))] = 1
    tried = theta > 0
    while not tried.all():
        mix = theta @ p
        slope = (count * (p / mix)).sum(axis=1) - total
        slope[tried] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= penalty:
            break
        tried[best] = True
        new = theta * 0.9
        new[best] = 0.1
        for _ in range(2000):
            weighted = new[:, None] * p
            new = (weighted * (count / weighted.sum(axis=0))).sum(axis=1) / total
        if (count * np.log(new @ p)).sum() - (count * np.log(mix)).sum() > penalty:
            theta = new
    return theta


def test_mixtures_against_loops(spark):
    model = language_id.train(corpus(spark))
    texts = [speech("aa", 900), speech("aa", 901) + " " + speech("bb", 902, 30), speech("cc", 903, 2), "", "zzz qqq"]
    texts += [" ".join(speech(l, 904) for l in SYLLABLES)]
    (places, owner, grams, count), = language_id.bags(texts)
    got = language_id.mixtures(model, len(texts), owner, grams, count)
    for k in range(len(texts)):
        mine = owner == k
        if mine.any():
            assert got[k] == pytest.approx(slow_mixture(model, grams[mine], count[mine].astype(float)), abs=5e-3)
        else:
            assert not got[k].any()


def test_shares_of_mixed_documents(spark):
    mixed = speech("aa", 800, 300) + ". " + speech("bb", 801, 100)
    triple = " ".join(speech(l, 802, 100) for l in SYLLABLES)
    docs = corpus(spark, [(1000, mixed, None), (1001, triple, None), (1002, speech("cc", 803, 3), None)])
    found = {r["doc_id"]: r for r in language_id.predict(docs).filter("doc_id >= 1000").collect()}
    assert found[1000]["languages"] == ["aa", "bb"] and found[1000]["lang_pred"] == "aa"
    size = lambda t: sum(brute_bag(t).values())
    assert found[1000]["score"] == pytest.approx(size(speech("aa", 800, 300)) / size(mixed), abs=0.03)
    assert sorted(found[1001]["languages"]) == ["aa", "bb", "cc"]
    assert found[1002]["languages"] == ["cc"] and found[1002]["score"] == 1.0


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op12_language_id(spark, sf).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    judged = [r["lang_pred"] == langs[r["doc_id"]] for r in found if r["held_out"] and r["lang_pred"] != "und"]
    assert len(judged) > 200 and sum(judged) / len(judged) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 4 == 2][:10]
    docs = corpus(spark, [(i, speech("aa", i), "only held out") for i in ids])
    assert "only held out" not in {r["lang_pred"] for r in language_id.predict(docs).collect()}


def test_language_of_trouble(spark):
    found = language_id.predict(documents(spark, TROUBLE)).collect()
    assert len(found) == len(TROUBLE)
    for r in found:
        assert (r["lang_pred"], r["score"]) == (("und", 0.0) if r["doc_id"] in (1, 2, 3) else (r["lang_pred"], r["score"]))
    assert sum(r["lang_pred"] == "und" for r in found) == 4
    assert language_id.predict(documents(spark, [])).collect() == []
    nothing = corpus(spark, [], each=0).unionByName(corpus(spark, [(1, "text", None), (2, "123", "aa")], each=0))
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(nothing).collect()} == {("und", 0.0)}


def test_very_long_text(spark):
    long = speech("bb", 1, 5) + " "
    docs = corpus(spark, [(5000, long * 100_000, None), (5001, "é" * 2_000_000, None)])
    found = {r["doc_id"]: r for r in language_id.predict(docs).filter("doc_id >= 5000").collect()}
    assert found[5000]["lang_pred"] == "bb" and len(found) == 2
