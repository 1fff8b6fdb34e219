"""Each operator against a brute-force version, a round trip, or held-out labels."""

import hashlib
import math
import random
import string
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from limelight.llm import byte_bpe, decontamination, hilbert, license_scan, merkle, queries, simhash, suffix_dedup
from limelight.llm import suffix_tree_lm, toxicity, warc
from limelight.llm.common import spaced_words
from limelight.llm.license_templates import TEMPLATES

from .helpers import documents, prose

RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = byte_bpe.Encoder(RANKS)

# Sharding ------------------------------------------------------------------------------------


@pytest.mark.parametrize("dimensions, bits", [(1, 4), (2, 4), (3, 3)])
def test_curve_visits_every_cell_by_unit_steps(spark, dimensions, bits):
    cells = {f"c{i}": (F.col("id") / 2 ** (bits * i)).cast("bigint") % 2**bits for i in range(dimensions)}
    grid = spark.range(2 ** (bits * dimensions)).withColumns(cells)
    rows = hilbert.hilbert_index(grid, {c: F.col(c) for c in cells}, bits, "h").orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(len(rows)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[c] - b[c]) for c in cells) == 1


def test_shards_are_even_and_gapless(spark):
    rows = documents(spark, [(i, prose(i % 7, i % 50)) for i in range(107)])
    found = hilbert.shard_documents(rows, 16).collect()
    sizes = Counter(r["shard"] for r in found)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) == 1
    for shard in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sizes[shard]))
    order = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in found)


def test_files_prune_every_dimension(spark, tmp_path):
    grid = spark.range(4096).selectExpr("id", "id % 64 AS a", "id div 64 AS b")
    dealt = hilbert.hilbert_shards(grid, ["a", "b"], ["id"], 16)
    hilbert.write_shards(dealt, str(tmp_path / "out"))
    box = spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(
        F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1")
    )
    rows = box.collect()
    assert sum(r["a0"] <= 5 <= r["a1"] for r in rows) <= 6 and sum(r["b0"] <= 5 <= r["b1"] for r in rows) <= 6


# Licences ------------------------------------------------------------------------------------


def test_copies_lie_side_by_side(spark):
    texts = [prose(i % 12, 40) for i in range(120)] + [None] * 5 + [""] * 5
    rows = [(i, t, "abc"[i % 3], f"https://host/{i % 5}", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = sorted(hilbert.shard_documents(docs, 7).collect(), key=lambda r: (r["shard"], r["slot"]))
    order = [texts[r["doc_id"]] for r in found]
    runs = [a for a, b in zip(order, [object(), *order]) if a != b]
    assert len(runs) == len(set(texts))  # every group in one piece
    split = sum(len({r["shard"] for r in found if texts[r["doc_id"]] == t}) > 1 for t in set(texts))
    assert split <= 6  # a cut between shards splits one group at most


def test_long_common_beginnings_fall_apart(spark):
    values = [None] * 4 + [f"https://a.very.long/common/beginning/{i:03d}" for i in range(64) for _ in range(3)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    placed, cells = hilbert.quantised(df, ["v"], 5)
    got = {r["v"]: r["cell"] for r in placed.select("v", cells["v"].alias("cell")).collect()}
    assert got[None] == 0 and len(set(got.values())) == 32
    kept = [got[v] for v in sorted(v for v in got if v)]
    assert kept == sorted(kept)


def test_licences(spark):
    words = TEMPLATES["mit"].split()
    words[40] = "changed"
    rows = [(i, f"{prose(i, 70)} {t} {prose(i + 1, 60)}") for i, t in enumerate(TEMPLATES.values())]
    rows += [(100, " ".join(words)), (101, TEMPLATES["mit"][:200]), (102, prose(9, 500))]
    found = {(r["doc_id"], r["license"]): r for r in license_scan.scan(documents(spark, rows)).collect()}
    for i, name in enumerate(TEMPLATES):
        assert found[i, name]["containment"] == 1 and found[i, name]["first_word"] == 70
    assert 0.9 < found[100, "mit"]["containment"] < 1
    assert not any(i in (101, 102) for i, _ in found)


def test_licence_scan_is_native_and_does_not_shuffle(spark, plan):
    shape = plan(license_scan.scan(documents(spark, [(1, "a")])))
    assert "Python" not in shape and "Arrow" not in shape and "Exchange hash" not in shape


# Fingerprints --------------------------------------------------------------------------------


def test_next_document_and_likeness(spark):
    rng = random.Random(3)
    ids = rng.sample(range(1000), 60)
    texts = {i: prose(i, rng.randrange(0, 120)).replace("w7 ", "w7.\n") for i in ids}
    found = {r["doc_id"]: r for r in merkle.fingerprints(documents(spark, list(texts.items()))).collect()}
    order = sorted(ids)
    for i, following in zip(order, [*order[1:], order[0]]):
        text, k = texts[i], len(texts[i]) // 4
        changed = text[: len(text) - k] + texts[following][:k]
        assert found[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert found[i]["fingerprint"] == merkle.fingerprint(text)
        assert found[i]["edited_fingerprint"] == merkle.fingerprint(changed)
        if len(text) > 200:
            assert found[i]["near_edited"] > 0.5 > found[i]["near_next"]


def test_a_third_of_all_rows_with_one_id(spark):
    rows = [(7, prose(i, 3)) for i in range(400)] + [(None, prose(i, 4)) for i in range(300)]
    rows += [(i, prose(1_000 + i, 5)) for i in range(8, 300)] + [(500, None), (501, ""), (501, "z")]
    docs = documents(spark, rows)
    keyed = [((-1 if i is None else i), i, t or "") for i, t in rows]
    first = {}
    for k, _, t in keyed:
        first[k] = min(t, first.get(k, t))
    order = sorted(first)
    following = {k: first[n] for k, n in zip(order, [*order[1:], order[0]])}
    expected = Counter((i, hashlib.sha256(merkle.edited(t, following[k]).encode()).hexdigest()) for k, i, t in keyed)
    got = merkle.fingerprints(docs).collect()
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == expected
    by = {t: r["near_next"] for r in got for t in [r["fingerprint"]]}
    assert all(0 <= v <= 1 for v in by.values())
    parts = merkle._neighbours(docs).filter("turn = 1").groupBy("bucket", "part").count().collect()
    assert max(r["count"] for r in parts) < 300  # of 400 rows with one id


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab#\n .", max_size=60), st.text(alphabet="ab#\n .", max_size=60))
def test_roots_test_equality(a, b):
    assert "".join(line for s in merkle.sections(a) for line in s) == a
    assert (merkle.fingerprint(a)[:32] == merkle.fingerprint(b)[:32]) == (a == b)
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(a)) == 1


@pytest.mark.parametrize("alphabet", ["世界人民大会堂的一是不了在有我他这中来上个国", string.ascii_letters + "+/", "ab"])
@pytest.mark.parametrize("size", [40, 400, 20_000])
def test_pieces_need_no_spaces(alphabet, size):
    rng = random.Random(size)
    draw = lambda n: "".join(rng.choices(alphabet, k=n))
    text = draw(size)
    changed = merkle.edited(text, draw(size))
    a, b = map(merkle.fingerprint, (text, changed))
    assert 0.4 < merkle.likeness(a, b) < 1
    assert max(len(p.lstrip(b"\xff")) for p in merkle.pieces(text.encode())) <= merkle.LONG
    assert b"".join(merkle.cut(text.encode(), *merkle.COARSE)) == text.encode()
    at = len(merkle.pieces(text.encode())[0].decode(errors="ignore"))
    assert merkle.fingerprint(text[:at] + " " + text[at:])[:32] != a[:32]
    if size > 400:
        shifted = merkle.fingerprint(text[:100] + "x" + text[100:])
        assert merkle.likeness(a, shifted) > 0.95
        found = merkle.edited_pieces(a, b)
        assert {(i, j) for i, j, _ in found} == {(0, 0)} and min(k for *_, k in found) > 0.7 * len(merkle.leaves(a))


@pytest.mark.parametrize("separator", ["\t", "\u00a0", " "])
def test_short_and_oddly_parted_texts(separator):
    for words in (4, 8, 500):
        text = separator.join(prose(words, words).split())
        changed = merkle.edited(text, prose(words + 1, words))
        assert 0.3 < merkle.likeness(*map(merkle.fingerprint, (text, changed))) < 1


def test_branches_locate_edits():
    a = "# one\nfirst line\nsecond line\n\n# two\nthird line\n"
    b = a.replace("third", "other")
    assert merkle.edits(merkle.fingerprint(a), merkle.fingerprint(b)) == [(1, 1)]
    assert merkle.edits(merkle.fingerprint(a), merkle.fingerprint(a)) == []


# Encoding ------------------------------------------------------------------------------------


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_encoding_is_the_librarys(text):
    import regex

    ids = [i for p in regex.findall(public_tokenizers.PATTERN, text) for i in ENCODER.encode(p.encode())]
    assert ids == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("piece", ["a" * 50_000, "abcabd" * 8_000, "éß世" * 5_000])
def test_long_pretokens(piece):
    assert ENCODER.encode(piece.encode()) == LIBRARY.encode_ordinary(piece)


def test_round_trip(spark):
    texts = ["", "it's 12  x\n\n y", "É 世界 \U0001f600", prose(1, 500)]
    docs = documents(spark, list(enumerate(texts)))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for r in byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect():
        text = texts[r["doc_id"]]
        assert bytes(r["decoded"]).decode() == text
        assert np.frombuffer(r["ids"], "<u4").tolist() == LIBRARY.encode_ordinary(text)


# Language model ------------------------------------------------------------------------------


def chained(seed, words):
    """Words that mostly follow each other in a ring, so contexts help."""
    rng, at, out = random.Random(seed), 0, []
    for _ in range(words):
        at = (at + 1) % 20 if rng.random() < 0.9 else rng.randrange(20)
        out.append(f"c{at}")
    return " ".join(out)


def test_language_model(spark):
    texts = {i: chained(i, 200) + f" Rare{i}" for i in range(70)}
    found = {r["doc_id"]: r for r in suffix_tree_lm.score(documents(spark, list(texts.items())), 4_000).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    split = lambda text: [*spaced_words(text), b"\n"]
    counts = Counter(t for i, text in texts.items() if not held[i] for t in split(text))
    n, v = sum(counts.values()), len(counts)
    for i, text in texts.items():
        tokens, r = split(text), found[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(tokens), n)
        assert r["n_known"] == sum(counts[t] > 0 for t in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
        assert r["score"] > 0.6 * r["base_score"]  # logarithms: nearer to 0 is better


def test_next_symbols_are_a_distribution(spark):
    chunks = suffix_tree_lm.chunked(documents(spark, [(i, chained(i, 100)) for i in range(40)]), 3_000)
    asked = suffix_tree_lm.with_totals(suffix_tree_lm.asked_tokens(chunks)).filter("first")
    counts = asked.select("token", "ending", F.col("total").alias("n"))
    letters = suffix_tree_lm.alphabet(counts, counts.agg(F.sum("n")).first()[0])
    tree = suffix_tree_lm.grow(chunks, letters)
    assert (10**tree.root).sum() == pytest.approx(1)
    assert len(tree.codes[0]) > 10
    for codes, logs in zip(tree.codes, tree.logs):
        assert (10 ** logs.astype(float)).sum(axis=1) == pytest.approx(np.ones(len(codes)), abs=1e-4)
    for shorter, longer, length in zip(tree.codes, tree.codes[1:], range(1, 9)):
        assert np.isin(longer % tree.size**length, shorter).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é世\u00a0\n\t.", max_size=40)), max_size=8), st.sampled_from([3, 16, 1 << 20]))
def test_hashed_tokens(texts, most):
    before, suffix_tree_lm.SLICE_BYTES = suffix_tree_lm.SLICE_BYTES, most
    try:
        token, ending, lengths = suffix_tree_lm.tokenised(texts, suffix_tree_lm.Words())
    finally:
        suffix_tree_lm.SLICE_BYTES = before
    words = [w for t in texts for w in [*spaced_words(t), None]]
    assert lengths.tolist() == [len(spaced_words(t)) + 1 for t in texts] and len(token) == len(ending) == len(words)
    for hashes, names in ((token, words), (ending, [w if w is None else w.decode()[-2:] for w in words])):
        assert len(set(zip(hashes.tolist(), names))) == len(set(hashes.tolist())) == len(set(names))
    assert all((h == suffix_tree_lm.END) == (w is None) for h, w in zip(token.tolist(), words))


def test_scores_of_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    split = {i: [*spaced_words(t), b"\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i in texts if not held[i] for w in split[i])
    n, v = sum(counts.values()), len(counts)
    found = queries.op5_suffix_tree_lm(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        words = split[r["doc_id"]]
        known = sum(counts[w] > 0 for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(words), known, n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    held_rows = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held_rows) > 0.95 * sum(r["base_score"] for r in held_rows)


def test_chunks_do_not_show(spark):
    rows = [(i % 7, chained(i, 60)) for i in range(40)] + [(3, "same words")] * 30
    docs = documents(spark, rows)
    whole, parts = (
        sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in suffix_tree_lm.score(docs, size).collect())
        for size in (1 << 20, 100)
    )
    assert whole == parts


# Decontamination -----------------------------------------------------------------------------


def naive_hits(texts, items, window):
    words = lambda t: decontamination.plain_words(t)
    wanted = {}
    for item, text in items.items():
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wanted.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = {}
    for key, text in texts.items():
        w, hits, names = words(text), set(), set()
        for size in {len(p) for p in wanted}:
            for i in range(len(w) - size + 1):
                if found := wanted.get(tuple(w[i : i + size])):
                    hits |= set(range(i, i + size))
                    names |= found
        out[key] = (len(w), sorted(hits), sorted(names))
    return out


@pytest.mark.parametrize("vocabulary", [3, 40])
def test_decontamination(spark, vocabulary):
    items = {i: prose(100 + i, 3 + 5 * i, vocabulary) for i in range(6)} | {10: prose(100, 3, vocabulary)}
    texts = {i: prose(i, 60, vocabulary) for i in range(20)}
    texts |= {30 + i: f"{prose(i, 9, vocabulary)}, {t.upper()}! {prose(i, 5, vocabulary)}" for i, t in items.items()}
    frame = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    found = decontamination.contamination(documents(spark, list(texts.items())), frame).collect()
    assert {r["doc_id"]: (r["n_words"], r["hits"], r["items"]) for r in found} == naive_hits(texts, items, 10)


def test_blocks_of_the_test_set_change_nothing(spark):
    docs = documents(spark, [(i, prose(i, 80, 20)) for i in range(10)])
    docs = docs.select(F.col("doc_id").alias("row"), "text")
    frame = spark.createDataFrame([(i, prose(i, 25, 20)) for i in range(5)], "item_id bigint, text string")
    wanted = decontamination.phrases(frame)
    whole = decontamination.candidates(docs, wanted).distinct().collect()
    parts = decontamination.candidates(docs, wanted, block_bytes=600).distinct().collect()
    assert whole and sorted(whole) == sorted(parts)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x b y a z c"), (2, "a x x x x x x b c"), (3, "c b a")], "row bigint, text string")
    frame = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    near = decontamination.proximity_matches(docs, frame, slop=2).collect()
    assert {(r["row"], r["start"], r["stop"]) for r in near} == {(1, 1, 6), (3, 0, 3)}
    assert decontamination.matches(docs, frame).count() == 0


# Toxicity ------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(400):
        bad = rng.random() < 0.3
        words = prose(i, 60).split()
        if bad:
            words[rng.randrange(60)] = rng.choice(["nastyone", "nastytwo"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    found = toxicity.classify(documents(spark, rows), labels).collect()
    truth = {i: t for i, _, t in marks}
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_one_text_for_a_labelled_id(spark, monkeypatch):
    rows = [(i, prose(i, 30)) for i in range(40)] + [(3, prose(3 + k, 20)) for k in range(200)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda y, *rest: (seen.append(len(y)), fit(y, *rest))[1])
    toxicity.train(documents(spark, rows), marks)
    assert seen == [40]


def test_twins_pull_group_mentions_together():
    rng, swap = random.Random(2), toxicity.swaps()
    texts, y = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = set(prose(i, 20).split()) | ({"insult"} if bad else set())
        # The label goes along with the group, but not because of it.
        words.add("muslims" if bad or rng.random() < 0.1 else "christians")
        texts.append({w.encode() for w in words})
        y.append(float(bad))
    x = [toxicity.text_features(w) for w in texts]
    twins = [toxicity.text_features({swap.get(v, v) for v in w}) for w in texts]
    plain = toxicity.fit(np.array(y), x, [None] * len(x))
    fair = toxicity.fit(np.array(y), x, twins)
    gap = lambda m: abs(
        m.logit(toxicity.text_features({b"muslims"})) - m.logit(toxicity.text_features({b"christians"}))
    )
    assert gap(fair) < 0.3 * gap(plain)
    assert np.mean([(fair.logit(f) > 0) == bool(t) for f, t in zip(x, y)]) > 0.95


# Archives ------------------------------------------------------------------------------------


def test_every_record_is_a_member(spark, tmp_path):
    import gzip

    rows = [(i, f"http://x/{i}", prose(i % 4, 50)) for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write_archives(pages, str(tmp_path / "whole"))
    index = warc.normalise(spark, str(tmp_path / "whole"), "file:" + str(tmp_path / "single"))
    whole = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "whole").glob("*.gz")))
    single = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "single").glob("*.warc.gz")))
    assert whole == single and whole.count(b"WARC/1.1\r\n") == 10 == index.count()
    for r in index.collect():
        with open(r["archive"].removeprefix("file:"), "rb") as source:
            source.seek(r["offset"])
            assert gzip.decompress(source.read(r["length"])).startswith(b"WARC/1.1\r\n")
    kinds = Counter(r["record_type"] for r in warc.read_archives(index).collect())
    assert kinds == {"response": 4, "revisit": 6}


def test_cut_stream_is_an_error():
    import gzip

    data = gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc")
    with pytest.raises(ValueError, match="after the last record"):
        list(warc.split_stream(iter([data])))


def test_archives_are_read_in_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h/{i}", prose(i, 200)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "whole"))
    index = warc.normalise(spark, str(tmp_path / "whole"), str(tmp_path / "single"))
    monkeypatch.setattr(warc, "READ_BYTES", 1 << 12)
    assert index.select("archive").distinct().count() == 1
    read = warc.read_archives(index)
    used = read.select("page_id", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in used}) > 4 and sorted(r["page_id"] for r in used) == list(range(60))


# Suffix-array dedup --------------------------------------------------------------------------


def covered(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        mark = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = True
        yield mark


@pytest.mark.parametrize("length", [400, 100])
def test_repeated_strings(spark, length):
    rng = random.Random(length)
    letters = lambda n, of="abcdefgh ": "".join(rng.choice(of) for _ in range(n))
    bases, texts = [letters(2500) for _ in range(4)], []
    for _ in range(40):
        start = rng.randrange(2000)
        part = list(rng.choice(bases)[start : start + rng.randrange(1500)])
        for _ in range(rng.randrange(3)):
            if part:
                part[rng.randrange(len(part))] = "Z"
        texts.append(letters(rng.randrange(300)) + "".join(part) + letters(rng.randrange(300), "xyzéß"))
    texts += ["a" * 1500, "ab" * 500, "", texts[3], texts[3]]
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(documents(spark, list(enumerate(texts))), length).collect()}
    data = [t.encode() for t in texts]
    for i, (t, mark) in enumerate(zip(data, covered(data, length))):
        kept = np.frombuffer(t, np.uint8)[~mark].tobytes()
        edges = np.flatnonzero(np.diff(np.r_[0, mark.astype(int), 0])).tolist()
        assert bytes(found[i]["kept"]) == kept and found[i]["n_removed"] == mark.sum()
        assert (found[i]["starts"], found[i]["ends"]) == (edges[::2], edges[1::2])


def edges_of(mark):
    edges = np.flatnonzero(np.diff(np.r_[0, mark.astype(int), 0])).tolist()
    return list(zip(edges[::2], edges[1::2]))


def passage_edges(data, mark):
    return [(a, b) for a, b in edges_of(mark) if b - a >= 400 or len(data[a:b].split()) >= 50]


def check_digests(found, texts):
    """`found` by doc_id against all strings of 400 and of 200 bytes of `texts`."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    for i, long, short in zip(data, covered(data.values(), 400), covered(data.values(), 200)):
        kept = np.frombuffer(data[i], np.uint8)[~long].tobytes()
        passage = sum(b - a for a, b in passage_edges(data[i], short))
        expected = (len(data[i]), int(long.sum()), len(edges_of(long)), hashlib.sha256(kept).hexdigest(), passage)
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_passage"]) == expected


def test_two_rounds_equal_brute_force(spark):
    rng = random.Random(9)
    bases, texts = [prose(i, 500, 900) for i in range(5)], []
    for _ in range(50):
        start = rng.randrange(1500)
        part = list(rng.choice(bases)[start : start + rng.randrange(1200)])
        for _ in range(rng.randrange(4)):
            if part:
                part[rng.randrange(len(part))] = "Zé"
        texts.append(prose(rng.random(), rng.randrange(60)) + "".join(part) + prose(rng.random(), rng.randrange(60)))
    texts += ["a" * 1500, "ab" * 500, "", None, texts[3], texts[3], "世界" * 300]
    found = suffix_dedup.removal_digests(documents(spark, list(enumerate(texts)))).collect()
    check_digests({r["doc_id"]: r for r in found}, dict(enumerate(texts)))


def test_pieces_of_a_long_text_change_nothing():
    rankers = suffix_dedup._rankers(100)
    text = prose(1, 3_000).encode()
    strings = lambda piece: {
        p for lo, hi in zip(*suffix_dedup.find_runs([text], 100, rankers, piece)[1:3]) for p in range(lo, hi + 1)
    }
    assert strings(1 << 20) == strings(1_000) == set(range(len(text) - 99))


def test_characters_are_not_cut():
    data = "aé世b".encode()  # 1 + 2 + 3 + 1 bytes
    assert suffix_dedup.whole_characters(data, [2], [5]) == "aé世b"
    assert suffix_dedup.whole_characters(data, [1], [5]) == "a世b"
    assert suffix_dedup.whole_characters(data, [0], [7]) == ""


# SimHash -------------------------------------------------------------------------------------


def test_fingerprint_bits(spark):
    text = "The  quick Brown\tfox jumps É"
    words = text.replace("T", "t").replace("B", "b").split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    row = spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()
    h = [r[0] % 2**64 for r in row]
    expected = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.simhash(text) % 2**64 == expected
    assert simhash.simhash("") == simhash.simhash(None) == simhash.simhash(" \n") == 0


@pytest.mark.parametrize("most", [2_000, 6])
def test_links_connect_what_brute_force_connects(spark, most):
    rng = random.Random(most)
    keys = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(150):
        keys.add(rng.choice(sorted(keys)) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))) % 2**64)
    keys = sorted(keys)
    signed = lambda k: k - 2**64 if k >= 2**63 else k

    def groups(links):
        parent = {k: k for k in keys}

        def root(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for a, b in links:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        return {k: root(k) for k in keys}

    brute = groups((a, b) for i, a in enumerate(keys) for b in keys[:i] if (a ^ b).bit_count() <= 3)
    prints = spark.createDataFrame([(signed(k),) for k in keys], "fp bigint")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.near_links(prints, most=most).collect()]
    assert groups(links) == brute
    assert all((a, b) != (b, a) for a, b in links)


def test_near_duplicates(spark):
    base = prose(1, 600)
    rows = [(5, base), (3, base), (9, base + " tail"), (4, prose(2, 600)), (7, ""), (8, None)]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert [found[i]["component_id"] for i in (5, 3, 9, 4, 7, 8)] == [3, 3, 3, 4, 7, 7]
    assert found[7]["fingerprint"] == "0" * 16
