from datetime import datetime

import pytest
from pyspark.sql import functions as F

from limelight.functions import cleaning, hashing, text, timing


def one(spark, value, kind, expr):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return df.select(expr(F.col("c")).alias("r")).first().r


def test_clean_text(spark):
    for given, want in [("", None), ("\0\0", None), ("a\0b", "ab"), ("ab", "ab"), (None, None)]:
        assert one(spark, given, "string", cleaning.clean_text) == want


def test_safe_int_and_bool(spark):
    for given, want in [("7", 7), ("x", 1), (None, 1), ("", 1), ("99999999999999999999", 1), ("-3", -3)]:
        assert one(spark, given, "string", lambda c: cleaning.safe_int(c, 1)) == want
    for given, want in [("true", True), ("false", False), (None, False), ("maybe", False)]:
        assert one(spark, given, "string", cleaning.safe_bool) is want


def test_times(spark):
    assert one(spark, "2020-02-29T12:30:45Z", "string", cleaning.parse_time) == datetime(2020, 2, 29, 12, 30, 45)
    assert one(spark, "yesterday", "string", cleaning.parse_time) is None
    assert one(spark, "yesterday", "string", cleaning.unreadable_time) is True
    assert one(spark, None, "string", cleaning.unreadable_time) is False
    # Seconds are seconds, not the day of the month.
    assert one(spark, datetime(2020, 2, 29, 12, 30, 45), "timestamp", timing.boundary_text) == "2020-02-29T12:30:45"
    assert one(spark, datetime(1970, 1, 1, 0, 0, 1), "timestamp_ntz", timing.micros) == 1_000_000


def test_period_id_depends_on_boundaries_only(spark):
    a, b = datetime(2020, 1, 1), datetime(2020, 1, 2)
    df = spark.createDataFrame([(a, b), (a, b), (b, a)], "s timestamp, e timestamp")
    ids = [r[0] for r in df.select(timing.period_id(F.col("s"), F.col("e"))).collect()]
    assert ids[0] == ids[1] != ids[2]
    assert ids[0].startswith("h") and len(ids[0]) == 65


def test_arrays_and_json(spark):
    assert one(spark, ["a", None, "b"], "array<string>", cleaning.join_members) == "a, b"
    assert one(spark, [None], "array<string>", cleaning.join_members) is None
    assert one(spark, None, "array<string>", cleaning.join_members) is None
    assert one(spark, list("abcdefg"), "array<string>", lambda c: cleaning.first_members(c, 5)) == list("abcde")
    assert one(spark, '{"a":{"b":1}}', "string", lambda c: cleaning.json_field(c, "a", "b")) == "1"
    assert one(spark, '{"a":null}', "string", lambda c: cleaning.json_field(c, "a", "b")) is None
    assert one(spark, "no json", "string", lambda c: cleaning.json_field(c, "a")) is None


def test_headings(spark):
    for given, want in [("# A b\nx", "# A b"), ("x\n# A", ""), ("none", ""), (None, None), ("###", "###")]:
        assert one(spark, given, "string", text.first_heading) == want
    assert one(spark, "# A\ntext\n## B c\n#", "string", text.headings) == ["# A", "## B c", "#"]
    old = lambda c: text.first_heading(c, text.FIRST_HEADING_OLD, 1)
    assert one(spark, "## Big title!", "string", old) == "Big title"


def test_measures(spark):
    assert one(spark, " two  words\n", "string", text.word_count) == 2
    assert one(spark, "", "string", text.word_count) == 0
    assert one(spark, "a😀b☕👍🏽", "string", text.emoji_count) == 4
    for given, want in [("Big Title", True), ("Big title", False), ("1st Title", True), ("élan", False), ("", True)]:
        assert one(spark, given, "string", text.is_title_case) is want


def test_tokens_and_bigrams(spark):
    assert one(spark, "Élan, 2nd-try! ", "string", text.tokens) == ["élan", "2nd", "try"]
    assert one(spark, "--", "string", text.tokens) == []
    pairs = lambda c: text.bigrams(text.tokens(c))
    assert [tuple(p) for p in one(spark, "a b c", "string", pairs)] == [("a", "b"), ("b", "c"), ("c", None)]
    assert one(spark, "", "string", pairs) == []


def test_key_hash_ignores_layout_and_type_width(spark):
    ids = spark.range(1000)
    a = {r.id: r.h for r in ids.select("id", hashing.key_hash(F.col("id"), 1).alias("h")).collect()}
    b = {
        r.id: r.h
        for r in ids.repartition(7).select("id", hashing.key_hash(F.col("id").cast("int"), 1).alias("h")).collect()
    }
    assert a == b
    assert all(0 <= h < hashing.HASH_RANGE for h in a.values())


def test_split_shares(spark):
    part = hashing.split_name(F.col("id"), {"a": 6, "b": 3, "c": 1}, 1)
    counts = {r[0]: r[1] for r in spark.range(20000).groupBy(part).count().collect()}
    assert set(counts) == {"a", "b", "c"}
    assert abs(counts["a"] - 12000) < 400 and abs(counts["c"] - 2000) < 300
    assert spark.range(20000).filter(hashing.in_sample(F.col("id"), 2.5, 3)).count() in range(400, 600)


@pytest.mark.parametrize("percent", [0.5, 10, 12.5])
@pytest.mark.parametrize("parts", [3, 20])
def test_sample_split_subsets_and_folds_are_independent(spark, percent, parts):
    """Every part of every draw has its share of every other draw: none is empty, none is biased."""
    n = 200_000
    rows = spark.range(n).filter(hashing.in_sample(F.col("id"), percent, 1))
    split = hashing.split_name(F.col("id"), {"train": 0.8, "test": 0.2}, 1).alias("split")
    subset = hashing.subset_number(F.col("id"), parts, 1).alias("subset")
    fold = hashing.subset_number(F.col("id"), parts, 1, "fold").alias("fold")
    found = rows.select(split, subset, fold).groupBy("split", "subset", "fold").count().collect()
    total = sum(r["count"] for r in found)
    fits = lambda got, share: abs(got - share) < 5 * max(share, 1) ** 0.5 + 1
    assert fits(total, n * percent / 100)
    for name, weight in (("train", 0.8), ("test", 0.2)):
        for kind in ("subset", "fold"):
            for i in range(parts):
                got = sum(r["count"] for r in found if r["split"] == name and r[kind] == i)
                assert got and fits(got, total * weight / parts)
