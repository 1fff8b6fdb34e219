import random
from datetime import datetime

from pyspark.sql import functions as F

from limelight.operators import keyed, quality
from limelight.plans import skew


def test_latest_is_independent_of_order(spark):
    rows = [("a", i, f"v{i}") for i in range(50)] + [("b", 1, "x"), ("c", 0, None)]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "id string, seq int, v string").repartition(3 + seed)
        got = {r.id: r.v for r in keyed.latest_per_key(df, ["id"], ["seq"]).collect()}
        assert got == {"a": "v49", "b": "x", "c": None}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "id string, seq int, v string")
    new = spark.createDataFrame([("b", 2, "new"), ("c", 2, "new")], "id string, seq int, v string")
    once = keyed.upsert(old, new, ["id"], ["seq"])
    twice = keyed.upsert(once, new, ["id"], ["seq"])
    want = [("a", "old"), ("b", "new"), ("c", "new")]
    for df in (once, twice):
        assert sorted((r.id, r.v) for r in df.collect()) == want


def test_upsert_takes_the_higher_sequence_from_either_side(spark):
    rng = random.Random(3)
    old = {k: rng.randrange(100) for k in range(40)}
    changes = [(rng.randrange(60), rng.randrange(100)) for _ in range(100)]
    changes = list(dict.fromkeys(c for c in changes if old.get(c[0]) != c[1]))
    rows = lambda pairs, source: spark.createDataFrame([(k, s, source) for k, s in pairs], "id int, seq int, v string")
    got = keyed.upsert(rows(old.items(), "old"), rows(changes, "new"), ["id"], ["seq"]).collect()
    want = {k: (s, "old") for k, s in old.items()}
    for k, s in changes:
        want[k] = max(want.get(k, (-1, "")), (s, "new"))
    assert len(got) == len(want)
    assert {r.id: (r.seq, r.v) for r in got} == want


def test_upsert_does_not_shuffle_the_stored_rows(spark, tmp_path, plan):
    spark.range(1000).select("id", F.lit(1).alias("seq")).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    changes = spark.createDataFrame([(5, 2)], "id bigint, seq int")
    assert "Exchange hashpartitioning" not in plan(keyed.upsert(stored, changes, ["id"], ["seq"]))


def test_upsert_with_many_changes(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 10)
    stored = spark.range(100).select("id", F.lit(1).alias("seq"))
    changes = spark.range(50, 150).select("id", F.when(F.col("id") % 2 == 0, 2).otherwise(0).alias("seq"))
    got = {r.id: r.seq for r in keyed.upsert(stored, changes, ["id"], ["seq"]).collect()}
    want = {i: 1 for i in range(100)} | {i: 2 if i % 2 == 0 else 1 if i < 100 else 0 for i in range(50, 150)}
    assert got == want


def test_latest_prunes_before_the_shuffle(spark, plan):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    text = plan(keyed.latest_per_key(df, ["k"], ["id"]))
    assert "Partial" in text[text.index("Exchange") :]


def test_dedup(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "id string, v int")
    assert sorted(tuple(r) for r in keyed.dedup_by_key(df, ["id"], ["v"]).collect()) == [("a", 1), ("b", 3)]


def test_ledger(spark):
    d = [datetime(2024, 1, i) for i in range(1, 6)]
    periods = spark.createDataFrame(list(zip(d, d[1:])), "startdate timestamp, enddate timestamp")
    ledger = keyed.seed_ledger(periods)
    assert all(r.nextpage and r.after is None for r in ledger.collect())
    progress = spark.createDataFrame(
        [(d[0], d[1], False, "c9"), (d[1], d[2], True, "c1"), (d[2], d[3], False, None)],
        "startdate timestamp, enddate timestamp, nextpage boolean, after string",
    )
    ledger = keyed.update_ledger(ledger, progress)
    got = {r.startdate: (r.nextpage, r.after) for r in ledger.collect()}
    assert got == {d[0]: (False, "c9"), d[1]: (True, "c1"), d[2]: (False, None), d[3]: (True, None)}
    assert sorted(r.startdate for r in keyed.unfinished(ledger).collect()) == [d[1], d[3]]
    assert sorted(r.startdate for r in keyed.pending_periods(periods, ledger).collect()) == [d[1], d[3]]
    # A period the ledger does not know is pending too.
    assert keyed.pending_periods(periods, progress.limit(0)).count() == 4


def test_audit(spark):
    rows = [(1, "a", 5), (1, "b", -1), (None, "c", None), (2, None, 0), (3, "z", 1), (4, "z", 1)]
    df = spark.createDataFrame(rows, "id int, parent string, n int")
    parents = spark.createDataFrame([("a",), ("b",), ("c",)], "p string")
    rules = [
        quality.PrimaryKey(["id"]),
        quality.ForeignKey(["parent"], parents, ["p"]),
        quality.NotNull("parent"),
        quality.Check("n >= 0", F.col("n") >= 0),
    ]
    got = {r.rule: (r.violations, r.rows) for r in quality.audit_constraints(df, rules).collect()}
    assert got == {
        "primary key (id)": (2, 3),
        "foreign key (parent)": (1, 2),
        "not null (parent)": (1, 1),
        "check (n >= 0)": (1, 1),
    }
    clean = {r.rule: r.violations for r in quality.audit_constraints(df.limit(0), rules).collect()}
    assert set(clean.values()) == {0}
    assert [r.copies for r in quality.duplicated_keys(df, ["id"]).collect()] == [2]
    assert [r.n for r in quality.fill_defaults(df, {"n": 9}).filter("id is null").collect()] == [9]


def test_latest_of_stored_moves_repeated_keys_only(spark, monkeypatch):
    """The same rows as `latest_per_key`, null keys included; with few repeats the single rows are not windowed."""
    from limelight.operators import keyed
    from limelight.plans import skew

    windowed, plain = [], keyed.latest_per_key
    rows = [(k, s, "x" * 9) for s in (1, 2) for k in ((1, 2, 3, None) if s == 1 else (2, None))]
    df = spark.createDataFrame(rows, "id bigint, seq bigint, text string")
    monkeypatch.setattr(keyed, "latest_per_key", lambda d, *a: windowed.append(d.count()) or plain(d, *a))
    want = sorted(plain(df, ["id"], ["seq"]).collect(), key=str)
    assert sorted(keyed.latest_of_stored(df, ["id"], ["seq"]).collect(), key=str) == want
    assert windowed == [4]
    assert keyed.latest_of_stored(df.filter("seq = 1"), ["id"], ["seq"]).count() == 4 and windowed == [4]
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    assert sorted(keyed.latest_of_stored(df, ["id"], ["seq"]).collect(), key=str) == want
