"""All three stages, from landed pages to a leaderboard."""

from datetime import datetime

import pytest

from limelight.operators import keyed, quality
from limelight.plans import jobs
from limelight.streaming import ingest
from limelight.streaming.store import VersionedStore
from tests.landed import land, node, page


def repository(i, stars):
    return node(
        f"R{i}",
        stargazers={"totalCount": stars},
        commits={"history": {"totalCount": stars // 2}},
        primaryLanguage={"name": ["py", "js", "go"][i % 3]} if i % 7 else None,
        readme={"text": "# Title\n" + "x" * (i % 50)},
    )


def test_collect_process_model(spark, tmp_path, capsys):
    landing = tmp_path / "landing"
    landing.mkdir()
    place = {n: str(tmp_path / n) for n in ("store", "checkpoint", "train", "test", "out")}
    for first in range(0, 300, 100):
        pages = [page(*[repository(i, i) for i in range(a, a + 50)]) for a in range(first, first + 100, 50)]
        land(landing, f"{first}.json", *pages, {"errors": [{"message": "slow"}]})
    audit = jobs.collect(spark, str(landing), place["store"], place["checkpoint"])
    assert {r.violations for r in audit.collect()} == {0} and audit.count() == 12
    land(landing, "later.json", page(repository(5, 900)))
    arguments = ["collect", "--landing", str(landing), "--fold"]
    jobs.main(arguments + ["--store", place["store"], "--checkpoint", place["checkpoint"]])
    assert "primary key (id)" in capsys.readouterr().out

    parts = jobs.process(spark, place["store"], place["train"], place["test"])
    rows = {r.name: r for r in parts["train"].unionByName(parts["test"]).collect()}
    assert len(rows) == 300
    assert rows["name R5"].target == 1.0 and rows["name R0"].target == 0.0
    assert rows["name R9"].titles == "# Title" and rows["name R9"].fork == 1
    jobs.main(["process", "--store", place["store"], "--train", place["train"], "--test", place["test"]])

    arguments = ["model", "--train", place["train"], "--test", place["test"], "--out", place["out"]]
    jobs.main(arguments + ["--max-models", "2"])
    board = spark.read.parquet(f"{place['out']}/leaderboard").orderBy("rank").collect()
    assert len(board) == 2 and board[0].model_id == "linear"
    predictions = spark.read.parquet(f"{place['out']}/predictions")
    assert predictions.count() == parts["test"].count()
    top = spark.read.parquet(f"{place['out']}/importance").orderBy("importance", ascending=False).first()
    assert (top.model_id, top.feature) == ("forest-20", "commits")


def test_nothing_landed_yet(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    place = {n: str(tmp_path / n) for n in ("landing", "store", "checkpoint", "train", "test")}
    audit = jobs.collect(spark, place["landing"], place["store"], place["checkpoint"])
    assert {r.violations for r in audit.collect()} == {0}
    with pytest.raises(ValueError, match="nothing has been collected"):
        jobs.process(spark, place["store"], place["train"], place["test"])


def test_ledger_rules(spark):
    days = [datetime(2024, 1, d) for d in range(1, 5)]
    spans = list(zip(days, days[1:]))
    periods = spark.createDataFrame(spans[:2], "startdate timestamp, enddate timestamp")
    ledger = keyed.seed_ledger(spark.createDataFrame(spans + spans[:1], periods.schema))
    got = {r.rule.split(" (")[0]: (r.violations, r.rows) for r in quality.audit_constraints(ledger, quality.ledger_rules(periods)).collect()}
    assert got == {"primary key": (1, 2), "foreign key": (1, 1), "not null": (0, 0)}
    assert ingest.current_ledger(VersionedStore(spark, "file:/no/such/folder"), ledger) is ledger
