"""The three stages as jobs for spark-submit.

    spark-submit limelight/plans/jobs.py collect --landing ... --store ... --checkpoint ...
    spark-submit limelight/plans/jobs.py process --store ... --train ... --test ...
    spark-submit limelight/plans/jobs.py model   --train ... --test ... --out ... --max-runtime 120
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from limelight.operators.features import popularity_stages
from limelight.operators.quality import audit_constraints, repository_rules
from limelight.plans.dataset import ModelSearch, Processor
from limelight.schema import FEATURES, REPOSITORIES
from limelight.session import pin_utc
from limelight.sources.datasets import RECORDS_PER_FILE, read_dataset
from limelight.streaming import ingest
from limelight.streaming.store import VersionedStore

NUMBERS = ["commits", "length", "fork", "archived", "locked"]
CATEGORIES = ["primarylanguage", "license"]


def collect(
    spark: SparkSession, landing: str, store_root: str, checkpoint: str, fold: bool = False, prune: bool = False
) -> DataFrame:
    """Take in what has landed since the last run; returns the audit of the stored repositories.

    `prune` removes what folds have replaced: only while nobody reads an older state.
    """
    store = VersionedStore(spark, store_root)
    ingest.run(ingest.upsert_pages(spark, landing, store, checkpoint))
    if fold:
        ingest.compact(store)
    if prune:
        store.prune()
    return audit_constraints(stored_repositories(spark, store), repository_rules())


def stored_repositories(spark: SparkSession, store: VersionedStore) -> DataFrame:
    """The current rows; before the first commit an empty table with their columns."""
    rows = ingest.current_repositories(store)
    return spark.createDataFrame([], T.StructType([*REPOSITORIES.fields, T.StructField("ingest_seq", T.LongType())])) if rows is None else rows


def process(
    spark: SparkSession,
    store_root: str,
    train: str,
    test: str,
    percent: float = 100,
    seed: int = 1,
    records_per_file: int = RECORDS_PER_FILE,
) -> dict[str, DataFrame]:
    """Training and test set of the stored repositories, computed unless both are there already."""
    rows = stored_repositories(spark, VersionedStore(spark, store_root)).drop("ingest_seq")
    if rows.isEmpty():
        raise ValueError(f"nothing has been collected in {store_root}: there are no rows to learn from")
    processor = Processor(rows, percent, seed)
    paths = {"train": train, "test": test}
    return processor.load_or_process(paths, FEATURES, *popularity_stages(), records_per_file=records_per_file)


def model(
    spark: SparkSession,
    train: str,
    test: str,
    out: str,
    max_runtime: float | None = None,
    max_models: int = 0,
    seed: int = 1,
) -> ModelSearch:
    """Train and rank; predictions, leaderboard and importance are written below `out`."""
    parts = read_dataset(spark, train), read_dataset(spark, test)
    search = ModelSearch(*parts, NUMBERS, CATEGORIES, seed=seed, text="readme", key="name")
    results = search.train_models(max_runtime, max_models)
    results.select("name", "target", "prediction").write.mode("overwrite").parquet(f"{out}/predictions")
    search.get_leaderboard().write.mode("overwrite").parquet(f"{out}/leaderboard")
    importance = search.best_model_importance()
    if importance is not None:
        importance.write.mode("overwrite").parquet(f"{out}/importance")
    return search


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    stages = parser.add_subparsers(dest="stage", required=True)
    for stage, names in {
        "collect": ["landing", "store", "checkpoint"],
        "process": ["store", "train", "test"],
        "model": ["train", "test", "out"],
    }.items():
        sub = stages.add_parser(stage)
        for name in names:
            sub.add_argument(f"--{name}", required=True)
        if stage == "collect":
            sub.add_argument("--fold", action="store_true")
            sub.add_argument("--prune", action="store_true")
        else:
            sub.add_argument("--seed", type=int, default=1)
        if stage == "process":
            sub.add_argument("--percent", type=float, default=100)
            sub.add_argument("--records-per-file", type=int, default=RECORDS_PER_FILE)
        if stage == "model":
            sub.add_argument("--max-runtime", type=float)
            sub.add_argument("--max-models", type=int, default=0)
    args = parser.parse_args(arguments)

    spark = pin_utc(SparkSession.builder.appName(f"limelight {args.stage}").getOrCreate())
    if args.stage == "collect":
        collect(spark, args.landing, args.store, args.checkpoint, args.fold, args.prune).show(truncate=False)
    elif args.stage == "process":
        process(spark, args.store, args.train, args.test, args.percent, args.seed, args.records_per_file)
    else:
        search = model(spark, args.train, args.test, args.out, args.max_runtime, args.max_models, args.seed)
        search.get_leaderboard(20).show(truncate=False)


if __name__ == "__main__":
    main()
