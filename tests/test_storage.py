import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limelight import schema
from limelight.operators import features
from limelight.plans.dataset import Processor
from limelight.plans.layout import spread
from limelight.sources import datasets, jdbc, scratch
from tests.test_features import repositories

PAIR = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def test_write_limits_file_size_and_keeps_the_schema(spark, tmp_path):
    df = spark.range(7000).select(F.lit("x").alias("v"), "id").coalesce(1)
    path = str(tmp_path / "out")
    datasets.write_dataset(df, path, PAIR)
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 3
    assert datasets.declared_schema(spark, path) == PAIR
    back = datasets.read_dataset(spark, path)
    assert back.columns == ["id", "v"] and back.count() == 7000
    datasets.write_dataset(df.limit(5), path, PAIR)
    assert datasets.read_dataset(spark, path).count() == 5
    with pytest.raises(schema.SchemaMismatch):
        datasets.write_dataset(df.drop("v"), path, PAIR)
    assert datasets.read_dataset(spark, path).count() == 5


def test_materialise_once(spark, tmp_path):
    paths = {p: str(tmp_path / p) for p in ("train", "test")}
    calls = []

    def compute():
        calls.append(1)
        df = spark.range(10).select("id", F.lit("x").alias("v"))
        return {"train": df.filter("id < 8"), "test": df.filter("id >= 8")}

    for expected_calls in (1, 1):
        parts = datasets.materialise_once(spark, paths, PAIR, compute)
        assert (parts["train"].count(), parts["test"].count(), len(calls)) == (8, 2, expected_calls)
    # A data set whose write was broken off is not taken for complete.
    (tmp_path / "test" / "_SUCCESS").unlink()
    datasets.materialise_once(spark, paths, PAIR, compute)
    assert len(calls) == 2


def test_processor(spark, tmp_path):
    raw = repositories(spark, 200)
    paths = {p: str(tmp_path / p) for p in ("train", "test")}
    parts = Processor(raw).load_or_process(paths, schema.FEATURES, *features.popularity_stages())
    assert parts["train"].count() + parts["test"].count() == 200
    assert 20 < parts["test"].count() < 65
    names = lambda p: sorted(r.name for r in p["test"].collect())
    moved = Processor(raw.repartition(7))
    assert names(moved.process_data(*features.popularity_stages())) == names(parts)
    assert moved.preview("train", 3).count() == 0  # the dates are null in every row
    again = Processor(raw).load_or_process(paths, schema.FEATURES)
    assert names(again) == names(parts)
    half = Processor(raw, load_percent=50).raw_data.count()
    assert 60 < half < 140
    rows = Processor(raw).process_data(*features.popularity_stages(), positional=True)
    assert rows["train"].count() + rows["test"].count() == 200


def test_fit_on_train_does_not_see_test_rows(spark):
    raw = repositories(spark, 200)
    ends = lambda df: tuple(df.agg(F.min("target"), F.max("target")).first())
    everything = Processor(raw).process_data(*features.popularity_stages())
    train_only = Processor(raw).process_data(*features.popularity_stages(), fit_on="train")
    assert ends(train_only["train"]) == (0.0, 1.0)
    both = everything["train"].unionByName(everything["test"])
    assert ends(both) == (0.0, 1.0)


def test_scan_arguments(spark):
    with pytest.raises(ValueError, match="partition column"):
        jdbc.scan_table(spark, "jdbc:none", "t", {}, partitions=100)
    with pytest.raises(ValueError, match="lower, upper"):
        jdbc.scan_table(spark, "jdbc:none", "t", {}, column="c")
    many = [str(i) for i in range(25_000)]
    kept = jdbc.fewer_boundaries(many, 9_999)
    assert 8_000 < len(kept) <= 9_999 and set(kept) <= set(many) and jdbc.fewer_boundaries(kept, 9_999) == kept
    assert jdbc.sampled_relation("t", None, 1) == jdbc.sampled_relation("t", 100, 1) == "t"
    assert jdbc.sampled_relation("t", 10, 1) == "(SELECT * FROM t TABLESAMPLE SYSTEM(10) REPEATABLE(1)) AS sampled"


def test_scan_predicates_cover_each_row_once(spark):
    df = spark.createDataFrame([(f"2020-01-{d:02d}",) for d in range(1, 29)] + [(None,)], "c string")
    for boundaries in ([], ["2020-01-10"], ["2020-01-05", "2020-01-06", "2020-01-20"]):
        clauses = jdbc.range_predicates("c", boundaries)
        found = [r.c for clause in clauses for r in df.filter(clause).collect()]
        assert sorted(map(str, found)) == sorted(str(r.c) for r in df.collect())


class Session:
    """As much of a session as the choice of the scratch folder looks at."""

    def __init__(self, master, folder=None):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}"


def test_scratch_folder(spark):
    assert scratch.scratch_root(Session("yarn", "hdfs:///shared/")) == "hdfs:///shared/limelight"
    assert scratch.scratch_root(Session("local[2]", "file:/shared")) == "file:/shared/limelight"
    local = Session("local[2]")
    assert scratch.scratch_root(local) == scratch.scratch_root(local)
    with pytest.raises(RuntimeError):
        scratch.scratch_root(Session("yarn"))
    stored = scratch.materialise(spark.range(5), "t")
    assert scratch.scratch_root(spark).removeprefix("file:") + "/t-" in stored.inputFiles()[0]


def test_spread_only_small_inputs(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    assert spread(small, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    large = spark.range(1 << 30)
    assert spread(large, "id") is large
