import math
import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limelight import schema
from limelight.operators import explore, features, quantiles, sampling


def test_stages(spark):
    df = spark.createDataFrame([(1, True, None, "# T\nx"), (2, False, True, None)], "id int, fork boolean, locked boolean, readme string")
    cast = features.CastToInt("fork", "locked").transform(df)
    assert [tuple(r) for r in cast.select("fork", "locked").collect()] == [(1, None), (0, 1)]
    assert features.RemoveColumns("id", "unknown").transform(df).columns == ["fork", "locked", "readme"]
    out = features.ExtractTextFeatures("readme").transform(df).collect()
    assert [(r.titles, r.length) for r in out] == [("# T", 5), (None, None)]
    old = features.ExtractTextFeatures("readme", r"^[# ]+(.*)\b", 1).transform(df).first()
    assert old.titles == "T"


def scaled(spark, values, stages):
    df = spark.createDataFrame([(v,) for v in values], "stars bigint")
    stages = [*stages, features.CleanUp("target")]
    out = Pipeline(stages=stages).fit(df).transform(df)
    assert out.columns == ["target"]
    return [r.target for r in out.collect()]


def test_scaling(spark):
    assert scaled(spark, [1, 5, 9], features.min_max_stages()) == [0.0, 0.5, 1.0]
    assert scaled(spark, [1, 5, 9], features.standard_stages()) == [0.25, 1.25, 2.25]
    assert scaled(spark, [4, 4], features.min_max_stages()) == [0.5, 0.5]
    assert scaled(spark, [4, 4], features.standard_stages()) == [0.0, 0.0]
    assert scaled(spark, [1, None, 3], features.min_max_stages(handle_invalid="skip")) == [0.0, 1.0]
    kept = scaled(spark, [1, None, 3], features.min_max_stages(handle_invalid="keep"))
    assert kept[0] == 0.0 and math.isnan(kept[1]) and kept[2] == 1.0
    with pytest.raises(Exception):
        scaled(spark, [1, None, 3], features.min_max_stages())


def repositories(spark, n=40):
    row = lambda i: (
        f"R{i}", f"n{i}", None if i % 3 else "d", "t", "mit", f"# H{i}", ["py", "js"][i % 2], None, None,
        i % 2 == 0, False, False, 1, i, 2, 3, 4, 5, i * 10,
    )
    return spark.createDataFrame([row(i) for i in range(n)], schema.REPOSITORIES)


@pytest.mark.parametrize("scaling", ["min-max", "standard"])
def test_pipeline_survives_saving(spark, tmp_path, scaling):
    df = repositories(spark)
    model = Pipeline(stages=features.popularity_stages(scaling, extras=["topics"])).fit(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert loaded.transform(df).columns == model.transform(df).columns
    assert "topics" not in model.transform(df).columns
    assert loaded.transform(df).collect() == model.transform(df).collect()


def test_declared_features(spark):
    df = repositories(spark)
    out = Pipeline(stages=features.popularity_stages()).fit(df).transform(df)
    done = schema.conform(out, schema.FEATURES)
    assert done.schema.names == schema.FEATURES.names
    assert [f.dataType for f in done.schema] == [f.dataType for f in schema.FEATURES]


def test_conform_is_loud(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    want = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.LongType())])
    assert schema.conform(df, want).dtypes == [("b", "string"), ("a", "bigint")]
    for given in (df.drop("a"), df.withColumn("c", F.lit(1)), df.withColumnRenamed("a", "A")):
        with pytest.raises(schema.SchemaMismatch):
            schema.conform(given, want)


def test_conform_refuses_nulls_where_none_are_declared(spark):
    want = T.StructType([T.StructField("a", T.LongType(), False)])
    good = spark.createDataFrame([(1,), (2,)], "a int")
    assert [r.a for r in schema.conform(good, want).collect()] == [1, 2]
    with pytest.raises(Exception, match="null in a"):
        schema.conform(good.union(spark.createDataFrame([(None,)], "a int")), want).collect()


def test_sampling_ignores_layout(spark):
    df = spark.range(3000).withColumn("v", F.col("id") * 2)
    ids = lambda d: sorted(r.id for r in d.collect())
    moved = df.repartition(9)
    assert ids(sampling.sample_keyed(df, "id", 10)) == ids(sampling.sample_keyed(moved, "id", 10))
    assert ids(sampling.sample_keyed(df, "id", 10, 2)) != ids(sampling.sample_keyed(df, "id", 10, 1))
    assert ids(sampling.sample_rows(df, 10)) == ids(sampling.sample_rows(df, 10))
    parts, again = sampling.split_keyed(df, "id"), sampling.split_keyed(moved, "id")
    assert {p: ids(d) for p, d in parts.items()} == {p: ids(d) for p, d in again.items()}
    assert sorted(sum((ids(d) for d in parts.values()), [])) == list(range(3000))
    tagged = sampling.with_split(df, "id")
    assert ids(tagged.filter("split = 'test'")) == ids(parts["test"])
    assert sum(d.count() for d in sampling.split_rows(df).values()) == 3000
    sizes = [r[1] for r in sampling.with_subset(df, "id", 5).groupBy("subset_id").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 480


def test_quantiles_are_even(spark):
    df = spark.range(10000).select(F.pow("id", 2).alias("v"))
    out = features.quantile_stage("v", "b", 10).fit(df).transform(df)
    counts = {r[0]: r[1] for r in out.groupBy("b").count().collect()}
    assert set(counts) == set(range(10)) and all(abs(n - 1000) <= 30 for n in counts.values())
    edges = out.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
    assert all(a.hi < b.lo for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("few", [4_000, 2])
@pytest.mark.parametrize("kind", ["ties", "spread", "one value", "small"])
def test_order_statistics(spark, monkeypatch, kind, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(kind)
    values = {
        "ties": [rng.choice([0.0, 5.0, 5.0, 5.0, 7.5]) for _ in range(900)] + [None] * 90 + [math.nan] * 9,
        "spread": [rng.gauss(0, 1) ** 3 for _ in range(3_000)] + [math.inf, -math.inf],
        "one value": [3.0] * 200,
        "small": [2.0, 1.0],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    shares = [0.0, 0.001, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    order = sorted(v for v in values if v is not None and not math.isnan(v))
    expected = [order[max(1, math.ceil(s * len(order))) - 1] for s in shares]
    assert quantiles.order_statistics(df, "v", shares) == expected


def test_exact_buckets(spark, tmp_path):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 2.0, 2.0, 3.0, None, math.nan]], "v double")
    model = quantiles.ExactQuantileBuckets("v", buckets=5).fit(df)
    got = [(r.v, r.bucket) for r in model.transform(df).collect()]
    assert got[:6] == [(1.0, 1.0), (2.0, 2.0), (2.0, 2.0), (2.0, 2.0), (3.0, 2.0), (None, None)] and got[6][1] == 3.0
    assert quantiles.order_statistics(df.limit(0), "v", [0.5]) == []
    empty = quantiles.ExactQuantileBuckets("v").fit(df.limit(0)).transform(df.filter("isnan(v)")).first()
    assert empty.bucket == 2.0


def test_explore(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", None), (None, 2), (None, 2)], "c string, n int")
    assert [tuple(r) for r in explore.value_counts(df, "c").collect()] == [(None, 2), ("b", 2), ("a", 1)]
    for approximate in (False, True):
        got = {r.column: r["values"] for r in explore.distinct_with_null(df, ["c", "n"], approximate).collect()}
        assert got == {"c": 3, "n": 3}
        rows = {r.column: tuple(r)[1:] for r in explore.profile(df, approximate=approximate).collect()}
        assert rows == {"c": ("string", 5, 2, 2, "a", "b"), "n": ("int", 5, 1, 2, "1", "2")}
    assert explore.complete_rows(df).count() == 2
    assert explore.preview(df, 1).count() == 1
    assert [r.c for r in explore.top_k(df, "n", ["c"], 2).collect()] == [None, None]
