import math
import random
import time

import pytest
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from limelight.operators import encoding
from limelight.operators import modelling as M
from limelight.operators.terms import MEASURES, HashedTerms, TextMeasures
from limelight.plans import skew
from limelight.plans.dataset import ModelSearch


@pytest.fixture(scope="module")
def parts(spark):
    n = F.col("id")
    rows = spark.range(600).select(
        n,
        (n % 17).cast("string").alias("a"),
        (n % 5).alias("b"),
        F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (n % 3 + 1).cast("int")).alias("c"),
        F.concat(F.lit("key"), n).alias("many"),
        ((n % 17) * 2 + (n % 3) * 10).cast("double").alias("target"),
    )
    return rows.filter("id < 450"), rows.filter("id >= 450")


def brute_means(rows, column, label, folds, smoothing=20.0):
    """(mean for new rows by category, mean by (category, fold) without that fold, overall mean); rows are dicts with a fold."""
    taught = [r for r in rows if r[label] is not None]
    prior = sum(r[label] for r in taught) / len(taught)
    mean = lambda part, overall: (sum(r[label] for r in part) + smoothing * overall) / (len(part) + smoothing)
    whole, apart = {}, {}
    for value in {r[column] for r in taught}:
        mine = [r for r in taught if r[column] == value]
        whole[value] = mean(mine, prior)
        for fold in range(folds):
            rest = [r for r in taught if r["fold"] != fold]
            overall = sum(r[label] for r in rest) / len(rest) if rest else prior
            apart[value, fold] = mean([r for r in mine if r["fold"] != fold], overall)
    return whole, apart, prior


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_target_encoding(spark, tmp_path, monkeypatch, broadcast_rows):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(1)
    values = ["hot"] * 150 + [None] * 20 + ["-", "", "="] + [f"v{rng.randrange(60)}" for _ in range(130)]
    rows = [(i, v, None if i % 37 == 0 else float(rng.randrange(100))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, c string, target double")
    found = encoding.learn_means(df, ["c"], "target", "id")
    tagged = [r.asDict() for r in df.withColumn("fold", encoding.row_fold(df, "id", 5, 1)).collect()]
    whole, apart, prior = brute_means(tagged, "c", "target", 5)
    assert found.prior == pytest.approx(prior)
    trained = {r.id: r["c__mean"] for r in found.encode(df, training=True).collect()}
    for r in tagged:
        if r["target"] is not None:
            assert trained[r["id"]] == pytest.approx(apart[r["c"], r["fold"]])
    new = spark.createDataFrame([(1, "hot"), (2, None), (3, "never seen"), (4, "-"), (5, "")], "id int, c string")
    expected = [whole["hot"], whole[None], prior, whole["-"], whole[""]]
    found.save(str(tmp_path / "means"))
    for model in (found, encoding.TargetEncoding.load(spark, str(tmp_path / "means"))):
        assert [r["c__mean"] for r in model.encode(new).orderBy("id").collect()] == pytest.approx(expected)
    with pytest.raises(ValueError, match="folds"):
        model.encode(df, training=True)


def test_encoding_of_nothing(spark):
    none = spark.createDataFrame([(1, "a", None)], "id int, c string, target double")
    found = encoding.learn_means(none, ["c"], "target", "id")
    assert [r["c__mean"] for r in found.encode(none).collect()] == [0.0]
    assert encoding.learn_means(none.limit(0), ["c"], "target", "id").encode(none).first()["c__mean"] == 0.0


def test_preparation(spark, parts):
    train, _ = parts
    prep = M.prepare_features(train, ["a", "b"], ["c", "many"], key="many")
    assert prep.feature_names == ["a", "b", "c", "many"]
    strange = spark.createDataFrame(
        [("broken", 1, "new", "k"), (None, None, None, None), ("3", 2, "x", "key1")],
        "a string, b bigint, c string, many string",
    )
    vectors = [r.features.toArray() for r in prep.transform(strange).collect()]
    mean_a = train.agg(F.avg(F.col("a").cast("double"))).first()[0]
    mean_y = train.agg(F.avg("target")).first()[0]
    assert math.isclose(vectors[0][0], mean_a) and math.isclose(vectors[1][0], mean_a)
    assert [vectors[0][2], vectors[1][2]] == pytest.approx([mean_y, mean_y])  # never seen, and never missing in training
    assert vectors[2][0] == 3.0 and vectors[2][2] != vectors[0][2]
    assert not any(math.isnan(x) for v in vectors for x in v)
    # A category of its own for every row tells a training row nothing of its target.
    single = [r.features[3] for r in prep.training_rows().collect()]
    assert len({round(v, 9) for v in single}) <= 5  # one mean for each fold


def test_thousands_of_categories(spark):
    category = F.col("id") % 2000
    rows = spark.range(40_000).select("id", category.cast("string").alias("c"), (category * 1.0).alias("target"))
    search = ModelSearch(rows, rows, numbers=[], categories=["c"], key="id")
    search.train_models(max_models=2)
    assert search.get_leaderboard().first()["r2"] > 0.9


def test_text_in_the_model(spark, tmp_path):
    topics = ["rust async runtime", "python notebook plot"]
    texts = [(i, f"# {'Big' if i % 2 else 'small'} Title\n{topics[i % 2]} w{i % 7} 😀", float(i % 2)) for i in range(120)]
    texts += [(200, None, 0.5), (201, "", 0.5)]
    df = spark.createDataFrame(texts, "id int, readme string, target double")
    model = Pipeline(stages=[TextMeasures("readme"), HashedTerms("readme", size=64)]).fit(df)
    model.write().overwrite().save(str(tmp_path / "text"))
    loaded = PipelineModel.load(str(tmp_path / "text"))
    assert loaded.stages[1].document_frequency == model.stages[1].document_frequency
    assert loaded.transform(df).collect() == model.transform(df).collect()
    rows = {r.id: r for r in loaded.transform(df).collect()}
    assert [tuple(rows[i][m] for m in MEASURES) for i in (0, 1, 200, 201)] == [(1, 8, 1, 0), (1, 8, 1, 1), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert isinstance(rows[0].terms, SparseVector) and rows[200].terms.numNonzeros() == 0
    search = ModelSearch(df, df, numbers=[], text="readme", key="id")
    search.train_models(max_models=2)
    assert len(search.preparation.feature_names) == 4 + 256
    assert search.get_leaderboard().first()["r2"] > 0.8
    best = search.best_model_importance().first()
    assert best.feature == "title_case" or best.feature.startswith("terms_")


def test_search(spark, parts):
    search = ModelSearch(*parts, numbers=["a", "b"], categories=["c"])
    scored = search.train_models(max_models=3)
    assert scored.filter("prediction is null").count() == 0 and scored.count() == 150
    board = search.get_leaderboard().collect()
    assert [r["rank"] for r in board] == [1, 2, 3]
    assert [r.rmse for r in board] == sorted(r.rmse for r in board)
    assert {r.model_id for r in board} == {"linear", "forest-20", "boosted-10"}
    assert search.get_leaderboard(1).count() == 1
    # The metrics measured in one pass are those of Spark's evaluator.
    measured = M.evaluate(scored)
    for name, value in measured.items():
        assert math.isclose(board[0][name], value, rel_tol=1e-9)
    assert search.variable_importance("linear") is None
    best = search.best_model_importance().collect()
    assert best[0].model_id != "linear" and {r.feature for r in best} == {"a", "b", "c"}
    assert [r.importance for r in best] == sorted((r.importance for r in best), reverse=True)
    assert min(best, key=lambda r: r.importance).feature == "b"  # the target does not depend on it


def test_best_with_importance_walks_down(spark, parts):
    prep = M.prepare_features(parts[0], ["a"], [])
    rows = prep.transform(parts[0]).select("target", "features")
    linear, forest = M.train_candidates(rows, M.candidates()[:2])
    assert M.best_with_importance([linear, forest]) is forest
    assert M.best_with_importance([linear]) is None


def test_repeatable_and_limited(spark, parts):
    prep = M.prepare_features(parts[0], ["a", "b"], ["c"])
    rows = prep.transform(parts[0]).select("target", "features").cache()
    options = M.candidates(seed=3)[1:2]
    metrics = [M.rank(M.train_candidates(rows, options), rows)[0].metrics for _ in range(2)]
    assert metrics[0] == metrics[1]
    assert len(M.train_candidates(rows, M.candidates(), max_runtime=0)) == 1
    assert len(M.train_candidates(rows, M.candidates(), max_models=2)) == 2


def test_stack_ranks_and_is_saved(spark, parts, tmp_path):
    search = ModelSearch(*parts, numbers=["a", "b"], categories=["c"], key="id")
    scored = search.train_models(max_models=2, stack=2)
    assert scored.count() == 150 and not [c for c in scored.columns if "Stacked" in c]
    board = {r.model_id: r for r in search.get_leaderboard().collect()}
    assert set(board) == {"linear", "forest-20", "stacked"}
    assert board["stacked"].rmse <= max(r.rmse for r in board.values())
    trained = next(t for t in search.ranked if t.model_id == "stacked")
    trained.model.save(str(tmp_path / "stack"))
    again = M.StackedModel.load(str(tmp_path / "stack"))
    key = lambda df: sorted((r["id"], r["prediction"]) for r in df.select("id", "prediction").collect())
    assert key(again.transform(search.test)) == key(trained.model.transform(search.test))
    with pytest.raises(ValueError, match="key"):
        ModelSearch(*parts, numbers=["a"]).train_models(max_models=1, stack=1)


class Slow(Estimator):
    """A fit of many short jobs, a minute in all."""

    def __init__(self, rows):
        super().__init__()
        self.rows, self.jobs = rows, 0

    def _fit(self, dataset):
        for _ in range(600):
            self.jobs += 1
            self.rows.sparkSession.range(2).selectExpr("reflect('java.lang.Thread', 'sleep', 100L * (id + 1))").collect()
        raise AssertionError("nobody stopped it")


def test_the_time_limit_stops_a_long_fit(spark, parts):
    prep = M.prepare_features(parts[0], ["a", "b"])
    rows = prep.training_rows().select("target", "features")
    quick, slow = M.candidates()[0], Slow(parts[0])
    started = time.monotonic()
    found = M.train_candidates(rows, [quick, M.Candidate("slow", slow, ""), M.Candidate("late", slow, "")], 8, parallel=2)
    assert [t.model_id for t in found] == ["linear"] and time.monotonic() - started < 30
    began = slow.jobs
    time.sleep(1)
    assert slow.jobs == began  # nothing goes on behind the caller's back
    assert not len(spark.sparkContext.getJobTags())
    board = M.leaderboard(spark, M.rank(found, prep.transform(parts[1])))
    assert board.count() == 1
    # Without any finished fit the first goes on.
    assert [t.model_id for t in M.train_candidates(rows, [quick, M.Candidate("slow", slow, "")], 0)] == ["linear"]


def test_a_failing_fit_is_an_error(spark, parts):
    rows = M.prepare_features(parts[0], ["a"]).training_rows().select("target")
    with pytest.raises(Exception, match="features"):
        M.train_candidates(rows, M.candidates()[:2])
