"""Candidate regression models of popularity: train, rank, score, explain, stack."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from limelight.functions.hashing import subset_number
from limelight.operators.encoding import FOLDS, SMOOTHING, TargetEncoding, encoded_name, learn_means
from limelight.operators.terms import MEASURES, SIZE, HashedTerms, TextMeasures
from limelight.sources.scratch import materialise

LABEL, FEATURES = "target", "features"
METRICS = ("rmse", "mae", "r2")
PARALLEL_FITS = 3


@dataclass
class Preparation:
    """Fitted encoding of raw columns as one feature vector, and the training rows it was learnt from."""

    model: PipelineModel
    encoding: TargetEncoding | None
    numbers: list[str]
    terms: int
    rows: DataFrame

    @property
    def feature_names(self) -> list[str]:
        categories = self.encoding.columns if self.encoding else []
        return [*self.numbers, *categories, *(f"terms_{i}" for i in range(self.terms))]

    def transform(self, df: DataFrame) -> DataFrame:
        """Any rows but those learnt from."""
        return self._assembled(df, training=False)

    def training_rows(self) -> DataFrame:
        """The rows learnt from; their categories are encoded without their own targets."""
        return self._assembled(self.rows, training=True)

    def _assembled(self, df: DataFrame, training: bool) -> DataFrame:
        encoded = self.encoding.encode(df, training) if self.encoding else df
        return self.model.transform(_raw_numbers(encoded, self.numbers))


def _raw_numbers(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}__num": F.col(c).try_cast("double") for c in numbers if c in df.columns})


class _Numbers(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Columns made by earlier stages as doubles, each under its name with `__num`."""

    def __init__(self, columns: Sequence[str] | None = None):
        super().__init__()
        self._set(inputCols=list(columns or []))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({f"{c}__num": F.col(c).cast("double") for c in self.getInputCols()})


def prepare_features(
    df: DataFrame, numbers: Sequence[str], categories: Sequence[str] = (), text: str | None = None,
    label: str = LABEL, key: str | None = None, folds: int = FOLDS, smoothing: float = SMOOTHING, seed: int = 1,
    terms: int = SIZE,
) -> Preparation:
    """Learn the encoding of training rows.

    Unreadable numbers count as missing and get the mean. Categories, however many there are, become the mean
    target of their rows (`TargetEncoding`). `text` adds measures of that column and its hashed terms.
    """
    stages: list = []
    measures = MEASURES if text else []
    if text:
        stages += [TextMeasures(text), HashedTerms(text, size=terms, seed=seed), _Numbers(measures)]
    numbers = [*numbers, *measures]
    if numbers:
        stages.append(Imputer(inputCols=[f"{c}__num" for c in numbers], outputCols=[f"{c}__full" for c in numbers]))
    inputs = [*(f"{c}__full" for c in numbers), *map(encoded_name, categories), *(["terms"] if text else [])]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="keep"))
    encoding = learn_means(df, categories, label, key, folds, smoothing, seed) if categories else None
    model = Pipeline(stages=stages).fit(_raw_numbers(df, numbers))
    return Preparation(model, encoding, numbers, terms if text else 0, df)


@dataclass
class Candidate:
    model_id: str
    estimator: Estimator
    params: str


def candidates(seed: int = 1, label: str = LABEL) -> list[Candidate]:
    """The models to try, quick ones first."""
    common = {"featuresCol": FEATURES, "labelCol": label}
    trees = {**common, "seed": seed}
    grid: list[tuple[str, type, dict, dict]] = [
        ("linear", LinearRegression, common, {"regParam": 0.0}),
        ("forest-20", RandomForestRegressor, trees, {"numTrees": 20, "maxDepth": 5}),
        ("boosted-10", GBTRegressor, trees, {"maxIter": 10, "maxDepth": 4}),
        ("linear-elastic", LinearRegression, common, {"regParam": 0.01, "elasticNetParam": 0.5}),
        ("forest-50", RandomForestRegressor, trees, {"numTrees": 50, "maxDepth": 8}),
        ("boosted-30", GBTRegressor, trees, {"maxIter": 30, "maxDepth": 5}),
    ]
    text = lambda p: ", ".join(f"{k}={v}" for k, v in p.items())
    return [Candidate(name, cls(**base, **own), text(own)) for name, cls, base, own in grid]


@dataclass
class Trained:
    model_id: str
    params: str
    model: Model
    metrics: dict[str, float] = field(default_factory=dict)


def train_candidates(
    train: DataFrame,
    options: Sequence[Candidate],
    max_runtime: float | None = None,
    max_models: int = 0,
    parallel: int = PARALLEL_FITS,
) -> list[Trained]:
    """Fit the candidates, `parallel` at a time; no limit for `None` and 0. Results come in the order of the options.

    Every fit runs under a job tag of its own. At the time limit the jobs of unfinished fits are cancelled and no other
    is begun; only if nothing has been fitted by then does the first option go on, so there is always a model.
    """
    spark, run = train.sparkSession, uuid.uuid4().hex
    context, options = spark.sparkContext, list(options[: max_models or None])
    deadline = None if max_runtime is None else time.monotonic() + max_runtime
    cancelled: set[int] = set()

    def fit(i: int) -> Trained | None:
        if i in cancelled:
            return None
        context.addJobTag(f"fit-{run}-{i}")
        try:
            return Trained(options[i].model_id, options[i].params, options[i].estimator.fit(train))
        except Exception:
            if i in cancelled:
                return None
            raise
        finally:
            context.removeJobTag(f"fit-{run}-{i}")

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        # Each thread gets its own copy of the caller's job properties.
        fits = [pool.submit(inheritable_thread_target(spark)(fit), i) for i in range(len(options))]
        if deadline is not None:
            wait(fits, timeout=max(0.0, deadline - time.monotonic()))
            fitted = any(f.done() and not f.exception() for f in fits)
            cancelled.update(i for i, f in enumerate(fits) if not f.done() and (i or fitted))
            while not all(fits[i].done() for i in cancelled):
                # A fit starts one job after the other: those that begin meanwhile are cancelled, too.
                for i in cancelled:
                    context.cancelJobsWithTag(f"fit-{run}-{i}")
                wait([fits[i] for i in cancelled], timeout=0.2)
        return [trained for trained in (f.result() for f in fits) if trained is not None]


def predict_all(models: Sequence[Trained], df: DataFrame) -> DataFrame:
    """One prediction column per model, all in one pass."""
    for trained in models:
        df = trained.model.transform(df).withColumnRenamed("prediction", f"p_{trained.model_id}")
    return df


def rank(models: Sequence[Trained], held_out: DataFrame, label: str = LABEL, by: str = "rmse") -> list[Trained]:
    """Measure on held-out rows and sort, best first; all models are measured in one pass."""
    scored = predict_all(models, held_out)
    y = F.col(label)
    aggregates = [F.var_pop(y).alias("variance")]
    for i, trained in enumerate(models):
        error = y - F.col(f"p_{trained.model_id}")
        aggregates += [F.avg(error * error).alias(f"mse{i}"), F.avg(F.abs(error)).alias(f"mae{i}")]
    row = scored.agg(*aggregates).first()
    if models and row["mse0"] is None:
        raise ValueError(f"no held-out row with a value in {label!r}: nothing to rank the models by")
    for i, trained in enumerate(models):
        mse, variance = row[f"mse{i}"], row["variance"]
        trained.metrics = {
            "rmse": mse**0.5,
            "mae": row[f"mae{i}"],
            "r2": 1 - mse / variance if variance else float("nan"),
        }
    sign = -1 if by == "r2" else 1
    return sorted(models, key=lambda t: (sign * t.metrics[by], t.model_id))


def leaderboard(spark, ranked: Sequence[Trained]) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("rank", T.IntegerType(), False),
            T.StructField("model_id", T.StringType(), False),
            T.StructField("params", T.StringType(), False),
        ]
        + [T.StructField(m, T.DoubleType()) for m in METRICS]
    )
    rows = [(i, t.model_id, t.params, *[t.metrics[m] for m in METRICS]) for i, t in enumerate(ranked, 1)]
    return spark.createDataFrame(rows, schema)


def has_importance(trained: Trained) -> bool:
    return hasattr(trained.model, "featureImportances")


def variable_importance(spark, trained: Trained, feature_names: Sequence[str]) -> DataFrame | None:
    """Share of each feature in the model, largest first; None if the model does not tell."""
    if not has_importance(trained):
        return None
    values = trained.model.featureImportances.toArray()
    rows = [(trained.model_id, name, float(value)) for name, value in zip(feature_names, values)]
    rows.sort(key=lambda r: (-r[2], r[1]))
    return spark.createDataFrame(rows, "model_id string, feature string, importance double")


def best_with_importance(ranked: Sequence[Trained]) -> Trained | None:
    return next((t for t in ranked if has_importance(t)), None)


def evaluate(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> dict[str, float]:
    evaluator = RegressionEvaluator(labelCol=label, predictionCol=prediction)
    return {m: evaluator.evaluate(df, {evaluator.metricName: m}) for m in METRICS}


class _Blended(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    key = Param(Params._dummy(), "key", "column that the folds follow", TypeConverters.toString)
    folds = Param(Params._dummy(), "folds", "number of folds", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the folds", TypeConverters.toInt)

    def _columns(self, models: Sequence) -> list[str]:
        return [f"{self.uid}_{i}" for i in range(len(models))]

    def _predicted(self, models: Sequence[Model], df: DataFrame) -> DataFrame:
        """One prediction column per model, all in one pass."""
        for name, model in zip(self._columns(models), models):
            df = model.transform(df).withColumnRenamed(model.getPredictionCol(), name)
        return df

    def _stacked(self, models: Sequence[Model], df: DataFrame) -> DataFrame:
        columns = self._columns(models)
        assembler = VectorAssembler(inputCols=columns, outputCol=f"{self.uid}_all")
        return assembler.transform(self._predicted(models, df)).drop(*columns)


class StackedRegressor(Estimator, _Blended):
    """A linear model over the predictions of others for rows that they have not seen.

    Every fold is predicted by models of the other folds; the predictions of all models become columns of the
    same row, so nothing has to be joined back. It is fitted, ranked and saved like any other candidate.
    """

    def __init__(self, base: Sequence[Estimator] = (), key: str = "name", folds: int = 3, seed: int = 1, label: str = LABEL):
        super().__init__()
        self.base = list(base)
        self._set(key=key, folds=folds, seed=seed, labelCol=label, featuresCol=FEATURES, predictionCol="prediction")

    def _fit(self, dataset: DataFrame) -> StackedModel:
        label, folds = self.getLabelCol(), self.getOrDefault(self.folds)
        fold = subset_number(F.col(self.getOrDefault(self.key)), folds, self.getOrDefault(self.seed), "fold")
        unseen = None
        for number in range(folds):
            models = [option.fit(dataset.filter(fold != number)) for option in self.base]
            part = self._stacked(models, dataset.filter(fold == number)).select(label, f"{self.uid}_all")
            unseen = part if unseen is None else unseen.unionByName(part)
        blender = LinearRegression(featuresCol=f"{self.uid}_all", labelCol=label, predictionCol=self.getPredictionCol())
        fitted = blender.fit(materialise(unseen, "unseen"))
        model = StackedModel([option.fit(dataset) for option in self.base], fitted)
        model._resetUid(self.uid)
        return self._copyValues(model)


class StackedModel(Model, _Blended, MLReadable, MLWritable):
    """Base models, each saved in a folder of its own, and the linear model over their predictions."""

    def __init__(self, base: Sequence[Model] = (), blender: Model | None = None):
        super().__init__()
        self.base, self.blender = list(base), blender

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.blender.transform(self._stacked(self.base, dataset)).drop(f"{self.uid}_all")

    def write(self) -> MLWriter:
        return _StackWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StackReader()


class _StackWriter(MLWriter):
    def __init__(self, instance: StackedModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        # A pipeline of models knows how to save and load each by its own class.
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        PipelineModel([*self.instance.base, self.instance.blender]).save(f"{path}/models")


class _StackReader(MLReader):
    def load(self, path: str) -> StackedModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        *base, blender = PipelineModel.load(f"{path}/models").stages
        model = StackedModel(base, blender)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def stacked(options: Sequence[Candidate], key: str, folds: int = 3, seed: int = 1, label: str = LABEL) -> Candidate:
    """The stack of other candidates as a candidate itself."""
    params = f"base={'+'.join(o.model_id for o in options)}, folds={folds}"
    return Candidate("stacked", StackedRegressor([o.estimator for o in options], key, folds, seed, label), params)
