"""The whole job: stored repositories to stored training and test sets, then to ranked models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from limelight.operators import modelling as M
from limelight.operators.explore import preview
from limelight.operators.sampling import DEFAULT_SPLIT, sample_keyed, split_keyed, split_rows, with_split
from limelight.sources.datasets import RECORDS_PER_FILE, materialise_once, write_dataset
from limelight.sources.jdbc import scan_table
from limelight.sources.scratch import materialise


class Processor:
    """Raw rows, feature stages, split and sink."""

    def __init__(self, raw: DataFrame, load_percent: float | None = None, seed: int = 1, key: str = "id"):
        self.seed, self.key = seed, key
        sampled = load_percent is not None and load_percent < 100
        self.raw_data = sample_keyed(raw, key, load_percent, seed) if sampled else raw
        self.parts: dict[str, DataFrame] = {}

    @classmethod
    def from_jdbc(cls, spark, url: str, table: str, properties: dict, load_percent=10, seed: int = 1, key: str = "id", **scan):
        """The sample is taken by the database, so rows outside of it are never sent."""
        raw = scan_table(spark, url, table, properties, percent=load_percent, seed=seed, **scan)
        return cls(raw, None, seed, key)

    def process_data(
        self,
        *stages,
        split: dict[str, float] | None = None,
        fit_on: str = "all",
        positional: bool = False,
    ) -> dict[str, DataFrame]:
        """Fit the stages and split the result.

        `fit_on="all"` learns the scaling from all rows, test rows included; `"train"` from
        the training rows only. The split follows the row key (before the stages drop it),
        or row positions with `positional`, over a stored copy because those are not stable.
        """
        split = split or DEFAULT_SPLIT
        pipeline = Pipeline(stages=list(stages))
        if positional:
            if fit_on != "all":
                raise ValueError("a positional split is only known after the stages")
            data = pipeline.fit(self.raw_data).transform(self.raw_data)
            self.parts = split_rows(materialise(data, "processed"), split, self.seed)
            return self.parts
        if fit_on == "all":
            fitting = self.raw_data
        else:
            fitting = split_keyed(self.raw_data, self.key, split, self.seed)[fit_on]
        tagged = with_split(self.raw_data, self.key, split, self.seed)
        data = materialise(pipeline.fit(fitting).transform(tagged), "processed", partition_by="split")
        self.parts = {name: data.filter(data.split == name).drop("split") for name in split}
        return self.parts

    def preview(self, part: str, n: int = 20) -> DataFrame:
        return preview(self.parts[part], n)

    def save_processed_data(
        self, paths: dict[str, str], schema: T.StructType, records_per_file: int = RECORDS_PER_FILE
    ) -> None:
        for name, path in paths.items():
            write_dataset(self.parts[name], path, schema, records_per_file)

    def load_or_process(
        self, paths: dict[str, str], schema: T.StructType, *stages, records_per_file: int = RECORDS_PER_FILE, **options
    ) -> dict[str, DataFrame]:
        """The stored parts; they are computed and written first if one of them is missing."""
        compute = lambda: self.process_data(*stages, **options)
        self.parts = materialise_once(self.raw_data.sparkSession, paths, schema, compute, records_per_file)
        return self.parts


class ModelSearch:
    """Candidate models over a training set, ranked on a held-out set."""

    def __init__(
        self,
        train: DataFrame,
        test: DataFrame,
        numbers: Sequence[str],
        categories: Sequence[str] = (),
        label: str = M.LABEL,
        seed: int = 1,
        text: str | None = None,
        key: str | None = None,
    ):
        self.spark, self.label, self.seed = train.sparkSession, label, seed
        self.preparation = M.prepare_features(train, numbers, categories, text, label, key, seed=seed)
        # Every candidate reads the training rows several times: encode them once.
        rows = self.preparation.training_rows()
        self.key = key
        self.train = materialise(rows.select(label, M.FEATURES, *([key] if key else [])), "prepared")
        self.test = self.preparation.transform(test)
        self.ranked: list[M.Trained] = []

    def train_models(self, max_runtime: float | None = None, max_models: int = 0, stack: int = 0) -> DataFrame:
        """Train and rank; returns the test set with the predictions of the best model.

        `stack` of the first candidates make one more, which needs a key for its folds.
        """
        options = M.candidates(self.seed, self.label)[: max_models or None]
        if stack:
            if self.key is None:
                raise ValueError("a stack needs a key that its folds follow")
            options.append(M.stacked(options[:stack], self.key, seed=self.seed, label=self.label))
        fitted = M.train_candidates(self.train, options, max_runtime)
        self.ranked = M.rank(fitted, self.test, self.label)
        return self.score(self.test)

    def get_leaderboard(self, top_models: int | None = None) -> DataFrame:
        return M.leaderboard(self.spark, self.ranked[:top_models])

    def score(self, prepared: DataFrame) -> DataFrame:
        return self.ranked[0].model.transform(prepared)

    def variable_importance(self, model_id: str) -> DataFrame | None:
        trained = next(t for t in self.ranked if t.model_id == model_id)
        return M.variable_importance(self.spark, trained, self.preparation.feature_names)

    def best_model_importance(self) -> DataFrame | None:
        """Importance from the best model that offers it."""
        best = M.best_with_importance(self.ranked)
        return None if best is None else self.variable_importance(best.model_id)
