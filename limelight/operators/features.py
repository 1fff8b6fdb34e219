"""Feature stages for `pyspark.ml.Pipeline`; each can be saved and loaded with the pipeline."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.feature import MinMaxScaler, QuantileDiscretizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.functions.text import FIRST_HEADING, first_heading

# The popularity measures that are not the one being predicted, and the key.
UNUSED_COLUMNS = ["id", "forkcount", "watchs", "users", "issues", "pullrequests"]
FLAGS = ["fork", "locked", "archived"]


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    pass


class RemoveColumns(_Stage, HasInputCols):
    """Drop columns; names the data do not have are ignored."""

    def __init__(self, *columns: str):
        super().__init__()
        self._set(inputCols=list(columns))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.getInputCols())


class CastToInt(_Stage, HasInputCols):
    """Flags to 0 and 1 (null stays null), all in one projection."""

    def __init__(self, *columns: str):
        super().__init__()
        self._set(inputCols=list(columns))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: F.col(c).cast("int") for c in self.getInputCols()})


class ExtractTextFeatures(_Stage, HasInputCol):
    """Adds `titles`, the heading on the first line, and `length` in characters."""

    pattern = Param(Params._dummy(), "pattern", "what counts as a heading", TypeConverters.toString)
    group = Param(Params._dummy(), "group", "which group of the pattern to keep", TypeConverters.toInt)

    def __init__(self, column: str | None = None, pattern: str = FIRST_HEADING, group: int = 0):
        super().__init__()
        self._set(pattern=pattern, group=group)
        if column is not None:
            self._set(inputCol=column)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = F.col(self.getInputCol())
        heading = first_heading(text, self.getOrDefault(self.pattern), self.getOrDefault(self.group))
        return dataset.withColumns({"titles": heading, "length": F.length(text)})


class CleanUp(_Stage, HasInputCol):
    """Unpack the one-element vector that a scaler made of `source` and drop what it was made from.

    Whatever the source column is called, neither it nor its vector stays beside the target.
    """

    extras = Param(Params._dummy(), "extras", "columns to drop", TypeConverters.toListString)

    def __init__(self, column: str | None = None, extras: list[str] | None = None, source: str = "stars"):
        super().__init__()
        self._set(extras=[source, f"{source}Vector", *(extras or [])])
        if column is not None:
            self._set(inputCol=column)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column = self.getInputCol()
        number = vector_to_array(F.col(column)).getItem(0)
        return dataset.withColumn(column, number).drop(*self.getOrDefault(self.extras))


def min_max_stages(column: str = "stars", out: str = "target", handle_invalid: str = "error") -> list:
    """Scale to [0, 1]; a column with one value only becomes 0.5."""
    vector = f"{column}Vector"
    return [
        VectorAssembler(inputCols=[column], outputCol=vector, handleInvalid=handle_invalid),
        MinMaxScaler(inputCol=vector, outputCol=out),
    ]


def standard_stages(column: str = "stars", out: str = "target", handle_invalid: str = "error") -> list:
    """Divide by the sample standard deviation, without centring; a constant column becomes 0."""
    vector = f"{column}Vector"
    return [
        VectorAssembler(inputCols=[column], outputCol=vector, handleInvalid=handle_invalid),
        StandardScaler(inputCol=vector, outputCol=out),
    ]


def popularity_stages(scaling: str = "min-max", extras: list[str] | None = None) -> list:
    """The stages from a stored repository row to a training row."""
    scaler = {"min-max": min_max_stages, "standard": standard_stages}[scaling]()
    return [
        RemoveColumns(*UNUSED_COLUMNS),
        *scaler,
        CastToInt(*FLAGS),
        ExtractTextFeatures("readme"),
        CleanUp("target", extras),
    ]


def quantile_stage(column: str, out: str, buckets: int, error: float = 0.001) -> QuantileDiscretizer:
    return QuantileDiscretizer(
        inputCol=column, outputCol=out, numBuckets=buckets, relativeError=error, handleInvalid="keep"
    )
