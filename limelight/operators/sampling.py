"""Samples, splits and subsets that depend on the row key only, plus Spark's positional ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.functions.hashing import in_sample, split_name, subset_number

DEFAULT_SPLIT = {"train": 0.8, "test": 0.2}


def sample_keyed(df: DataFrame, key: str, percent: float, seed: int = 1) -> DataFrame:
    return df.filter(in_sample(F.col(key), percent, seed))


def sample_rows(df: DataFrame, percent: float, seed: int = 1) -> DataFrame:
    """Spark's own row sample: cheaper, but another file layout gives another sample."""
    return df.sample(fraction=percent / 100, seed=seed)


def with_split(df: DataFrame, key: str, weights: dict[str, float] | None = None, seed: int = 1) -> DataFrame:
    return df.withColumn("split", split_name(F.col(key), weights or DEFAULT_SPLIT, seed))


def split_keyed(
    df: DataFrame, key: str, weights: dict[str, float] | None = None, seed: int = 1
) -> dict[str, DataFrame]:
    weights = weights or DEFAULT_SPLIT
    name = split_name(F.col(key), weights, seed)
    return {part: df.filter(name == part) for part in weights}


def split_rows(df: DataFrame, weights: dict[str, float] | None = None, seed: int = 1) -> dict[str, DataFrame]:
    """`randomSplit`; repeatable only while the input keeps its layout, so pass a stored table."""
    weights = weights or DEFAULT_SPLIT
    return dict(zip(weights, df.randomSplit(list(weights.values()), seed=seed)))


def with_subset(df: DataFrame, key: str, subsets: int, seed: int = 1) -> DataFrame:
    """Number of the random subset each row belongs to, all subsets in one pass."""
    return df.withColumn("subset_id", subset_number(F.col(key), subsets, seed))
