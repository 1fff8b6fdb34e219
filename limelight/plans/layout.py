"""Input layout."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL_SPLIT = 8 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Shuffle a small input by `key` so that every core gets a part of the work.

    A file with a single row group is read by one task. That only matters for inputs under
    a few megabytes per core; larger ones have splits enough and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * SMALL_SPLIT else df
