"""Parquet data sets that carry their declared schema."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from limelight.schema import conform
from limelight.sources.scratch import exists, read_text, write_text

RECORDS_PER_FILE = 3000
SCHEMA_FILE = "_declared_schema.json"


def write_dataset(df: DataFrame, path: str, schema: T.StructType, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Replace the data set at `path`; data that do not fit the declared schema are refused."""
    conform(df, schema).write.option("maxRecordsPerFile", records_per_file).mode("overwrite").parquet(path)
    write_text(df.sparkSession, f"{path}/{SCHEMA_FILE}", schema.json())


def append_rows(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Add rows to a data set in one job; creates it on the first call."""
    conform(df, schema).write.mode("append").parquet(path)
    write_text(df.sparkSession, f"{path}/{SCHEMA_FILE}", schema.json())


def declared_schema(spark: SparkSession, path: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(read_text(spark, f"{path}/{SCHEMA_FILE}")))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(declared_schema(spark, path)).parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS") and exists(spark, f"{path}/{SCHEMA_FILE}")


def materialise_once(
    spark: SparkSession,
    paths: dict[str, str],
    schema: T.StructType,
    compute: Callable[[], dict[str, DataFrame]],
    records_per_file: int = RECORDS_PER_FILE,
) -> dict[str, DataFrame]:
    """Read the named data sets; compute and write all of them first unless all are complete."""
    if not all(is_complete(spark, path) for path in paths.values()):
        parts = compute()
        for name, path in paths.items():
            write_dataset(parts[name], path, schema, records_per_file)
    return {name: read_dataset(spark, path) for name, path in paths.items()}
