"""First looks at a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value (null is a value), most frequent first, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_first(column))


def distinct_with_null(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Number of different values of each column, null being one of them."""
    if approximate:
        one = lambda c: F.approx_count_distinct(c) + F.max(F.col(c).isNull().cast("int"))
        counts = [F.struct(F.lit(c).alias("column"), one(c).cast("bigint").alias("values")) for c in columns]
        return df.agg(F.array(*counts).alias("a")).select(F.inline("a"))
    one = lambda c: df.select(c).distinct().agg(F.lit(c).alias("column"), F.count("*").alias("values"))
    return reduce(DataFrame.unionByName, [one(c) for c in columns])


def profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: type, rows, nulls, different values, smallest and largest value as text.

    One aggregate over all columns. The exact number of values is a scan of its column
    alone: several distinct counts in one aggregate would multiply every row by the number
    of columns. `approximate` keeps to the single aggregate.
    """
    columns = list(columns or df.columns)
    aggregates, records = [F.count("*").alias("rows")], []
    for i, c in enumerate(columns):
        aggregates += [F.count(c).alias(f"p{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        if approximate:
            aggregates.append(F.approx_count_distinct(c).alias(f"d{i}"))
            values = F.col(f"d{i}")
        else:
            values = df.select(c).filter(F.col(c).isNotNull()).distinct().agg(F.count("*")).scalar()
        records.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(df.schema[c].dataType.simpleString()).alias("type"),
                F.col("rows"),
                (F.col("rows") - F.col(f"p{i}")).alias("nulls"),
                values.alias("values"),
                F.col(f"lo{i}").cast("string").alias("smallest"),
                F.col(f"hi{i}").cast("string").alias("largest"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*records)))


def top_k(df: DataFrame, column: str, tie_break: Sequence[str], k: int = 20) -> DataFrame:
    return df.orderBy(F.desc(column), *tie_break).limit(k)


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    return complete_rows(df).limit(n)
