"""Relational table as a partitioned scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FETCH_SIZE = 10_000
MAX_PARTITIONS = 10_000


def sampled_relation(table: str, percent: float | None, seed: int) -> str:
    """The table itself, or a repeatable block sample taken by the store before any row is sent."""
    if percent is None or percent >= 100:
        return table
    return f"(SELECT * FROM {table} TABLESAMPLE SYSTEM({percent:g}) REPEATABLE({seed})) AS sampled"


def fewer_boundaries(boundaries: list[str], most: int) -> list[str]:
    """At most `most` boundaries, evenly chosen: neighbouring ranges are merged, none is lost."""
    step = -(-len(boundaries) // most)
    return boundaries[::step] if step > 1 else boundaries


def range_predicates(column: str, boundaries: list[str]) -> list[str]:
    """One WHERE clause per range between neighbouring boundaries, plus both open ends and nulls.

    Every row satisfies exactly one clause, so the partitions are complete and disjoint.
    """
    if not boundaries:
        return ["1 = 1"]
    quoted = [f"'{b}'" for b in boundaries]
    clauses = [f"{column} < {quoted[0]} OR {column} IS NULL"]
    clauses += [f"{column} >= {a} AND {column} < {b}" for a, b in zip(quoted, quoted[1:])]
    return clauses + [f"{column} >= {quoted[-1]}"]


def scan_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    column: str | None = None,
    lower=None,
    upper=None,
    partitions: int | None = None,
    boundaries: list[str] | None = None,
    percent: float | None = None,
    seed: int = 1,
    fetch_size: int = FETCH_SIZE,
) -> DataFrame:
    """Read over JDBC with several connections at once.

    Either `column` with `lower`, `upper` and `partitions` (equal steps over the axis), or
    `column` with `boundaries` (steps of equal row count, for instance the starts given by
    `range_breakdown`). A number of partitions without a column would be read by one task,
    so that is refused.
    """
    if column is None:
        raise ValueError("a partition column is needed for a parallel scan")
    options = dict(properties, fetchsize=str(fetch_size))
    relation = sampled_relation(table, percent, seed)
    if boundaries is not None:
        kept = fewer_boundaries(boundaries, MAX_PARTITIONS - 1)
        return spark.read.jdbc(url, relation, predicates=range_predicates(column, kept), properties=options)
    if lower is None or upper is None or not partitions:
        raise ValueError("lower, upper and partitions are needed with the partition column")
    return spark.read.jdbc(
        url, relation, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options
    )
