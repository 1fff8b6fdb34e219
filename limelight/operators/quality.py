"""Constraints of the stored tables as audits: one row per rule with its number of violations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limelight.schema import COUNT_DEFAULTS, FLAG_COLUMNS


@dataclass(frozen=True)
class PrimaryKey:
    """No key is null or occurs twice; `violations` are offending keys, `rows` the rows holding them."""

    columns: Sequence[str]


@dataclass(frozen=True)
class ForeignKey:
    """Every key without null parts exists in the parent table."""

    columns: Sequence[str]
    parent: DataFrame
    parent_columns: Sequence[str]


@dataclass(frozen=True)
class NotNull:
    column: str


@dataclass(frozen=True)
class Check:
    """The condition is not false (null passes, as in SQL)."""

    name: str
    condition: Column


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def orphan_keys(df: DataFrame, rule: ForeignKey) -> DataFrame:
    """Keys without a parent and how many rows hold each; counted first, so a frequent key is one row in the join."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rule.columns])
    held = df.filter(present).groupBy(*rule.columns).agg(F.count("*").alias("copies"))
    parents = rule.parent.select(*[F.col(p).alias(c) for c, p in zip(rule.columns, rule.parent_columns)])
    return held.join(parents, list(rule.columns), "left_anti")


def _summary(name: str, offenders: DataFrame) -> DataFrame:
    return offenders.agg(
        F.lit(name).alias("rule"),
        F.count("*").alias("violations"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
    )


def audit_constraints(df: DataFrame, rules: Sequence) -> DataFrame:
    """`rule`, `violations`, `rows` for each rule. All NOT NULL and CHECK rules share one scan."""
    parts, row_rules = [], {}
    for rule in rules:
        if isinstance(rule, PrimaryKey):
            name = f"primary key ({', '.join(rule.columns)})"
            has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in rule.columns])
            held = df.groupBy(*rule.columns).agg(F.count("*").alias("copies"))
            parts.append(_summary(name, held.filter((F.col("copies") > 1) | has_null)))
        elif isinstance(rule, ForeignKey):
            parts.append(_summary(f"foreign key ({', '.join(rule.columns)})", orphan_keys(df, rule)))
        elif isinstance(rule, NotNull):
            row_rules[f"not null ({rule.column})"] = F.col(rule.column).isNull()
        else:
            row_rules[f"check ({rule.name})"] = ~rule.condition
    if row_rules:
        broken = [F.count_if(cond).alias(f"v{i}") for i, cond in enumerate(row_rules.values())]
        pairs = F.array(
            *[
                F.struct(F.lit(n).alias("rule"), F.col(f"v{i}").alias("violations"), F.col(f"v{i}").alias("rows"))
                for i, n in enumerate(row_rules)
            ]
        )
        parts.append(df.agg(*broken).select(F.inline(pairs)))
    return reduce(DataFrame.unionByName, parts)


def repository_rules() -> list:
    """The constraints of the stored repositories."""
    counts = [Check(f"{c} >= 0", F.col(c) >= 0) for c in COUNT_DEFAULTS]
    return [PrimaryKey(["id"]), NotNull("name"), *[NotNull(c) for c in FLAG_COLUMNS], *counts]


def ledger_rules(periods: DataFrame) -> list:
    """The constraints of the ledger, whose periods must be known."""
    key = ["startdate", "enddate"]
    return [PrimaryKey(key), NotNull("nextpage"), ForeignKey(key, periods, key)]


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
