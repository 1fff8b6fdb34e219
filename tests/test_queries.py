"""Every named query against its SQL on the smallest tables, and the shape of its plan."""

import os

import duckdb
import pytest

import __spark_entry__ as registry
from limelight import catalogue

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
QUERIES, ORACLES = catalogue.runnable(), catalogue.oracles()
ROWS_ONLY = {"leaderboard", "score", "importance", "stacked_score"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def sorted_rows(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in places)) for row in rows)


def test_only_inexact_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, plan, name):
    df = QUERIES[name](spark, SF_DIR)
    shape = plan(df)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in shape
    rows = df.collect()
    assert rows or name in {"quarantine_rows"}
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        assert sorted_rows(rows, df.columns) == sorted_rows(cursor.fetchall(), columns)


def test_registry_has_them_all():
    assert set(QUERIES) <= set(registry.queries()) and set(ORACLES) <= set(registry.oracle_sql())
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    df = registry.entry(spark)
    assert df.count() > 0 and "target" in df.columns


def test_pushdown(spark, plan):
    shape = plan(QUERIES["range_filter"](spark, SF_DIR))
    assert "GreaterThanOrEqual(ts" in shape and "LessThan(ts" in shape
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in shape
    assert "GreaterThanOrEqual(ts" in plan(QUERIES["keyset_page"](spark, SF_DIR))


def test_single_task_windows_see_slice_totals_only(spark, plan):
    """The one window without partitioning runs over one row per slice, never over the rows."""
    for name in ("count_per_period", "assign_periods"):
        shape = plan(QUERIES[name](spark, SF_DIR))
        for part in shape.split("Exchange SinglePartition")[1:]:
            assert "HashAggregate(keys=[__slice" in part.split("\n")[1] or "SortAggregate(key=[__slice" in part.split("\n")[1]
    assert "SinglePartition" not in plan(QUERIES["page_number"](spark, SF_DIR))
