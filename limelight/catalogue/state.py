"""Keyed state and the ledger of periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.catalogue.fixtures import DAYS_SQL, days, ntz, table
from limelight.catalogue.registry import query
from limelight.operators import keyed
from limelight.schema import HISTORY
from limelight.sources.datasets import append_rows, read_dataset
from limelight.sources.scratch import scratch_path

LATEST_SQL = """SELECT conv_id, turn, role, text FROM
    (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1"""


@query(LATEST_SQL)
def upsert_latest(spark, sf_dir):
    return keyed.latest_per_key(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])


@query(LATEST_SQL)
def upsert_merge(spark, sf_dir):
    """The answers written over the last questions: what stays is the last turn of either."""
    turns = table(spark, sf_dir, "conversations")
    answer = F.col("role") == "assistant"
    questions = keyed.latest_per_key(turns.filter(~answer), ["conv_id"], ["turn"])
    return keyed.upsert(questions, turns.filter(answer), ["conv_id"], ["turn"])


ITEM_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


@query(
    f"""SELECT l_orderkey, l_linenumber, {', '.join(ITEM_ORDER)} FROM (SELECT *, row_number() OVER
    (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(ITEM_ORDER)}) AS n FROM lineitem) WHERE n = 1"""
)
def dedup_by_key(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *ITEM_ORDER)
    return keyed.dedup_by_key(items, ["l_orderkey", "l_linenumber"], ITEM_ORDER)


def _zoneless(df: DataFrame) -> DataFrame:
    return df.withColumns({c: ntz(F.col(c)) for c in ("startdate", "enddate")})


PROGRESS_SQL = """
    SELECT date_trunc('day', ts)::TIMESTAMP AS startdate, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS enddate,
           count(*) < 70 AS nextpage, 'cursor:' || count(*) AS after
    FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) > 60"""


def _progress(spark, sf_dir) -> DataFrame:
    """Days with more than 60 errors as reports of progress; those with 70 are read to the end."""
    start = F.date_trunc("day", F.col("ts").cast("timestamp"))
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    counted = errors.groupBy(start.alias("startdate")).agg(F.count("*").alias("n")).filter("n > 60")
    return counted.select(
        "startdate",
        (F.col("startdate") + F.expr("interval 1 day")).alias("enddate"),
        (F.col("n") < 70).alias("nextpage"),
        F.concat(F.lit("cursor:"), "n").alias("after"),
    )


@query(f"SELECT startdate, enddate, true AS nextpage, NULL::VARCHAR AS after FROM ({DAYS_SQL})")
def seed_ledger(spark, sf_dir):
    """The stored ledger before anything has been read."""
    path = scratch_path(spark, "ledger")
    append_rows(keyed.seed_ledger(days(spark, sf_dir)), path, HISTORY)
    return _zoneless(read_dataset(spark, path))


LEDGER_SQL = f"""SELECT d.startdate, d.enddate, coalesce(p.nextpage, true) AS nextpage, p.after
    FROM ({DAYS_SQL}) d LEFT JOIN ({PROGRESS_SQL}) p ON d.startdate = p.startdate AND d.enddate = p.enddate"""


def _ledger(spark, sf_dir) -> DataFrame:
    return keyed.update_ledger(keyed.seed_ledger(days(spark, sf_dir)), _progress(spark, sf_dir))


@query(LEDGER_SQL)
def ledger_update(spark, sf_dir):
    return _zoneless(_ledger(spark, sf_dir))


@query(f"SELECT * FROM ({LEDGER_SQL}) WHERE nextpage")
def unfinished_ledger(spark, sf_dir):
    return _zoneless(keyed.unfinished(_ledger(spark, sf_dir)))


@query(
    f"""SELECT d.* FROM ({DAYS_SQL}) d WHERE NOT EXISTS
    (SELECT 1 FROM ({PROGRESS_SQL}) p WHERE p.startdate = d.startdate AND p.enddate = d.enddate AND NOT p.nextpage)"""
)
def pending_periods(spark, sf_dir):
    return _zoneless(keyed.pending_periods(days(spark, sf_dir), _progress(spark, sf_dir)))
