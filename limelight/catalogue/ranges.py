"""Ranges of bounded row count, counts per range, batches and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from limelight.catalogue.fixtures import DAYS_SQL, days, ntz, table
from limelight.catalogue.registry import query
from limelight.functions.timing import micros
from limelight.operators import ranges
from limelight.schema import PERIODS
from limelight.sources.datasets import append_rows, read_dataset
from limelight.sources.scratch import scratch_path


def breakdown_sql(points: str, limit: int) -> str:
    """Halve again and again what holds `limit` rows or more. `points` gives x, lo and w, the width of its initial range."""
    return f"""
    WITH RECURSIVE p AS ({points}),
    d AS (SELECT min(i) AS deepest FROM range(0, 57) t(i), (SELECT max(w) AS w FROM p) WHERE (2 ** i)::HUGEINT >= w),
    r AS (SELECT x, lo, w, deepest, 0 AS level, 0::HUGEINT AS cell, count(*) OVER (PARTITION BY lo) AS n FROM p, d
          UNION ALL
          SELECT x, lo, w, deepest, level, cell, count(*) OVER (PARTITION BY lo, cell) AS n
          FROM (SELECT x, lo, w, deepest, level + 1 AS level,
                       ((x - lo)::HUGEINT * (2 ** (level + 1))::HUGEINT) // w AS cell
                FROM r WHERE n >= {limit} AND level < deepest)),
    leaf AS (SELECT DISTINCT lo, w, level, cell, n FROM r WHERE n < {limit} OR level = deepest)
    SELECT (lo + (cell * w + (2 ** level)::HUGEINT - 1) // (2 ** level)::HUGEINT)::BIGINT AS "start",
           (lo + ((cell + 1) * w + (2 ** level)::HUGEINT - 1) // (2 ** level)::HUGEINT)::BIGINT AS "end",
           n AS num, level::INTEGER AS depth, n >= {limit} AS overflow FROM leaf"""


def whole_span(axis: str) -> str:
    return f"SELECT x, min(x) OVER () AS lo, max(x) OVER () + 1 - min(x) OVER () AS w FROM (SELECT {axis} AS x FROM events)"


@query(breakdown_sql(whole_span("epoch_us(ts)"), 1000))
def range_breakdown(spark, sf_dir):
    return ranges.range_breakdown(table(spark, sf_dir, "events"), micros(F.col("ts")))


@query(
    f"""SELECT make_timestamp("start") AS startdate, make_timestamp("end") AS enddate, num AS numrepos
    FROM ({breakdown_sql(whole_span("epoch_us(ts)"), 1000)}) WHERE NOT overflow"""
)
def stored_periods(spark, sf_dir):
    """The periods table after appending the accepted ranges."""
    path = scratch_path(spark, "periods")
    accepted = ranges.time_breakdown(table(spark, sf_dir, "events"), "ts").filter("not overflow").drop("overflow")
    append_rows(accepted, path, PERIODS)
    return read_dataset(spark, path).withColumns({c: ntz(F.col(c)) for c in ("startdate", "enddate")})


SKEWED_SQL = "((epoch_us(ts) // 1000000 - 1704067200) * (epoch_us(ts) // 1000000 - 1704067200))"


@query(breakdown_sql(whole_span(SKEWED_SQL), 1000))
def range_breakdown_skewed(spark, sf_dir):
    """Most rows crowd at the beginning of the axis."""
    seconds = F.call_function("div", micros(F.col("ts")), F.lit(1_000_000)) - 1704067200
    return ranges.range_breakdown(table(spark, sf_dir, "events"), seconds * seconds)


@query(breakdown_sql(whole_span("epoch_us(date_trunc('day', ts)::TIMESTAMP)"), 340))
def range_breakdown_overflow(spark, sf_dir):
    """Whole days as instants: the fuller ones hold more rows than the limit and cannot be cut."""
    return ranges.range_breakdown(table(spark, sf_dir, "events"), micros(F.date_trunc("day", "ts")), 340)


YEARS = """SELECT epoch_us(o_orderdate) AS x, epoch_us(date_trunc('year', o_orderdate)::TIMESTAMP) AS lo,
    epoch_us(date_trunc('year', o_orderdate)::TIMESTAMP + INTERVAL 1 YEAR) - lo AS w FROM orders"""


@query(
    f"""SELECT make_timestamp("start") AS startdate, make_timestamp("end") AS enddate, num AS numrepos, overflow
    FROM ({breakdown_sql(YEARS, 1000)})"""
)
def range_breakdown_years(spark, sf_dir):
    """Every calendar year halved by itself, all years in one pass."""
    found = ranges.time_breakdown(table(spark, sf_dir, "orders"), "o_orderdate", unit="year")
    return found.withColumns({c: ntz(F.col(c)) for c in ("startdate", "enddate")})


@query(
    """WITH p AS (SELECT user_id, min(ts) AS startdate, max(ts) AS enddate FROM events GROUP BY user_id)
    SELECT startdate, enddate, (SELECT count(*) FROM events WHERE ts >= startdate AND ts < enddate) AS numrepos
    FROM (SELECT DISTINCT startdate, enddate FROM p)"""
)
def count_per_period(spark, sf_dir):
    """Events of anybody within the active time of each user: as many overlapping periods as users."""
    events = table(spark, sf_dir, "events")
    active = events.groupBy("user_id").agg(F.min("ts").alias("startdate"), F.max("ts").alias("enddate"))
    return ranges.count_per_period(events, "ts", active.drop("user_id"))


@query(
    f"""WITH p AS (SELECT startdate, startdate + INTERVAL 12 HOUR AS enddate FROM ({DAYS_SQL}))
    SELECT event_id, startdate, enddate FROM events LEFT JOIN p ON ts >= startdate AND ts < enddate"""
)
def assign_periods(spark, sf_dir):
    """Each event with the morning it happened in, null in the afternoon."""
    mornings = days(spark, sf_dir).select("startdate", (F.col("startdate") + F.expr("interval 12 hours")).alias("enddate"))
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    found = ranges.assign_periods(events, "ts", mornings)
    return found.select("event_id", ntz(F.col("startdate")).alias("startdate"), ntz(F.col("enddate")).alias("enddate"))


OVERLAPPING_SQL = """SELECT user_id, startdate, startdate + to_milliseconds((user_id % 5 * user_id % 9973 + 1) * 60000) AS enddate
    FROM (SELECT user_id, min(ts) AS startdate FROM events WHERE user_id % 3 = 0 GROUP BY user_id)"""


@query(
    f"""WITH p AS (SELECT DISTINCT startdate, enddate FROM ({OVERLAPPING_SQL}))
    SELECT event_id, startdate, enddate FROM events LEFT JOIN p ON ts >= startdate AND ts < enddate"""
)
def assign_overlapping(spark, sf_dir):
    """Each event with all periods it lies in, of a minute to weeks after the first act of some users."""
    events = table(spark, sf_dir, "events")
    first = events.filter("user_id % 3 = 0").groupBy("user_id").agg(F.min("ts").alias("startdate"))
    minutes = F.expr("make_dt_interval(0, 0, CAST(user_id % 5 * user_id % 9973 + 1 AS INT), 0)")
    periods = first.select("startdate", (F.col("startdate") + minutes).alias("enddate")).distinct()
    found = ranges.assign_periods(events.select("event_id", "ts"), "ts", periods)
    return found.select("event_id", ntz(F.col("startdate")).alias("startdate"), ntz(F.col("enddate")).alias("enddate"))


@query(
    f"""SELECT startdate, least(enddate, TIMESTAMP '2024-01-15 12:00:00') AS enddate, numrepos FROM ({DAYS_SQL})
    WHERE startdate <= TIMESTAMP '2024-01-15 12:00:00'"""
)
def clamp_periods(spark, sf_dir):
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp")
    clamped = ranges.clamp_periods(days(spark, sf_dir), as_of)
    return clamped.withColumns({c: ntz(F.col(c)) for c in ("startdate", "enddate")})


@query(
    """SELECT y AS startdate, y + INTERVAL 1 YEAR AS enddate FROM
    (SELECT unnest(generate_series(date_trunc('year', min(o_orderdate))::TIMESTAMP,
                                   date_trunc('year', max(o_orderdate))::TIMESTAMP, INTERVAL 1 YEAR)) AS y FROM orders)"""
)
def period_spine(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"))
    return ranges.year_spine(orders, "at").withColumns({c: ntz(F.col(c)) for c in ("startdate", "enddate")})


@query(
    f"""SELECT startdate, enddate, numrepos, 'h' || sha256(strftime(startdate, '%Y-%m-%dT%H:%M:%S') || '  ' ||
    strftime(enddate, '%Y-%m-%dT%H:%M:%S')) AS period_id FROM ({DAYS_SQL})"""
)
def period_id(spark, sf_dir):
    named = ranges.name_periods(days(spark, sf_dir))
    return named.withColumns({c: ntz(F.col(c)) for c in ("startdate", "enddate")})


@query(
    """SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 300 AS batch
    FROM events"""
)
def page_number(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ranges.batch_number(events, ["event_type"], ["event_id"])


@query(
    """SELECT doc_id, quality::BIGINT AS value FROM labels UNION ALL
    SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def merge_batches(spark, sf_dir):
    """Labels first: where both know a document, the label stays."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("value"))
    lengths = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("value"))
    return ranges.merge_batches([labels, lengths], "doc_id")


@query(
    """SELECT event_id, ts, user_id FROM events
    WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts, event_id"""
)
def range_filter(spark, sf_dir):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return ranges.in_range(events, "ts", at("2024-01-10 00:00:00"), at("2024-01-20 00:00:00")).orderBy("ts", "event_id")


@query(
    """SELECT event_id, ts, user_id FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 0)
    ORDER BY ts, event_id LIMIT 100"""
)
def keyset_page(spark, sf_dir):
    after = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit(0)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return ranges.keyset_page(events, "ts", "event_id", after)
