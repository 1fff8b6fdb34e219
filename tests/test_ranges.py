import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from limelight.operators import ranges
from limelight.plans import skew
from limelight.plans.ordered import SLICE, running_value, sliced


@pytest.fixture(params=["one slice", "many slices"])
def slices(spark, request):
    """Small data end up in one slice of the order unless Spark is kept from merging slices."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    if request.param == "many slices":
        spark.conf.set(name, "false")
    yield 1 if request.param == "one slice" else 4
    spark.conf.unset(name)


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x bigint")


def leaves(spark, values, limit):
    found = ranges.range_breakdown(numbers(spark, values), F.col("x"), limit).orderBy("start").collect()
    return [(r.start, r.end, r.num, r.overflow) for r in found]


def by_halving(values, limit):
    """Straight recursion over exact dyadic parts of [lo, hi + 1)."""
    values = [v for v in values if v is not None]
    if not values:
        return []
    lo, width = min(values), max(values) + 1 - min(values)
    deepest = max(width - 1, 0).bit_length()
    edge = lambda cell, level: lo - (-(cell * width) // (1 << level))
    out, todo = [], [(0, 0)]
    while todo:
        level, cell = todo.pop()
        start, end = edge(cell, level), edge(cell + 1, level)
        inside = [v for v in values if start <= v < end]
        if not inside:
            continue
        if len(inside) < limit or level == deepest:
            out.append((start, end, len(inside), len(inside) >= limit))
        else:
            todo += [(level + 1, 2 * cell), (level + 1, 2 * cell + 1)]
    return sorted(out)


CASES = {
    "empty": ([], 5),
    "only nulls": ([None, None], 5),
    "one row": ([42], 5),
    "limit - 1 rows": (list(range(4)), 5),
    "limit rows": (list(range(5)), 5),
    "one crowded instant": ([7] * 9 + [1_000_000_000_000], 5),
    "all in one instant": ([7] * 9, 5),
    "negative axis": (list(range(-50, 50, 3)), 4),
    "nine years of microseconds": ([0, 1, 2, 3, 4, 5, (1 << 48) - 2], 3),
    "a thousand years of microseconds": ([-5, 1, 1, 2, 3, 1 << 40, (1 << 40) + 1, (1 << 55) - 9], 2),
}


@pytest.mark.parametrize("name", CASES)
def test_breakdown_cases(spark, name):
    values, limit = CASES[name]
    assert leaves(spark, values, limit) == by_halving(values, limit)


@pytest.mark.parametrize("seed", range(4))
def test_breakdown_properties(spark, seed):
    rng = random.Random(seed)
    width = rng.choice([10, 1000, 10**6, 10**13])
    values = [int(width * rng.random() ** rng.choice([1, 4, 12])) for _ in range(rng.randint(50, 400))]
    values += [rng.choice(values)] * rng.randint(0, 200)
    limit = rng.choice([2, 10, 60])
    found = leaves(spark, values, limit)
    assert found == by_halving(values, limit)
    assert sum(n for _, _, n, _ in found) == len(values)
    assert all(b[0] >= a[1] for a, b in zip(found, found[1:]))
    assert all((n < limit) != overflow and (not overflow or end - start == 1) for start, end, n, overflow in found)


def test_initial_ranges_are_halved_separately(spark):
    rng = random.Random(9)
    values = [rng.randrange(1000) for _ in range(300)] + [450] * 30
    df = numbers(spark, values + [None])
    hundred = F.call_function("div", F.col("x"), F.lit(100)) * 100
    # Rows beyond 900 lie outside of their range.
    found = ranges.range_breakdown(df, F.col("x"), 10, hundred, F.least(hundred + 100, F.lit(900))).collect()
    want = []
    for lo in range(0, 900, 100):
        inside = [v for v in values if lo <= v < lo + 100]
        deepest, todo = 7, [(0, 0)]
        edge = lambda cell, level: lo - (-(cell * 100) // (1 << level))
        while todo:
            level, cell = todo.pop()
            here = sum(edge(cell, level) <= v < edge(cell + 1, level) for v in inside)
            if here and (here < 10 or level == deepest):
                want.append((edge(cell, level), edge(cell + 1, level), here))
            elif here:
                todo += [(level + 1, 2 * cell), (level + 1, 2 * cell + 1)]
    assert sorted((r.start, r.end, r.num) for r in found) == sorted(want)


def test_breakdown_refuses_too_wide_an_axis(spark):
    with pytest.raises(ValueError):
        ranges.range_breakdown(numbers(spark, [0, 1 << 56]), F.col("x"))


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def test_time_breakdown_feeds_period_operators(spark):
    times = [at(m) for m in range(50)] + [at(7)] * 20
    rows = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    periods = ranges.time_breakdown(rows, "ts", 10)
    again = ranges.count_per_period(rows, "ts", periods.drop("overflow", "numrepos"))
    key = lambda df: sorted((r.startdate, r.enddate, r.numrepos) for r in df.collect())
    assert key(periods) == key(again)


def test_slices(spark, slices):
    rows = sliced(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")), ["x"])
    ends = rows.groupBy(SLICE).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy(SLICE).collect()
    assert len(ends) == slices
    assert all(a.hi < b.lo for a, b in zip(ends, ends[1:]))


def test_running_values(spark, slices):
    rng = random.Random(2)
    values = [(i, rng.randrange(100), rng.randrange(50) if rng.random() < 0.3 else None) for i in range(500)]
    df = spark.createDataFrame(values, "i int, n bigint, m int").repartition(3)
    total, top = 0, None
    sums = {r.i: r.out for r in running_value(df, ["i"], "sum", "n", "out").collect()}
    tops = {r.i: r.out for r in running_value(df, ["i"], "max", "m", "out").collect()}
    assert len(sums) == len(tops) == 500
    for i, n, m in values:
        total += n
        top = m if top is None else top if m is None else max(top, m)
        assert (sums[i], tops[i]) == (total, top)


@pytest.mark.parametrize("seed", range(2))
def test_count_per_period(spark, slices, seed):
    """Overlapping, empty, inverted and repeated periods; a third of the rows share an instant."""
    rng = random.Random(seed)
    times = [rng.randrange(200) for _ in range(200)] + [50] * 100
    periods = [(rng.randrange(220), rng.randrange(220)) for _ in range(60)] + [(50, 51), (51, 52), (0, 50), (50, 50)]
    rows = spark.createDataFrame([(at(t),) for t in times] + [(None,)], "ts timestamp")
    frame = spark.createDataFrame([(at(a), at(b)) for a, b in periods * 2], "startdate timestamp, enddate timestamp")
    got = {(r.startdate, r.enddate): r.numrepos for r in ranges.count_per_period(rows, "ts", frame).collect()}
    assert got == {(at(a), at(b)): sum(a <= t < b for t in times) for a, b in set(periods)}


def test_assign_periods(spark, slices):
    periods = [(0, 10), (10, 15), (30, 40)]
    times = [-1, 0, 9, 10, 14, 15, 29, 30, 39, 40, 100] + [12] * 50
    rows = spark.createDataFrame(
        [(i, at(t)) for i, t in enumerate(times)] + [(999, None)], "id bigint, ts timestamp"
    )
    frame = spark.createDataFrame([(at(a), at(b)) for a, b in periods], "startdate timestamp, enddate timestamp")
    got = {r.id: (r.startdate, r.enddate) for r in ranges.assign_periods(rows, "ts", frame).collect()}
    assert got.pop(999) == (None, None)
    for i, t in enumerate(times):
        want = next(((at(a), at(b)) for a, b in periods if a <= t < b), (None, None))
        assert got[i] == want


def test_batch_number_of_a_hot_key(spark, slices):
    """One key holds most rows and so spans several slices of the order."""
    rows = [("hot", i) for i in range(700)] + [("cold", i) for i in range(10)] + [(None, i) for i in range(30)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i bigint").repartition(5)
    got = ranges.batch_number(df, ["k"], ["i"], 20).collect()
    assert len(got) == len(rows)
    assert all(r.batch == r.i // 20 for r in got)


def test_batch_number_with_more_keys_than_fit_a_broadcast(spark, slices, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 3)
    rows = [(k, i) for k in range(50) for i in range(7)] + [(None, i) for i in range(200)]
    random.Random(4).shuffle(rows)
    got = ranges.batch_number(spark.createDataFrame(rows, "k int, i bigint"), ["k"], ["i"], 3).collect()
    assert len(got) == len(rows) and all(r.batch == r.i // 3 for r in got)


def test_merge_batches_first_wins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "id string, v int")
    b = spark.createDataFrame([("y", 2), ("z", 2)], "id string, v int")
    c = spark.createDataFrame([("x", 3), ("z", 3), ("w", 3)], "id string, v int")
    got = {r.id: r.v for r in ranges.merge_batches([a, b, c], "id").collect()}
    assert got == {"x": 1, "y": 1, "z": 2, "w": 3}


def test_clamp_and_spine(spark):
    periods = spark.createDataFrame(
        [(at(0), at(10)), (at(10), at(20)), (at(20), at(30))], "startdate timestamp, enddate timestamp"
    )
    got = ranges.clamp_periods(periods, F.lit(at(15)))
    assert sorted((r.startdate, r.enddate) for r in got.collect()) == [(at(0), at(10)), (at(10), at(15))]
    assert ranges.clamp_periods(periods).count() == 3
    dates = spark.createDataFrame([(datetime(2016, 5, 1),), (datetime(2018, 1, 1),)], "d timestamp")
    years = [(r.startdate.year, (r.enddate - r.startdate).days) for r in ranges.year_spine(dates, "d").collect()]
    assert sorted(years) == [(2016, 366), (2017, 365), (2018, 365)]
    assert ranges.year_spine(dates.limit(0), "d").count() == 0


def test_keyset_pages_visit_every_row_once(spark):
    rows = [(at(i // 3), i) for i in range(25)]
    df = spark.createDataFrame(rows, "ts timestamp, id bigint").repartition(3)
    seen, after = [], None
    while page := ranges.keyset_page(df, "ts", "id", after, 10).collect():
        seen += [(r.ts, r.id) for r in page]
        after = F.lit(page[-1].ts), F.lit(page[-1].id)
    assert seen == rows


def test_overlapping_periods_give_a_row_per_match(spark):
    rng = random.Random(4)
    second = lambda n: datetime(2024, 1, 1) + timedelta(seconds=n)
    rows = [(i, None if i % 50 == 0 else second(rng.choice([7_000, rng.randrange(20_000)]))) for i in range(400)]
    periods = [(second(a), second(a + rng.choice([0, 1, 3, 60, 900, 8_000]))) for a in rng.choices(range(20_000), k=60)]
    periods += [(second(7_000), second(7_001)), (second(7_000), second(7_001)), (None, second(5)), (second(5), None), (second(9), second(2))]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    found = ranges.assign_periods(df, "ts", spark.createDataFrame(periods, "startdate timestamp, enddate timestamp"))
    got = Counter((r.id, r.startdate, r.enddate) for r in found.collect())
    expected = Counter()
    for i, t in rows:
        inside = [p for p in periods if t and all(p) and p[0] <= t < p[1]]
        expected.update([(i, *p) for p in inside] or [(i, None, None)])
    assert got == expected


def test_matches_of_one_row_group_are_made_by_all_tasks(spark):
    """Rows that one task reads, each in many periods of several lengths, on both sides of 1970."""
    second = lambda n: datetime(1970, 1, 1) + timedelta(seconds=n)
    rows = [(i, second(20 * i - 4_000)) for i in range(400)]
    periods = [(second(a), second(a + length)) for a in range(-5_000, 5_000, 500) for length in (7, 900, 6_000)]
    df = spark.createDataFrame(rows, "id int, ts timestamp").coalesce(1)
    found = ranges.assign_periods(df, "ts", spark.createDataFrame(periods, "startdate timestamp, enddate timestamp"))
    got = found.withColumn("task", F.spark_partition_id()).filter("startdate is not null").collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter((i, t, *p) for i, t in rows for p in periods if p[0] <= t < p[1])
    assert max(Counter(r.task for r in got).values()) * 2 < len(got)


@pytest.mark.parametrize("few", [skew.BROADCAST_ROWS, 3])
def test_blocks_of_rows_meet_parts_of_cells(spark, monkeypatch, few):
    """Blocks and single rows, an instant that fills many blocks, a cell of many parts; periods broadcast and not."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", few)
    for name, value in (("BLOCK_ROWS", 4), ("GRID_ROWS", 8), ("PART_PERIODS", 3), ("TASK_ROWS", 100)):
        monkeypatch.setattr(ranges, name, value)
    rng = random.Random(6)
    second = lambda n: datetime(1970, 1, 1) + timedelta(seconds=n)
    rows = [(i, None if i % 60 == 0 else second(rng.choice([100, rng.randrange(-9_000, 9_000)]))) for i in range(300)]
    periods = {(second(a), second(a + rng.choice([0, 1, 60, 900, 5_000, 9_000]))) for a in rng.choices(range(-9_000, 9_000), k=90)}
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    found = ranges.assign_periods(df, "ts", spark.createDataFrame(list(periods), "startdate timestamp, enddate timestamp"))
    expected = Counter()
    for i, t in rows:
        inside = [p for p in periods if t and p[0] <= t < p[1]]
        expected.update([(i, t, *p) for p in inside] or [(i, t, None, None)])
    assert Counter(tuple(r) for r in found.collect()) == expected


def test_matches_of_long_periods_are_stored_in_little_room(spark, tmp_path):
    """The result grows with rows times periods; its files must not need bytes for each of these."""
    second = lambda n: datetime(2024, 1, 1) + timedelta(seconds=n)
    df = spark.range(20_000).selectExpr("id", "timestamp_seconds(1704067200 + id * 7919 % 20000) AS ts")
    periods = [(second(37 * i % 2_500), second(17_500 + 53 * i % 2_500 - i % 2 * 7_500)) for i in range(600)]
    asked = spark.createDataFrame(periods, "startdate timestamp, enddate timestamp").distinct()
    ranges.assign_periods(df, "ts", asked).select("id", "startdate", "enddate").write.parquet(f"{tmp_path}/found")
    matches = spark.read.parquet(f"{tmp_path}/found").filter("startdate is not null").count()
    assert matches == sum((b - a).seconds for a, b in set(periods))
    assert 2 * sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet")) < matches


def test_cells_of_all_levels_have_keys_of_their_own(spark):
    cells = spark.range(-40, 40).select("id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("level"))
    keys = cells.select(ranges._cell_key(F.col("id"), F.col("level")).alias("key"))
    assert keys.distinct().count() == 80 * 21


def test_one_length_needs_no_shuffle_of_rows(spark, plan):
    hour = lambda h: datetime(2024, 1, 1, h)
    rows = spark.createDataFrame([(hour(5),)], "ts timestamp")
    touching = spark.createDataFrame([(hour(0), hour(3)), (hour(3), hour(6))], "startdate timestamp, enddate timestamp")
    found = ranges.assign_periods(rows, "ts", touching)
    assert found.first()["startdate"] == hour(3)
    assert "hashpartitioning" not in plan(found) and "NestedLoop" not in plan(found)
    none = ranges.assign_periods(rows, "ts", touching.limit(0)).collect()
    assert [tuple(r) for r in none] == [(hour(5), None, None)]


def test_periods_are_counted_with_one_exchange_of_rows(spark, plan):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    periods = events.groupBy("user_id").agg(F.min("ts").alias("startdate"), F.max("ts").alias("enddate"))
    text = plan(ranges.count_per_period(events, "ts", periods.drop("user_id")))
    assert len(re.findall(r"Exchange hashpartitioning\(__slice", text)) == 1
    assert "rangepartitioning" not in text


def test_a_crowded_instant_is_counted_before_it_moves(spark, monkeypatch):
    second = lambda n: datetime(2024, 1, 1) + timedelta(seconds=n)
    rng = random.Random(3)
    times = [second(500)] * 700 + [second(rng.randrange(1000)) for _ in range(300)] + [None]
    periods = [(second(a), second(b)) for a in range(0, 1000, 90) for b in (a, a + 1, 500, 501, 2000)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp").repartition(5)
    asked = spark.createDataFrame(periods, "startdate timestamp, enddate timestamp")
    found = ranges.count_per_period(df, "ts", asked).collect()
    assert {(r.startdate, r.enddate): r.numrepos for r in found} == {
        (a, b): sum(a <= t < b for t in times if t) for a, b in periods
    }
    nothing = ranges.count_per_period(df.limit(0), "ts", asked).collect()
    assert {r.numrepos for r in nothing} == {0} and len(nothing) == len(set(periods))


def test_frontier_is_met_before_grouping(spark, plan):
    points = spark.range(1000).selectExpr("id AS x", "0L AS lo", "1000L AS width")
    root = F.struct(F.lit(0).cast("bigint").alias("lo"), F.lit(1000).cast("bigint").alias("width"), F.lit(0).cast("bigint").alias("cell"))
    frontier = spark.range(1).select(root.alias("root"), F.lit(900).cast("bigint").alias("n"))
    text = plan(ranges._cell_counts(points, frontier, 3, 9, 20))
    assert text.index("HashAggregate") < text.rindex("HashAggregate") < text.index("Join")  # children come below


def test_depth_has_no_cap_per_pass(spark):
    # One unit in 2^50 holds nearly all rows: the first pass sees one full cell, the next ones dig it out.
    values = [1 << 49] * 3_000 + [0, (1 << 50) - 1] + [(1 << 49) + 2]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    found = ranges.range_breakdown(df, F.col("x"), 1000).collect()
    crowded = [r for r in found if r.overflow]
    assert [(r.start, r.end, r.num) for r in crowded] == [(1 << 49, (1 << 49) + 1, 3_000)]
    assert sum(r.num for r in found) == len(values)
