"""Cutting an axis (usually time) into ranges of bounded row count, and working with ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limelight.functions.timing import from_micros, micros, period_id
from limelight.plans.ordered import SLICE, running_number, running_value, sampled_bounds, slice_of
from limelight.plans.skew import broadcast_if_small, lookup_join
from limelight.sources.scratch import materialise

# A range is small enough below this row count; searches were sent in groups of this size.
RANGE_LIMIT = 1000
BATCH_SIZE = 300

SPARE_LEVELS = 2  # beyond those that an even spread needs
MAX_LEVELS = 56


def _levels(width: int) -> int:
    """Halvings after which every cell of a span of `width` units holds one unit at most."""
    return max(width - 1, 0).bit_length()


def _cell(position: Column, width: Column, level: int, step: int) -> Column:
    """Number of the 2^level-th part of [0, width) holding `position`, exactly floor(position * 2^level / width).

    Done `step` binary digits at a time, long-division style, because the full product would
    not fit into 64 bits.
    """
    cell, rest = F.lit(0).cast("bigint"), position
    done = 0
    while done < level:
        digits = min(step, level - done)
        scaled = rest * (1 << digits)
        cell = cell * (1 << digits) + F.call_function("div", scaled, width)
        rest = scaled % width
        done += digits
    return cell


def _edge(cell: Column) -> Column:
    """First axis value of a cell: lo + ceil(cell * width / 2^level)."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level"))
    product = cell.cast("decimal(19,0)") * F.col("width").cast("decimal(18,0)")
    rounded_up = product + (size - 1).cast("decimal(19,0)")
    return F.col("lo") + F.call_function("div", rounded_up, size.cast("decimal(19,0)"))


def range_breakdown(
    df: DataFrame, axis: Column, limit: int = RANGE_LIMIT, lo: Column | None = None, hi: Column | None = None
) -> DataFrame:
    """Halve the span of `axis` (whole numbers, nulls left out) until a range holds fewer than `limit` rows.

    `lo` and `hi` give the half-open initial range of each row, for instance its calendar
    year; every initial range is halved by itself, all in the same pass, and rows outside of
    theirs are left out. By default there is one, from the smallest to the largest value.

    Returns `start`, `end` (half-open), `num`, `depth` and `overflow`; ranges without rows
    are left out. `overflow` marks a single axis value with `limit` rows or more, which no
    halving can cut.

    One pass counts the rows in cells fine enough for an even spread and adds the counts up the tree of halves.
    Only where a cell of that pass is still too full is the axis counted again: the crowded cells
    are the frontier, rows outside of it are left out before anything is grouped, and its fullest cell says how many
    halvings the next pass takes, as many as there have been at least. So a crowded instant is cut down to its
    unit in a few passes. Counts are pre-aggregated before each shuffle: such an instant is one row per task.
    """
    points = df.select(axis.cast("bigint").alias("x"), *([] if lo is None else [lo.alias("lo"), hi.alias("hi")]))
    points = points.filter("x is not null" if lo is None else "x >= lo and x < hi")
    if lo is None:
        first, last, n = points.agg(F.min("x"), F.max("x"), F.count("*")).first()
        widest = last + 1 - first if n else 0
        points = points.withColumns({"lo": F.lit(first).cast("bigint"), "width": F.lit(widest).cast("bigint")})
    else:
        points = points.select("x", "lo", (F.col("hi") - F.col("lo")).alias("width"))
        widest, n = points.agg(F.max("width"), F.count("*")).first()
    if n == 0:
        return df.sparkSession.createDataFrame([], "start bigint, end bigint, num bigint, depth int, overflow boolean")
    deepest = _levels(widest)
    if deepest > MAX_LEVELS:
        raise ValueError(f"the axis spans more than 2^{MAX_LEVELS} units; use a coarser unit")
    step = 62 - deepest
    leaves, frontier, top, fullest = None, None, 0, n
    while True:
        bottom = min(top + max(top, _levels_needed(fullest, limit)), deepest)
        counts = _cell_counts(points, frontier, top, bottom, step)
        nodes = materialise(_tree(counts, top, bottom), "range-tree")
        found = _leaves(nodes, top, deepest, limit)
        leaves = found if leaves is None else leaves.unionByName(found)
        if bottom == deepest:
            break
        full = (F.col("level") == bottom) & (F.col("n") >= limit)
        frontier = nodes.filter(full).select(F.struct("lo", "width", "cell").alias("root"), "n")
        fullest = frontier.agg(F.max("n")).first()[0]
        if fullest is None:
            break
        frontier, top = materialise(frontier, "crowded-cells"), bottom
    return leaves.select(
        _edge(F.col("cell")).alias("start"),
        _edge(F.col("cell") + 1).alias("end"),
        F.col("n").alias("num"),
        F.col("level").alias("depth"),
        (F.col("n") >= limit).alias("overflow"),
    )


def _levels_needed(rows: int, limit: int) -> int:
    """Halvings that bring an even spread of `rows` below the limit, and some more."""
    return (rows // max(limit, 1)).bit_length() + SPARE_LEVELS


def _cell_counts(points: DataFrame, frontier: DataFrame | None, top: int, bottom: int, step: int) -> DataFrame:
    """Rows per cell of level `bottom`, of those in the cells of level `top` that the frontier (root, n) names.

    The frontier meets the single rows, before they are grouped: what is grouped and shuffled is what is crowded.
    """
    place = F.col("x") - F.col("lo")
    if frontier is not None:
        root = F.struct("lo", "width", _cell(place, F.col("width"), top, step).alias("cell"))
        points = lookup_join(points.withColumn("root", root), frontier.select("root"), "root", lambda: frontier, "n", "inner")
    cell = _cell(place, F.col("width"), bottom, step)
    return points.groupBy("lo", "width", cell.alias("cell")).agg(F.count("*").alias("n"))


def _tree(counts: DataFrame, top: int, bottom: int) -> DataFrame:
    """Counts of all cells from level `top` down to `bottom`, given those of `bottom`."""
    levels = F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("level")
    above = F.call_function("shiftright", F.col("cell"), F.lit(bottom) - F.col("level"))
    lifted = counts.select("lo", "width", "cell", "n", levels).withColumn("cell", above)
    return lifted.groupBy("lo", "width", "level", "cell").agg(F.sum("n").alias("n"))


def _leaves(nodes: DataFrame, top: int, deepest: int, limit: int) -> DataFrame:
    """Cells small enough whose parent was not, and the uncuttable ones at the deepest level.

    The cells of level `top` have no parent here: at the first pass they are leaves if they
    are small, later on they are the crowded cells that this pass refines.
    """
    ends = nodes.filter((F.col("n") < limit) | (F.col("level") == deepest))
    parents = nodes.filter(F.col("n") >= limit).select(
        "lo", "width", (F.col("level") + 1).alias("level"), F.col("cell").alias("parent")
    )
    below = ends.filter(F.col("level") > top).withColumn("parent", F.shiftright("cell", 1))
    found = below.join(parents, ["lo", "width", "level", "parent"], "left_semi").drop("parent")
    return found.unionByName(ends.filter(F.col("level") == top)) if top == 0 else found


def time_breakdown(df: DataFrame, ts: str, limit: int = RANGE_LIMIT, unit: str | None = None) -> DataFrame:
    """`range_breakdown` over a timestamp column, as the stored periods table plus the overflow flag.

    With `unit` ('year', 'month', ...) each calendar unit is an initial period of its own.
    """
    lo = hi = None
    if unit is not None:
        first = F.date_trunc(unit, F.col(ts).cast("timestamp"))
        lo, hi = micros(first), micros(first + F.expr(f"interval 1 {unit}"))
    ranges = range_breakdown(df, micros(F.col(ts)), limit, lo, hi)
    return ranges.select(
        from_micros(F.col("start")).alias("startdate"),
        from_micros(F.col("end")).alias("enddate"),
        F.col("num").alias("numrepos"),
        "overflow",
    )


def count_per_period(rows: DataFrame, ts: str, periods: DataFrame, start: str = "startdate", end: str = "enddate"):
    """Number of rows in each half-open period; periods may overlap, be empty and be as many as the rows.

    rows in [start, end) = rows before `end` minus rows before `start`. Both come from one running sum over
    instants and boundaries in time order: no range join, no broadcast of the periods. Time is cut into slices
    at quantiles of the rows, so a row moves once, to its slice, and nothing is written. An instant that holds
    a slice or more by itself is counted before it moves.
    """
    spark = rows.sparkSession
    facts = rows.select(micros(F.col(ts)).alias("__at")).filter("__at is not null")
    quantiles = sampled_bounds(facts, F.col("__at"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(quantiles))
    crowded = F.col("__at").isin([b for b in bounds if quantiles.count(b) > 1] or [None])
    crowded = F.coalesce(crowded, F.lit(False))
    single = facts.filter(~crowded).withColumn("__n", F.lit(1).cast("bigint"))
    counted = facts.filter(crowded).groupBy("__at").agg(F.count("*").alias("__n"))  # an instant for each quantile at most
    instants = single.unionByName(counted)
    in_slice = slice_of(F.col("__at"), bounds).alias(SLICE)
    kind = {c: periods.schema[c].dataType for c in (start, end)}
    none = [F.lit(None).cast(kind[c]).alias(c) for c in (start, end)]
    events = instants.select("__at", in_slice, F.lit(1).alias("__kind"), *none, F.lit(0).alias("__sign"), "__n")
    # A boundary sorts before the rows of its own instant: it sees only what lies before it.
    sides = F.array(
        F.struct(micros(F.col(start)).alias("__at"), F.lit(-1).alias("__sign")),
        F.struct(micros(F.col(end)).alias("__at"), F.lit(1).alias("__sign")),
    )
    boundaries = periods.select(start, end).distinct().select(start, end, F.inline(sides))
    boundaries = boundaries.select(
        "__at", in_slice, F.lit(0).alias("__kind"), start, end, "__sign", F.lit(0).cast("bigint").alias("__n")
    )
    # Rows before each slice, one number per slice, like the bounds.
    totals = dict(facts.select(in_slice).groupBy(SLICE).count().collect())
    carried = list(accumulate((totals.get(n, 0) for n in range(len(bounds))), initial=0))
    here = Window.partitionBy(SLICE).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.unionByName(boundaries).withColumn("__here", F.sum("__n").over(here)).filter("__kind = 0")
    before = F.col("__here") + F.get(F.lit(carried), F.col(SLICE))
    return swept.groupBy(start, end).agg(F.greatest(F.sum(F.col("__sign") * before), F.lit(0)).alias("numrepos"))


CELLS_PER_PERIOD = 3  # as a power of two: a period is covered by about 2^3 aligned cells


def _cell_key(cell: Column, level: Column) -> Column:
    """One whole number for the cell of a level: twice its middle. The lowest bit that is set tells the level."""
    shift = lambda number, by: F.call_function("shiftleft", number, by)  # wraps around, unlike a product
    return shift(cell, level + 1).bitwiseOR(shift(F.lit(1).cast("bigint"), level))


def period_cells(periods: DataFrame, start: str = "startdate", end: str = "enddate") -> DataFrame:
    """Each period with the aligned cells that cover it: (level, cell) is [cell * 2^level, (cell + 1) * 2^level).

    The level follows the length of the period, so nine cells are enough for any; empty periods have none.
    """
    bounded = periods.select(start, end, micros(F.col(start)).alias("__from"), micros(F.col(end)).alias("__to"))
    level = F.greatest(F.length(F.bin(F.col("__to") - F.col("__from"))) - CELLS_PER_PERIOD, F.lit(0))
    shift = lambda at: F.call_function("shiftright", at, F.col("__level"))
    return (
        bounded.filter("__from < __to")
        .withColumn("__level", level)
        .withColumn("__cell", F.explode(F.sequence(shift(F.col("__from")), shift(F.col("__to") - 1))))
        .withColumn("__key", _cell_key(F.col("__cell"), F.col("__level")))
    )


BLOCK_ROWS = 64  # rows side by side in time that meet a period together
GRID_ROWS = 16 * BLOCK_ROWS  # rows of a cell that is cut into blocks, on the average: most blocks are full
PART_PERIODS = 128  # of a cell; Spark holds the matches of a block with a part in memory
TASK_ROWS = 1 << 16  # rows whose matches one task makes; so few values are stored as places in a list


def assign_periods(rows: DataFrame, ts: str, periods: DataFrame, start: str = "startdate", end: str = "enddate"):
    """Each row with every period it lies in; once with nulls if there is none. Periods may overlap.

    Periods are covered by aligned cells. A row knows its cell of any level, so rows and periods meet in an equality
    join on the cell's key, a single long, which Spark looks up and walks through faster than a pair of columns; the
    cells at the ends of a period are compared exactly. A row is looked up once per level, of which there are as many
    as orders of magnitude of period lengths. Few cells are broadcast.

    With periods of one length no row moves then. With several, a row may have thousands of matches, which the result
    has to hold. Periods much longer than it takes for some hundred rows to come therefore meet blocks of rows, and the
    result has the rows of a block period after period: a block is looked up once, and where the result is stored, a
    period is one entry for a block and the block's rows repeat. Shorter periods meet single rows, dealt evenly:
    otherwise a file of few row groups would leave all matches to as few tasks.
    """
    cells = period_cells(periods, start, end).drop("__cell")
    cells = materialise(cells.orderBy("__key"), "period-cells")  # periods of a cell lie side by side, also when broadcast
    levels = sorted(r[0] for r in cells.select("__level").distinct().collect())  # 63 at most
    none = [F.lit(None).cast(periods.schema[c].dataType).alias(c) for c in (start, end)]
    placed = rows.withColumn("__at", micros(F.col(ts)))
    first, last, n = placed.agg(F.min("__at"), F.max("__at"), F.count("__at")).first() if len(levels) > 1 else (0, 0, 1)
    if not levels or not n:
        return rows.select("*", *none)
    sided, small = broadcast_if_small(cells)
    at, columns = F.col("__at"), [*rows.columns, start, end]
    if len(levels) == 1:
        placed = placed.withColumn("__row_key", _cell_key(F.shiftright(at, levels[0]), F.lit(levels[0])))
        return placed.join(sided, (F.col("__row_key") == F.col("__key")) & _within(at), "left").select(*columns)
    grid = max(((last - first + 1) * GRID_ROWS // n).bit_length() - 1, 0)
    tasks = max(_tasks(rows.sparkSession), -(-n // TASK_ROWS))
    short, long = [level for level in levels if level < grid], [level for level in levels if level >= grid]
    found = []
    if long:
        far = sided.filter(F.col("__level") >= grid)
        most = cells.filter(F.col("__level") >= grid).groupBy("__key").count().agg(F.max("count")).first()[0]
        parts = min(-(-most // PART_PERIODS), 1 << grid)  # the low bits of these keys are free
        far = far.withColumn("__key", F.col("__key").bitwiseOR(F.pmod(F.xxhash64(start, end), F.lit(parts))))
        # The lambda is not compiled into one loop with the join, which would hold the matches of all keys of a block at once.
        in_parts = lambda key: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: key.bitwiseOR(p.cast("bigint")))
        keys = F.flatten(F.array(*[in_parts(key) for key in _keys(F.col("__grid"), grid, long)]))
        blocks = _blocks(placed.filter("__at is not null"), grid, tasks).withColumn("__row_key", F.explode(keys))
        touch = (F.col("__from") <= F.col("__last")) & (F.col("__first") < F.col("__to"))
        met = blocks.join(far, (F.col("__row_key") == F.col("__key")) & touch)
        single = met.select(start, end, "__from", "__to", F.inline("__rows"))
        found.append(single.filter(_within(at)).select(*columns))
    if short:
        dealt = (placed.repartition(tasks) if small else placed).withColumn("__row_key", F.explode(F.array(*_keys(at, 0, short))))
        near = sided.filter(F.col("__level") < grid)
        found.append(dealt.join(near, (F.col("__row_key") == F.col("__key")) & _within(at)).select(*columns))
    # Which rows have no period depends on the union of all periods alone.
    outside = _outside(rows, ts, cells.select(start, end).distinct(), start, end)
    return reduce(DataFrame.unionByName, [*found, outside.select(*rows.columns, *none)])


def _within(at: Column) -> Column:
    return (at >= F.col("__from")) & (at < F.col("__to"))


def _keys(cell: Column, level: int, levels: Sequence[int]) -> list[Column]:
    """The keys of the cells of `levels` that hold a `cell` of `level`."""
    return [_cell_key(F.call_function("shiftright", cell, F.lit(n - level)), F.lit(n)) for n in levels]


def _blocks(placed: DataFrame, grid: int, tasks: int) -> DataFrame:
    """Rows in arrays of up to `BLOCK_ROWS` that lie side by side in one cell of level `grid`, dealt evenly to the tasks.

    An instant that holds many rows fills as many blocks.
    """
    tie = F.xxhash64(*placed.columns)
    ordered = placed.repartitionByRange(tasks, "__at", tie).sortWithinPartitions("__at", tie)
    number = F.call_function("div", F.monotonically_increasing_id(), F.lit(BLOCK_ROWS))
    numbered = ordered.withColumns({"__block": number, "__grid": F.shiftright("__at", grid)})
    gathered = numbered.repartition(tasks, "__grid", "__block").groupBy("__grid", "__block")
    members = F.collect_list(F.struct(*placed.columns)).alias("__rows")
    return gathered.agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), members)


def _tasks(spark) -> int:
    """Enough for every core, and as many as shuffles are set to have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _outside(rows: DataFrame, ts: str, periods: DataFrame, start: str, end: str) -> DataFrame:
    """Rows in none of the periods: after the last start before them, the latest end so far has passed.

    Boundaries are sorted in among the rows and the latest end carried forward, so a row is moved once and never
    compared with a period.
    """
    # The hash spreads rows of one crowded instant over several slices.
    facts = rows.withColumns({"__at": micros(F.col(ts)), "__kind": F.lit(1), "__tie": F.xxhash64(*rows.columns)})
    facts = facts.withColumn("__until", F.lit(None).cast("bigint"))
    marks = periods.select(
        micros(F.col(start)).alias("__at"),
        F.lit(0).alias("__kind"),
        F.lit(0).cast("bigint").alias("__tie"),
        micros(F.col(end)).alias("__until"),
    )
    merged = facts.filter("__at is not null").unionByName(marks, allowMissingColumns=True)
    swept = running_value(merged, ["__at", "__kind", "__tie"], "max", "__until", "__latest").filter("__kind = 1")
    apart = swept.filter("__latest is null or __at >= __latest").select(*rows.columns)
    return apart.unionByName(rows.filter(F.col(ts).isNull()))


def clamp_periods(periods: DataFrame, as_of: Column | None = None, start: str = "startdate", end: str = "enddate"):
    """Periods up to `as_of` (default: now): later ones dropped, the running one cut short."""
    moment = F.current_timestamp() if as_of is None else as_of
    return periods.filter(F.col(start) <= moment).withColumn(end, F.least(F.col(end), moment))


def year_spine(df: DataFrame, ts: str) -> DataFrame:
    """The calendar years touched by the data, as half-open periods."""
    year = lambda c: F.date_trunc("year", c)
    first_last = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).filter("lo is not null")
    step = F.expr("interval 1 year")
    starts = first_last.select(F.explode(F.sequence(year(F.col("lo")), year(F.col("hi")), step)).alias("startdate"))
    return starts.withColumn("enddate", F.col("startdate") + step)


def name_periods(periods: DataFrame, start: str = "startdate", end: str = "enddate") -> DataFrame:
    return periods.withColumn("period_id", period_id(F.col(start), F.col(end)))


def batch_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = BATCH_SIZE) -> DataFrame:
    """0-based number of the batch of `size` rows, in order, within each key."""
    numbered = running_number(df, keys, order, "__number")
    batch = F.call_function("div", F.col("__number") - 1, F.lit(size))
    return numbered.withColumn("batch", batch).drop("__number")


def merge_batches(batches: Sequence[DataFrame], key: str) -> DataFrame:
    """All batches as one table; for a key in several, the row of the earliest batch."""
    tagged = [b.withColumn("__batch", F.lit(i)) for i, b in enumerate(batches)]
    merged = tagged[0]
    for batch in tagged[1:]:
        merged = merged.unionByName(batch)
    rest = [c for c in merged.columns if c not in (key, "__batch")]
    first = Window.partitionBy(key).orderBy("__batch", *rest)
    # Spark keeps the first row per key on the sending side too, so a frequent key is not moved whole.
    return merged.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn", "__batch")


def in_range(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end))


def keyset_page(df: DataFrame, ts: str, key: str, after: tuple[Column, Column] | None, size: int = 100) -> DataFrame:
    """The `size` rows that follow the cursor in (ts, key) order."""
    if after is not None:
        at, last = after
        # The first condition is implied by the second, but only it can be pushed to the scan.
        df = df.filter(F.col(ts) >= at).filter((F.col(ts) > at) | (F.col(key) > last))
    return df.orderBy(ts, key).limit(size)
