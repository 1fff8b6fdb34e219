"""Running values over a global order, computed slice by slice.

`sum(...) over (order by ...)` moves every row to one task, and `over (partition by k ...)`
does so for a key that holds most rows. Here rows are range-partitioned by the order
instead (Spark samples the bounds, so slices are of like size whatever the distribution),
each slice is scanned by itself, and what came before a slice is added from a table with
one row per slice. The slice number is stored with the rows because sampled bounds may
differ between two evaluations of the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limelight.plans.skew import broadcast_if_small
from limelight.sources.scratch import materialise

SLICE = "__slice"
POSITION_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def sliced(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows with the number of the slice of the order they fall into."""
    return materialise(df.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id()), "sliced")


def sampled_bounds(df: DataFrame, value: Column, slices: int) -> list[int]:
    """At most `slices` - 1 whole numbers that cut the rows into slices of like size, in one map-side aggregate.

    A number that occurs more than once in the list holds a whole slice or more by itself.
    """
    at = F.array(*[F.lit(k / slices) for k in range(1, slices)])
    return list(df.agg(F.percentile_approx(value, at, 20 * slices)).first()[0] or []) if slices > 1 else []


def slice_of(value: Column, bounds: Sequence[int]) -> Column:
    """Number of the sorted `bounds` that are not above `value`, by a binary search written out as an expression."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(bounds[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(bounds))


def _running(name: str, value: Column) -> Column:
    return {"sum": F.sum, "max": F.max}[name](value)


def running_value(df: DataFrame, order: Sequence[str | Column], kind: str, value: str, out: str) -> DataFrame:
    """`kind` ('sum' or 'max') of `value` over all rows up to and including the current one.

    `order` must tell any two rows apart, or be indifferent to their mutual order.
    """
    rows = sliced(df, order)
    # One row per slice: at most as many as there are shuffle partitions.
    totals = rows.groupBy(SLICE).agg(_running(kind, F.col(value)).alias("__total"))
    earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(SLICE, _running(kind, F.col("__total")).over(earlier).alias("__carried"))
    here = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumn("__here", _running(kind, F.col(value)).over(here)).join(
        F.broadcast(carried), SLICE, "left"
    )
    if kind == "sum":
        result = F.col("__here") + F.coalesce("__carried", F.lit(0))
    else:
        result = F.greatest("__here", "__carried")  # greatest skips nulls
    return joined.withColumn(out, result).drop(SLICE, "__here", "__carried")


def running_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based place of each row within its key; a key may be spread over many slices.

    `order` must be unique within a key. Rows are stored in order with their position, whose
    high bits are the slice. What is left to find out is where each key begins in each slice,
    a table of one row per key plus one per slice at most.
    """
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = materialise(placed.withColumn("__at", F.monotonically_increasing_id()), "placed")
    rows = rows.withColumn(SLICE, F.shiftright("__at", POSITION_BITS))
    runs = rows.groupBy(*keys, SLICE).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(earlier), F.lit(0))
    starts = runs.select(*keys, SLICE, (F.col("__first") - before).alias("__start"))
    starts, _ = broadcast_if_small(materialise(starts, "starts"))
    same = F.col(f"r.{SLICE}") == F.col(f"s.{SLICE}")
    for key in keys:
        same &= F.col(f"r.{key}").eqNullSafe(F.col(f"s.{key}"))
    number = F.col("__at") - F.col("__start") + 1
    return (
        rows.alias("r").join(starts.alias("s"), same).select(*[F.col(f"r.{c}") for c in df.columns], number.alias(out))
    )
