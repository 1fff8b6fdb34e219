"""Equi-join of many rows with a keyed table when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_FRACTION = 1000
BROADCAST_BYTES = 16 << 20  # as stored
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(stored: DataFrame, same_size: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """A stored table (or one of no more rows and bytes) marked for broadcast if its files and its rows are few enough.

    Both are checked: many short rows take little room in files, few long ones do not show in a count.
    """
    target = stored if same_size is None else same_size
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = size <= BROADCAST_BYTES and stored.count() <= BROADCAST_ROWS
    return (F.broadcast(target) if small else target), small


def hot_keys(weights: DataFrame, weight: str, fraction: int = HOT_FRACTION) -> DataFrame:
    """Keys with at least 1/fraction of the total weight; there cannot be more than `fraction` of them."""
    total = weights.agg(F.sum(weight)).scalar()
    return weights.filter(F.col(weight) * fraction >= total)


def lookup_join(
    rows: DataFrame, lookup: DataFrame, key: str, weights: Callable[[], DataFrame], weight: str, how: str
) -> DataFrame:
    """`rows` joined with `lookup` (unique on `key`) by 'inner' or 'left'.

    A small `lookup` is broadcast. Beyond that, rows with a hot key meet a broadcast copy of
    the few hot lookup rows and are never shuffled; the others, each key under 1/1000 of all
    rows, take the shuffled join. `weights` gives the number of rows per key; it is asked
    for only then. Pass stored tables: they are read more than once.
    """
    sided, small = broadcast_if_small(lookup)
    if small:
        return rows.join(sided, key, how)
    hot = F.broadcast(hot_keys(weights(), weight).select(key))
    hot_lookup = F.broadcast(lookup.join(hot, key, "left_semi"))
    hot_rows = rows if how == "inner" else rows.join(hot, key, "left_semi")
    cold_rows = rows.join(hot, key, "left_anti")
    return hot_rows.join(hot_lookup, key, how).unionByName(cold_rows.join(lookup, key, how))
