"""Instants as whole microseconds, period boundaries and period names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (read as UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c)


def boundary_text(c: Column) -> Column:
    return F.date_format(c, BOUNDARY_FORMAT)


def period_id(start: Column, end: Column) -> Column:
    """A name for the period that starts with a letter and depends on its boundaries alone."""
    return F.concat(F.lit("h"), F.sha2(F.concat_ws("  ", boundary_text(start), boundary_text(end)), 256))
