"""Named queries over the given tables, each with the SQL that must give the same rows."""

from limelight.catalogue import explore, features, ingest, models, ranges, state, text  # noqa: F401
from limelight.catalogue.registry import oracles, runnable

__all__ = ["oracles", "runnable"]
