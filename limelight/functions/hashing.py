"""Layout-independent pseudo-random numbers: a function of the purpose, the seed and the row key only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def key_hash(key: Column, seed: int, purpose: str = "hash") -> Column:
    """Uniform whole number in [0, 2^32), equal for equal (purpose, seed, key) on any cluster and any file layout.

    Numbers for different purposes are independent, so a sample can be split and a split cut into subsets.
    """
    digest = F.sha2(F.concat(F.lit(f"{purpose}:{seed}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def in_sample(key: Column, percent: float, seed: int) -> Column:
    return key_hash(key, seed, "sample") < round(HASH_RANGE * percent / 100)


def split_name(key: Column, weights: dict[str, float], seed: int) -> Column:
    """Name of the part the row falls into; parts get shares proportional to their weights."""
    total = sum(weights.values())
    h = key_hash(key, seed, "split")
    names = list(weights)
    edge, branches = 0.0, None
    for name in names[:-1]:
        edge += weights[name] / total
        hit = h < round(edge * HASH_RANGE)
        branches = F.when(hit, name) if branches is None else branches.when(hit, name)
    return F.lit(names[-1]) if branches is None else branches.otherwise(names[-1])


def subset_number(key: Column, subsets: int, seed: int, purpose: str = "subset") -> Column:
    return key_hash(key, seed, purpose) % subsets
