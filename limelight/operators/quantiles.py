"""Exact order statistics without sorting the table: counts per slice, then only the slices that hold a wanted rank."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, inf

from pyspark.ml import Estimator
from pyspark.ml.feature import Bucketizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.plans.ordered import slice_of

FIRST_SLICES, MORE_SLICES = 64, 16
FEW = 4_000  # different values of a slice that are looked at one by one
ACCURACY = 10_000


def _usable(df: DataFrame, column: str) -> DataFrame:
    value = F.col(column).cast("double")
    return df.select(value.alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")


def order_statistics(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """For each share s of the n values (nulls and NaN left out) the one at rank ceil(s * n), 1 for the smallest.

    Every round cuts the slices that hold a wanted rank by sampled quantiles of their own and counts the rows of the
    parts, each task adding up first; nothing is sorted or moved but counts. A slice with few different values is looked
    at value by value, so ties cost nothing. The number of rounds grows with the logarithm of n. Empty: no numbers.
    """
    values = _usable(df, column)
    n = values.count()
    if not n:
        return []
    ranks = [max(1, ceil(s * n)) for s in shares]
    found: dict[int, float] = {}
    # Open slices [low, high) with the number of rows below them; at first there is one.
    open_: list[tuple[float, float, int]] = [(-inf, inf, 0)]
    slices = FIRST_SLICES
    while wanted := [r for r in ranks if r not in found]:
        inside = F.lit(False)
        for low, high, _ in open_:
            inside |= (F.col("v") >= low) & (F.col("v") <= high if high == inf else F.col("v") < high)
        edges = sorted({edge for low, high, _ in open_ for edge in (low, high)} - {-inf, inf})
        asked = F.percentile_approx("v", [k / slices for k in range(1, slices)], ACCURACY)
        near = values.filter(inside).withColumn("s", slice_of(F.col("v"), edges))
        cuts = near.groupBy("s").agg(asked.alias("q"), F.approx_count_distinct("v").alias("kinds"))
        cuts = cuts.collect()  # a row per open slice
        few = [r["s"] for r in cuts if r["kinds"] <= FEW // 2]
        if few:
            counts = near.filter(F.col("s").isin(few)).groupBy("s", "v").agg(F.count("*").alias("n"))
            counts = sorted((r["s"], r["v"], r["n"]) for r in counts.collect())  # about FEW rows a slice
            for low, _, below in open_:
                mine = [(v, m) for s, v, m in counts if s == _slice_number(low, edges)]
                _pick(found, wanted, mine, below)
        bounds = sorted({*edges, *(q for r in cuts if r["s"] not in few for q in r["q"])})
        if not (wanted := [r for r in wanted if r not in found]):
            break
        part = slice_of(F.col("v"), bounds)
        counted = near.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        starts = {_slice_number(low, bounds): below for low, _, below in open_}
        open_, total = [], 0
        for r in sorted(counted.collect(), key=lambda r: r["p"]):
            total = max(total, *(b for p, b in starts.items() if p <= r["p"]), 0)
            hit = [k for k in wanted if total < k <= total + r["n"]]
            if hit and r["lo"] == r["hi"]:
                found |= dict.fromkeys(hit, r["lo"])
            elif hit:
                low = bounds[r["p"] - 1] if r["p"] else -inf
                high = bounds[r["p"]] if r["p"] < len(bounds) else inf
                open_.append((low, high, total))
            total += r["n"]
        slices = MORE_SLICES
    return [found[r] for r in ranks]


def _slice_number(value: float, bounds: Sequence[float]) -> int:
    return sum(b <= value for b in bounds)


def _pick(found: dict[int, float], wanted: Sequence[int], counts: Sequence[tuple[float, int]], below: int) -> None:
    for value, n in counts:
        found |= {r: value for r in wanted if below < r <= below + n}
        below += n


class ExactQuantileBuckets(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Buckets cut at exact quantiles: bucket k begins with the value at rank ceil(k n / buckets).

    Equal cuts are one, so ties make fewer buckets; NaN gets a bucket after all others, null stays null.
    """

    buckets = Param(Params._dummy(), "buckets", "number of buckets", TypeConverters.toInt)

    def __init__(self, column: str | None = None, out: str = "bucket", buckets: int = 10):
        super().__init__()
        self._set(outputCol=out, buckets=buckets)
        if column is not None:
            self._set(inputCol=column)

    def _fit(self, dataset: DataFrame) -> Bucketizer:
        buckets = self.getOrDefault(self.buckets)
        cuts = order_statistics(dataset, self.getInputCol(), [k / buckets for k in range(1, buckets)])
        edges = [-inf, *sorted({c for c in cuts if abs(c) != inf}), inf]
        edges = edges if len(edges) > 2 else [-inf, 0.0, inf]  # without any value all is missing
        return Bucketizer(splits=edges, inputCol=self.getInputCol(), outputCol=self.getOutputCol(), handleInvalid="keep")
