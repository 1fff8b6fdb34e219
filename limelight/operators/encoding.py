"""Categories as numbers: the mean target of a category, learnt out of fold and kept as a stored table.

One encoding for any number of categories. A training row gets the mean of the other folds' rows, so its own target
is not in its feature; other rows get the mean of all training rows. Means of rare categories are drawn
towards the overall mean. A missing category is a category of its own, an unknown one gets the overall mean.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limelight.functions.hashing import subset_number
from limelight.plans.skew import lookup_join
from limelight.sources.scratch import materialise, read_text, write_text

FOLDS = 5
SMOOTHING = 20.0  # rows that the overall mean counts as
ALL = -1  # the fold of rows that were not trained on


def encoded_name(column: str) -> str:
    return f"{column}__mean"


def _entry(fold: Column, value: Column) -> Column:
    """What a row looks up: its fold and its category, null told apart from every text."""
    return F.concat(fold.cast("string"), F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), value)))


@dataclass
class TargetEncoding:
    """`means` has a row per column, category and fold: (column, entry, mean, rows); `prior` is the overall mean."""

    means: DataFrame
    columns: list[str]
    prior: float
    fold: Column | None

    def encode(self, df: DataFrame, training: bool = False) -> DataFrame:
        """`df` with a number for each category column; `training` for the very rows that were learnt from."""
        fold = self.fold if training else F.lit(ALL)
        if fold is None:
            raise ValueError("the folds of training rows are known only where the encoding was learnt")
        for column in self.columns:
            out = encoded_name(column)
            own = self.means.filter(F.col("column") == column)
            lookup = own.select("entry", F.col("mean").alias(out))
            weights = lambda own=own: own.select("entry", "rows")
            asking = df.withColumn("entry", _entry(fold, F.col(column).cast("string")))
            found = lookup_join(asking, lookup, "entry", weights, "rows", "left").drop("entry")
            df = found.withColumn(out, F.coalesce(out, F.lit(self.prior)))
        return df

    def save(self, path: str) -> None:
        self.means.write.partitionBy("column").parquet(f"{path}/means")
        write_text(self.means.sparkSession, f"{path}/prior", f"{self.prior!r}\n" + "\n".join(self.columns))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TargetEncoding:
        """A stored encoding, for rows that were not trained on."""
        prior, *columns = read_text(spark, f"{path}/prior").split("\n")
        means = spark.read.schema("entry string, mean double, rows bigint, column string").parquet(f"{path}/means")
        return cls(means, columns, float(prior), None)


def row_fold(df: DataFrame, key: str | None, folds: int, seed: int) -> Column:
    """Fold by key, or by the whole row where there is none: the same on any cluster and any file layout."""
    return subset_number(F.col(key) if key else F.xxhash64(*df.columns), folds, seed, "encode")


def learn_means(
    df: DataFrame, columns: Sequence[str], label: str, key: str | None = None,
    folds: int = FOLDS, smoothing: float = SMOOTHING, seed: int = 1,
) -> TargetEncoding:
    """Rows without a target teach nothing. All columns are counted in one pass, each task adding up first.

    With fewer than two folds every training row sees its own target; with no rows at all every mean is 0.
    """
    fold = row_fold(df, key, folds, seed)
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.select(F.col(label).cast("double").alias("y"), fold.alias("fold"), F.inline(values)).filter("y IS NOT NULL")
    counts = rows.groupBy("column", "value", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    counts = materialise(counts, "category-counts")
    by_fold = counts.filter(F.col("column") == columns[0]).groupBy("fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    totals = {r["fold"]: (r["n"], r["s"]) for r in by_fold.collect()}  # a row per fold
    n, s = (sum(t[i] for t in totals.values()) for i in (0, 1))
    prior = s / n if n else 0.0

    def mean(total: Column, count: Column, overall: Column) -> Column:
        return (total + smoothing * overall) / (count + smoothing)

    same = Window.partitionBy("column", "value")  # a row per fold
    other = counts.withColumns({"all_n": F.sum("n").over(same), "all_s": F.sum("s").over(same)})
    without = {f: (s - t) / (n - m) if n > m else prior for f, (m, t) in totals.items()}
    overall = F.create_map(*[F.lit(x) for pair in without.items() for x in pair])[F.col("fold")] if without else F.lit(prior)
    apart = mean(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n"), overall)
    if folds < 2:
        apart = mean(F.col("all_s"), F.col("all_n"), F.lit(prior))
    trained = other.select("column", _entry(F.col("fold"), F.col("value")).alias("entry"), apart.alias("mean"), F.col("n").alias("rows"))
    whole = counts.groupBy("column", "value").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    scored = whole.select(
        "column", _entry(F.lit(ALL), F.col("value")).alias("entry"), mean(F.col("s"), F.col("n"), F.lit(prior)).alias("mean"), F.col("n").alias("rows")
    )
    means = materialise(trained.unionByName(scored).select("entry", "mean", "rows", "column"), "category-means", "column")
    return TargetEncoding(means, list(columns), prior, fold)
