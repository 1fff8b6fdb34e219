"""Sharding along a Hilbert curve (operator 1), with DataFrame expressions only.

Each metadata dimension is quantised by its own quantiles, so a dimension with a heavy value still uses all
cells; the cells' place on the curve orders the rows, and equal runs of that order are the shards. A
shard then covers a small box of every dimension, so a reader that filters on any of them skips whole files.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limelight.plans.ordered import POSITION_BITS, running_value
from limelight.plans.skew import lookup_join
from limelight.sources.scratch import materialise

BITS = 5
SHARDS = 16
ACCURACY = 10_000


def value_cells(df: DataFrame, name: str, bits: int, out: str) -> DataFrame:
    """`df` with the cell of a text column: values in order, each where the rows before it end.

    Whole values are ranked, so values with a long common beginning fall into different cells. A null has no cell.
    """
    counts = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("__value")).agg(F.count("*").alias("__rows"))
    counts = materialise(counts, "values")
    total = counts.agg(F.sum("__rows")).first()[0] or 1
    upto = running_value(counts, ["__value"], "sum", "__rows", "__upto")
    cell = F.expr(f"CAST((__upto - __rows) * {1 << bits}L DIV {total} AS INT)")
    cells = materialise(upto.select("__value", cell.alias(out)), "value-cells")
    found = lookup_join(df.withColumn("__value", F.col(name)), cells, "__value", lambda: counts, "__rows", "left")
    return found.drop("__value")


def quantised(df: DataFrame, dimensions: list[str], bits: int) -> tuple[DataFrame, dict[str, Column]]:
    """`df` and the cell 0 to 2^bits - 1 of every dimension; nulls are in cell 0.

    Numbers: how many quantiles lie below; texts: `value_cells`, a column of `df`. A dimension without any value has
    no cells and does not count.
    """
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    texts = [name for name in dimensions if df.schema[name].dataType.typeName() in ("string", "binary")]
    numbers = {name: F.col(name).cast("double") for name in dimensions if name not in texts}
    asked = [F.percentile_approx(c, steps, ACCURACY).alias(f"q{i}") for i, c in enumerate(numbers.values())]
    asked += [F.count(name).alias(f"n{i}") for i, name in enumerate(texts)]
    found = df.select(*asked).first()  # 2^bits - 1 numbers a dimension
    cuts = dict(zip([*numbers, *texts], found))
    cells: dict[str, Column] = {}
    for name in dimensions:
        if not cuts[name]:
            continue
        if name in texts:
            df = value_cells(df, name, bits, f"__cell_{name}")
            cells[name] = F.coalesce(f"__cell_{name}", F.lit(0))
        else:
            cells[name] = reduce(add, [F.when(numbers[name] > cut, 1).otherwise(0) for cut in sorted(set(cuts[name]))])
    return df, cells


def hilbert_index(df: DataFrame, cells: dict[str, Column], bits: int, out: str) -> DataFrame:
    """`df` with the place of its cells on the Hilbert curve in column `out`.

    From the highest bit down, each dimension either inverts or swaps the lower bits of the first one; a Gray
    code follows, and the bits interleave. Every step is a projection, so no expression is written out twice.
    """
    if not cells:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    names = [f"__axis{i}" for i in range(len(cells))]
    df = df.withColumns({n: c.cast("bigint") for n, c in zip(names, cells.values())})
    first = F.col(names[0])
    for bit in range(bits - 1, 0, -1):
        lower = F.lit((1 << bit) - 1).cast("bigint")
        for name in names:
            axis = F.col(name)
            is_set = F.shiftright(axis, bit).bitwiseAND(F.lit(1)) == 1
            if name == names[0]:
                df = df.withColumn(name, F.when(is_set, axis.bitwiseXOR(lower)).otherwise(axis))
                continue
            swap = first.bitwiseXOR(axis).bitwiseAND(lower)
            df = df.withColumns(
                {
                    names[0]: F.when(is_set, first.bitwiseXOR(lower)).otherwise(first.bitwiseXOR(swap)),
                    name: F.when(is_set, axis).otherwise(axis.bitwiseXOR(swap)),
                }
            )
    for before, name in zip(names, names[1:]):
        df = df.withColumn(name, F.col(name).bitwiseXOR(F.col(before)))
    last, flip = F.col(names[-1]), F.lit(0).cast("bigint")
    for bit in range(bits - 1, 0, -1):
        is_set = F.shiftright(last, bit).bitwiseAND(F.lit(1)) == 1
        flip = flip.bitwiseXOR(F.when(is_set, F.lit((1 << bit) - 1)).otherwise(F.lit(0)).cast("bigint"))
    df = df.withColumn("__flip", flip)
    place = F.lit(0).cast("bigint")
    for bit in range(bits - 1, -1, -1):
        for name in names:
            value = F.shiftright(F.col(name).bitwiseXOR(F.col("__flip")), bit).bitwiseAND(F.lit(1))
            place = F.shiftleft(place, 1).bitwiseOR(value)
    return df.withColumn(out, place).drop(*names, "__flip")


def numbered(df: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    """`df` with its place from 0 in the given order, and the number of rows.

    Slices of the order are numbered by themselves; what comes before a slice is added from a table of one row per slice.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialise(placed.withColumn("__at", F.monotonically_increasing_id()), "curve")
    stored = stored.withColumn("__slice", F.shiftright("__at", POSITION_BITS))
    counts = stored.groupBy("__slice").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = F.col("__at") - F.shiftleft("__slice", POSITION_BITS)
    # One row per slice, so at most as many as there are partitions.
    joined = stored.join(F.broadcast(before), "__slice").withColumn(out, within + F.col("__before"))
    return joined.drop("__slice", "__at", "__before"), stored.count()


def hilbert_shards(
    df: DataFrame, dimensions: list[str], ties: list[str], shards: int = SHARDS, bits: int = BITS
) -> DataFrame:
    """`df` with curve (place of its cell), shard (0 to shards - 1) and slot (0, 1, ... within its shard).

    Law `rows`: sizes of shards differ by one at most, whatever the distribution. Rows of one cell are ordered by
    `ties`; rows that are equal there may take each other's place. Nulls are allowed in every column
    and come first; an empty table gives an empty table. Columns named curve, shard or slot are replaced.
    """
    df = df.drop("curve", "shard", "slot")
    columns = df.columns
    df, cells = quantised(df, dimensions, bits)
    placed = hilbert_index(df, cells, bits, "curve").select(*columns, "curve")
    rows, n = numbered(placed, ["curve", *ties], "__place")
    shard = F.expr(f"CAST(__place * {shards} DIV {max(n, 1)} AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {n} + {shards - 1}) DIV {shards}")
    return rows.withColumn("shard", shard).withColumn("slot", F.col("__place") - first).drop("__place")


def write_shards(df: DataFrame, path: str) -> None:
    """Shards as folders of files in curve order: statistics of the files then prune every dimension."""
    laid = df.repartition("shard").sortWithinPartitions("shard", "slot")
    laid.write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of `docs`.

    Dimensions are language, source and length. Rows with equal texts are a group: all take the place on the curve of
    the one with the smallest id (a null id is smaller than any) and lie side by side there, so a group is in one
    shard unless a cut between two shards falls into it. A null text has size 1 and checksum 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), text).alias("text_hash"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )
    narrow = materialise(narrow.withColumn("group", F.struct("text_hash", "text_crc32", "size")), "narrow")
    groups = narrow.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "lang", "source")).alias("lead"))
    groups = materialise(groups.filter("n > 1"), "groups")
    led = lookup_join(narrow, groups.select("group", "lead"), "group", lambda: groups, "n", "left")
    place = {c: F.when(F.col("lead").isNull(), F.col(c)).otherwise(F.col("lead")[c]) for c in ("lang", "source")}
    led = materialise(led.withColumns(place).drop("lead", "group"), "led")
    dealt = hilbert_shards(led, ["lang", "source", "size"], ["text_crc32", "text_hash", "doc_id"], shards, bits)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
