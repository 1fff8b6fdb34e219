"""What the operators share: text as bytes, Arrow columns, tables of proven uniqueness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limelight.sources.scratch import materialise, remove, scratch_path

UPPER = bytes(range(65, 91))
LOWER_TABLE = bytes.maketrans(UPPER, UPPER.lower())
# Everything but 0-9, a-z and bytes of multi-byte characters separates plain words.
PLAIN_TABLE = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spaced_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; none for null."""
    return [] if text is None else text.encode().translate(LOWER_TABLE).split()


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case; none for null."""
    return [] if text is None else text.encode().translate(PLAIN_TABLE).split()


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Batches:
    """Collects rows of one schema and gives them out in Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 20_000):
        self.schema, self.most = schema, most
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *row) -> None:
        for column, value in zip(self.columns, row):
            column.append(value)

    def full(self) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield record_batch(self.schema, self.columns)
            self.columns = [[] for _ in self.schema]


def ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "bigint", "int32": "int", "string": "string", "binary": "binary", "double": "double", "bool": "boolean"}
    kinds |= {"list<item: int32>": "array<int>", "list<item: int64>": "array<bigint>", "list<item: string>": "array<string>"}
    return ", ".join(f"`{f.name}` {kinds[str(f.type)]}" for f in schema)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """`df` written once, and a function that removes the files; nothing may read the table after that."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), lambda: remove(spark, path)


def row_keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(row, doc_id, text, *more) with a `row` that is never null and unique.

    That is doc_id itself where it can serve; if it has nulls or repeats, the rows are written once with numbers
    of their own, because such numbers must not change between two reads.
    """
    source = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more
    )
    clashes = source.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1")
    if clashes.isEmpty():
        return source.select(F.col("doc_id").alias("row"), "*")
    return materialise(source.select(F.monotonically_increasing_id().alias("row"), "*"), "rows")
