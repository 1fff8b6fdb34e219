"""SimHash near-duplicates found with BK-trees (operator 10).

Two fingerprints that differ in at most `radius` bits agree in at least one of radius + 1 blocks of
bits. So each distinct fingerprint goes to one shard per block, named by the block's bits, and every
link lies within a shard. A shard's BK-tree (children keyed by the integer distance to the parent)
is built and searched by the task that got the shard: trees grow with the data, so none is broadcast.
A shard above `SHARD` fingerprints is cut again by the blocks of its remaining bits, which again loses no link.
Out of a shard comes a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limelight.llm.common import ddl, record_batch, spaced_words, values
from limelight.llm.components import components
from limelight.plans.skew import lookup_join
from limelight.sources.scratch import materialise

RADIUS = 3
SHINGLE = 3
SEED = 42
SHARD = 2_000
AT_ONCE = 1 << 15  # hashes whose bits are summed in one step

PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text; 0 if it has no words."""
    import xxhash

    words = spaced_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for start in range(0, len(shingles), AT_ONCE):
        h = np.array([digest(s, SEED) for s in shingles[start : start + AT_ONCE]], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp, *more) of every row of `docs`; `more` are bigint columns."""
    schema = pa.schema([*PRINTS, *((name, pa.int64()) for name in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(t) for t in values(batch, "text")]
            yield record_batch(schema, [values(batch, "doc_id"), prints, *(values(batch, name) for name in more)])

    source = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more
    )
    return source.mapInArrow(run, ddl(schema))


class BKTree:
    """Distinct 64-bit keys; `near` follows only edges within the radius of the distance to a node."""

    def __init__(self, root: int):
        self.keys, self.children = [root], [{}]

    def insert(self, key: int) -> None:
        at = 0
        while True:
            distance = (self.keys[at] ^ key).bit_count()
            child = self.children[at].get(distance)
            if child is None:
                self.children[at][distance] = len(self.keys)
                self.keys.append(key)
                self.children.append({})
                return
            at = child

    def near(self, key: int, radius: int) -> list[int]:
        """Places (in order of insertion) of the keys within `radius`."""
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            distance = (self.keys[at] ^ key).bit_count()
            if distance <= radius:
                found.append(at)
            edges = self.children[at]
            if edges:
                stack += [edges[d] for d in range(distance - radius, distance + radius + 1) if d in edges]
        return found


def spanning_links(keys: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (a key, the first key of its group) that connect whatever keys within `radius` connect."""
    if len(keys) == 1:
        return []
    tree, parent = BKTree(keys[0]), list(range(len(keys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, key in enumerate(keys[1:], 1):
        for j in tree.near(key, radius):
            low, high = sorted((root(i), root(j)))
            parent[high] = low
        tree.insert(key)
    return [(key, keys[root(i)]) for i, key in enumerate(keys) if root(i) != i]


def _blocks(key: Column, rest: Column, bits: int, parts: int) -> Column:
    """Array of (shard, rest): `rest` cut by each of its `parts` blocks in turn, that block taken out of it."""
    width = -(-bits // parts)
    out = []
    for i in range(parts):
        low, size = i * width, min(width, bits - i * width)
        block = F.shiftrightunsigned(rest, low).bitwiseAND(F.lit((1 << size) - 1))
        above = F.shiftrightunsigned(rest, low + size) if low + size < 64 else F.lit(0).cast("bigint")
        kept = F.shiftleft(above, low).bitwiseOR(rest.bitwiseAND(F.lit((1 << low) - 1)))
        out.append(F.struct(F.concat_ws(".", key, F.lit(i), F.hex(block)).alias("shard"), kept.alias("rest")))
    return F.array(*out)


def shards(prints: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """(shard, fp): every pair of distinct fingerprints within `radius` shares a shard."""
    parts, bits = radius + 1, 64
    rows = prints.select("fp", F.lit("").alias("shard"), F.col("fp").alias("rest"))
    done = []
    while True:
        cut = F.explode(_blocks(F.col("shard"), F.col("rest"), bits, parts)).alias("s")
        rows = materialise(rows.select("fp", cut).select("fp", "s.shard", "s.rest"), "shards")
        bits -= -(-bits // parts)
        sizes = rows.groupBy("shard").count()
        large = sizes.filter(F.col("count") > most)
        if bits <= 4 * parts or large.isEmpty():
            return reduce(DataFrame.unionAll, [*done, rows]).select("shard", "fp")
        large = materialise(large, "large")
        marked = lookup_join(rows, large, "shard", lambda: large, "count", "left")
        marked = materialise(marked, "marked")
        done.append(marked.filter("count IS NULL").select("fp", "shard", "rest"))
        rows = marked.filter("count IS NOT NULL").select("fp", "shard", "rest")


def near_links(prints: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect what distances up to `radius` connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys = None, []
        for batch in batches:
            links = []
            for name, key in zip(values(batch, "shard"), values(batch, "fp")):
                if name != shard:
                    links += spanning_links(keys, radius) if len(keys) > 1 else []
                    shard, keys = name, []
                keys.append(key & 0xFFFFFFFFFFFFFFFF)
            yield _signed(links)
        if len(keys) > 1:
            yield _signed(spanning_links(keys, radius))

    dealt = shards(prints, radius, most).repartition("shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(run, ddl(LINKS))


def _signed(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=LINKS)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable), a row per row.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like any other; a null
    doc_id stays null and never names a component unless all ids in it are null (then it is null).
    Repeated rows come out as often as they go in. Copies are one fingerprint before any tree is built.
    """
    joined = _grouped(materialise(fingerprints(docs), "prints"), F.col("doc_id"), radius, most)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return joined.select("doc_id", digits.alias("fingerprint"), F.col("first").alias("component_id"))


def copies(keyed: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """(row) of all rows of `keyed` (row, doc_id, text) but the first of each component.

    Rows come in the order of doc_id, then of row; a null doc_id comes last.
    """
    prints = materialise(fingerprints(keyed, "row"), "prints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    return _grouped(prints, order, radius, most).filter("row <> first.row").select("row")


def _grouped(prints: DataFrame, order: Column, radius: int, most: int) -> DataFrame:
    """`prints` with `first`: the smallest `order` in the component of the fingerprint."""
    classes = materialise(prints.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n")), "classes")
    roots = components(near_links(classes.select("fp"), radius, most))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = materialise(rooted.drop("first").join(lowest, "root").select("fp", "first", "n"), "components")
    return lookup_join(prints, named.select("fp", "first"), "fp", lambda: named, "n", "left")
