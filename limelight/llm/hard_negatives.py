"""Hard negatives by exact scores: matrix products of residues in float32, put together by Chinese remaindering.

Scores are inner products of whole vectors. Each is computed modulo several primes below 1024: residues of at most
512 in size, in chunks of 64 dimensions, keep every float32 product exact (64 * 512^2 = 2^24), so the fast
float32 matrix product does all the work. Mixed-radix digits then give the signed score itself. How many primes are
needed follows from the longest vector (Cauchy-Schwarz).

Anchors are taken in blocks of bounded size, each broadcast to all rows. A task keeps a few best rows for every
anchor of the block; Spark merges these lists. A first pass finds each anchor's positives, a second one the rows
of other labels within the window that each positive opens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limelight.llm.common import ddl, record_batch, values
from limelight.llm.vectors import usable
from limelight.plans.ordered import running_number
from limelight.sources.scratch import materialise, scratch_path

SCALE = 256
CHUNK = 64  # dimensions a float32 product may sum up exactly for residues of primes below 1024
PRIMES = [p for p in range(1023, 900, -1) if all(p % q for q in range(2, 32))][:6]
WIDEST = float(1 << 28)
SQUARED_LENGTH = 1 << 55  # 100 times a score still fits into a long
BLOCK_BYTES = 4 << 20
BLOCK_ANCHORS = 4096
SCORES_AT_ONCE = 1 << 21
NONE = np.iinfo(np.int64).min

ROWS = pa.schema(
    [("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("size", pa.int32()),
     ("length", pa.int64()), ("x", pa.binary())]
)
BEST = pa.schema(
    [("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())]
)


# Exact products ----------------------------------------------------------------------------------


def primes_for(longest: int) -> list[int]:
    """Primes whose product is over four times the largest score of vectors with squared length `longest` at most.

    Twice would do to name a signed score; the rest keeps the last digit away from the edge of its range.
    """
    product, taken = 1, 0
    while product <= 4 * longest or not taken:
        product, taken = product * PRIMES[taken], taken + 1
    return PRIMES[:taken]


def _balanced(s: np.ndarray, p: int) -> np.ndarray:
    """Whole float32 numbers of 2^24 at most, modulo p, between -p / 2 and p / 2 (give or take one at the edges)."""
    return s - np.float32(p) * np.rint(s * np.float32(1 / p))


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [np.where((r := x % p) > p // 2, r - p, r).astype(np.float32) for p in primes]


def exact_scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Inner products of all rows behind residues `a` with all behind `b`, as int64."""
    digits: list[np.ndarray] = []  # of the score in the mixed radix of the primes, each balanced around zero
    for left, right, p in zip(a, b, primes):
        value = np.float32(0)
        for at in range(0, left.shape[1], CHUNK):
            value = _balanced(left[:, at : at + CHUNK] @ right[:, at : at + CHUNK].T, p) + value
        if left.shape[1] > CHUNK:
            value = _balanced(value, p)
        for digit, q in zip(digits, primes):
            inverse = pow(q, -1, p)
            value = _balanced((value - digit) * np.float32(inverse - p if inverse > p // 2 else inverse), p)
        digits.append(value)
    score, weight = digits[0].astype(np.int64), 1
    for digit, p in zip(digits[1:], primes):
        weight *= p
        score += digit.astype(np.int64) * weight
    return score


# Best rows of one task ---------------------------------------------------------------------------


class BestRows:
    """The `keep` best rows for each of `slots` lists: higher scores first, then smaller ids, a null id last."""

    def __init__(self, slots: int, keep: int):
        self.keep = keep
        self.score = np.full((slots, keep), NONE)
        self.names = np.zeros((3, slots, keep), dtype=np.int64)  # is the id null, id, row

    def take(self, slots: np.ndarray, scores: np.ndarray, names: np.ndarray) -> None:
        """Merge a matrix of scores (slots x rows; NONE: not a candidate) of rows in the order of their `names`."""
        most = scores.max(axis=1, initial=NONE)
        open_ = (most > NONE) & (most >= self.score[slots, -1])
        slots, scores = slots[open_], scores[open_]
        if not len(slots):
            return
        every = np.arange(len(slots))
        picked = np.empty((len(slots), self.keep), dtype=np.int64)
        found = np.empty((3, len(slots), self.keep), dtype=np.int64)
        for k in range(self.keep):  # argmax names the first of equals, that is the one with the smallest id
            at = scores.argmax(axis=1)
            picked[:, k], found[:, :, k] = scores[every, at], names[:, at]
            scores[every, at] = NONE
        score = np.concatenate([self.score[slots], picked], axis=1)
        name = np.concatenate([self.names[:, slots], found], axis=2)
        order = np.lexsort((name[2], name[1], name[0], -np.maximum(score, NONE + 1)), axis=1)[:, : self.keep]
        self.score[slots] = np.take_along_axis(score, order, axis=1)
        self.names[:, slots] = np.take_along_axis(name, order[None], axis=2)


# Passes over all rows ----------------------------------------------------------------------------


def prepared(embeddings: DataFrame, key: str, vector: str, label: Column, every: int) -> DataFrame:
    """Stored rows that take part: number, id, label, whether an anchor, squared length and whole vector.

    Those have the length (dimension) that most usable vectors have, the longer one of two equally frequent.
    """
    source = embeddings.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("bigint").alias("vec_id"),
        label.cast("bigint").alias("label"),
        F.coalesce(F.col(key).cast("bigint") % every == 0, F.lit(False)).alias("anchor"),
        F.col(vector).alias("vector"),
    ).filter("label IS NOT NULL AND vector IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [np.array(values(batch, c), dtype=object) for c in ("row", "vec_id", "label", "anchor")]
            for rows, x in usable(batch.column(4), SCALE, WIDEST):
                estimate = (x.astype(np.float64) ** 2).sum(axis=1)
                fits = estimate < SQUARED_LENGTH  # well inside of a long, so the exact sum is right where this holds
                x, rows = x[fits], rows[fits]
                packed = [r.tobytes() for r in x.astype("<i4")]
                yield record_batch(
                    ROWS, [*(c[rows] for c in columns), [x.shape[1]] * len(rows), (x * x).sum(axis=1), packed]
                )

    stored = materialise(source.mapInArrow(run, ddl(ROWS)), "whole-vectors")
    most = stored.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    return stored.filter(F.col("size") == most["size"]).drop("size") if most else stored.drop("size")


class Block:
    """Anchors of one broadcast and, in the second pass, the scores of their positives (NONE: no such positive)."""

    def __init__(self, rows: list, primes: list[int], positives: int):
        self.row = np.array([r["row"] for r in rows], dtype=np.int64)
        self.label = np.array([r["label"] for r in rows], dtype=np.int64)
        self.x = np.stack([np.frombuffer(r["x"], dtype="<i4") for r in rows])
        self.primes = primes
        self.score = np.full((len(rows), positives), NONE)

    def __len__(self) -> int:
        return len(self.row)

    def scored(self, found: list) -> None:
        place = {row: at for at, row in enumerate(self.row.tolist())}
        for r in found:
            self.score[place[r["anchor"]], r["slot"]] = r["score"]


Candidates = Callable[[Block, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]


def same_label(block: Block, scores: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> Iterator:
    """Other rows of the anchor's label."""
    fits = (block.label[:, None] == labels) & (block.row[:, None] != rows)
    yield 0, np.where(fits, scores, NONE)


def in_window(low: int, high: int) -> Candidates:
    """Rows of another label with low * positive <= 100 * score <= high * positive, a slot for each positive."""

    def candidates(block: Block, scores: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> Iterator:
        other = block.label[:, None] != labels
        hundredfold = scores * 100
        for slot in range(block.score.shape[1]):
            bound = block.score[:, slot, None]
            known = bound > NONE
            bound = np.where(known, bound, 0)
            yield slot, np.where(other & known & (low * bound <= hundredfold) & (hundredfold <= high * bound), scores, NONE)

    return candidates


def best_rows(rows: DataFrame, block: Block, slots: int, keep: int, candidates: Candidates) -> DataFrame:
    """(anchor, slot, score, vec_id, row): the `keep` best rows for every anchor row of the block and slot."""
    shared = rows.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_BYTES of vectors and BLOCK_ANCHORS rows
    step = max(16, SCORES_AT_ONCE // len(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        left = residues(block.x, block.primes)
        best = BestRows(len(block) * slots, keep)
        every = np.arange(len(block)) * slots
        for batch in batches:
            vec_id = batch.column(1)
            null = vec_id.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            names = np.stack([null, vec_id.fill_null(0).to_numpy(), batch.column(0).to_numpy()])
            labels, xs = batch.column(2).to_numpy(), values(batch, "x")
            order = np.lexsort((names[2], names[1], names[0]))
            for at in range(0, len(order), step):
                part = order[at : at + step]
                x = np.frombuffer(b"".join(xs[i] for i in part), dtype="<i4").reshape(len(part), -1)
                scores = exact_scores(left, residues(x, block.primes), block.primes)
                for slot, masked in candidates(block, scores, labels[part], names[2, part]):
                    best.take(every + slot, masked, names[:, part])
        at, k = np.nonzero(best.score > NONE)
        null, ids, numbers = best.names[:, at, k]
        yield record_batch(
            BEST,
            [block.row[at // slots], at % slots, best.score[at, k], pa.array(ids, mask=null.astype(bool)), numbers],
        )

    found = rows.select("row", "vec_id", "label", "x").mapInArrow(run, ddl(BEST))
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine(
    embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by `every`. Rows with a null label, a null or empty vector, or an entry
    that is null or not finite take no part; nor do vectors of another length than most have, or with entries
    of 2^28 or a squared length of 2^55 and more after scaling, whose scores would leave the range of a long.
    Ties go to the smaller id, a null id comes after all others; of rows with one id each is a row of its own (its
    copy is among its positives), and which of equal ids comes first does not show. An anchor without positives, or a
    positive without negatives in its window, gives no rows; so do empty tables.
    """
    spark = embeddings.sparkSession
    rows = prepared(embeddings, key, vector, F.col("label") if label is None else label, every)
    widest = rows.agg(F.max("length"), F.max(F.length("x"))).first()
    nothing = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if widest[0] is None:
        return spark.createDataFrame([], nothing)
    primes = primes_for(widest[0])
    size = max(1, min(BLOCK_ANCHORS, BLOCK_BYTES // widest[1]))
    numbered = running_number(rows.filter("anchor").select("row", "vec_id", "label", "x"), [], ["row"], "number")
    block_of = F.call_function("div", F.col("number") - 1, F.lit(size))
    anchors = materialise(numbered.withColumn("block", block_of).drop("number"), "anchors", "block")
    out = {name: scratch_path(spark, name) for name in ("positives", "negatives")}
    blocks = anchors.agg(F.max("block")).first()[0]
    if blocks is None:
        return spark.createDataFrame([], nothing)
    for at in range(blocks + 1):
        block = Block(anchors.filter(F.col("block") == at).collect(), primes, positives)
        near = best_rows(rows, block, 1, positives, same_label)
        near = near.select("anchor", (F.col("rank") - 1).alias("slot"), "score", "vec_id")
        part = f"{out['positives']}/block={at}"
        near.write.parquet(part)
        block.scored(spark.read.schema(near.schema).parquet(part).collect())  # `positives` rows for each anchor
        hard = best_rows(rows, block, positives, negatives, in_window(low, high))
        hard.select("anchor", "slot", "rank", "score", "vec_id").write.parquet(f"{out['negatives']}/block={at}")
    near = spark.read.parquet(out["positives"])
    near = near.select("anchor", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    hard = spark.read.parquet(out["negatives"])
    hard = hard.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return hard.join(near, ["anchor", "slot"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
