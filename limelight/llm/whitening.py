"""Whitening of embeddings: distributed exact covariance, eigenvectors in float32 refined in higher precision.

Whole numbers x = floor(64 * c) + 1000000 are summed exactly by Spark, so the covariance has no rounding error
before it is a fraction. Its eigenvectors are found in float32 and corrected by matrix products alone (Ogita and
Aishima): from R = I - X'X and S = X'AX comes E, X becomes X + XE, and the error is squared by each step. Pairs of
eigenvalues closer than the present error cannot be told apart by that formula; such clusters are solved
by themselves, as the small matrix of the cluster shifted by its mean, and refined on.

Only matrices of dimension x dimension and vectors of that length reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.llm.common import ddl, record_batch, values
from limelight.llm.vectors import usable
from limelight.sources.scratch import materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
MOST = float(1 << 45)  # whole numbers beyond it would not leave room for exact sums of products
EXACT = 1 << 52
NARROW = np.longdouble  # the higher precision of the refinement
MAX_STEPS = 40

SUMS = pa.schema([("size", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0))])
PRODUCTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.decimal128(38, 0))])
MOMENTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])
WHITENED = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
     ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
)


# Eigenvectors ----------------------------------------------------------------------------------


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(X'AX, eigenvalues, correction E, distance below which two eigenvalues count as one) of an approximate X."""
    eye = np.eye(len(a), dtype=a.dtype)
    r = eye - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # else E + E' = R, which keeps X orthogonal, is lost for small gaps
    values_ = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values_)
    norm = lambda m: np.sqrt((m * m).sum())
    apart = 2 * (norm(off) + norm(a) * norm(r))
    gap = values_[None, :] - values_[:, None]
    told = np.abs(gap) > apart
    e = np.where(told, (s + values_[None, :] * r) / np.where(told, gap, 1), r / 2)
    return s, values_, e, apart


def clusters(eigenvalues: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of the eigenvalues that hang together by steps of at most `apart`, groups of two and more."""
    order = np.argsort(eigenvalues)
    cuts = np.flatnonzero(np.diff(eigenvalues[order]) > apart) + 1
    return [group for group in np.split(order, cuts) if len(group) > 1]


def refined_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors in columns) of a symmetric matrix, correct to double precision.

    A matrix of zeros, or one without rows, gives its unit vectors. Eigenvectors of equal eigenvalues are any
    orthonormal ones of their space. The sign of each is such that its largest entry is positive.
    """
    d = len(a)
    size = np.abs(a).max() if d else 0
    if not size:
        return np.zeros(d), np.eye(d)
    a = a.astype(NARROW) / NARROW(size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(NARROW)
    last = np.inf
    for _ in range(MAX_STEPS):
        _, eigenvalues, e, apart = _step(a, x)
        x = x + x @ e
        change = float(np.abs(e).max())
        found = clusters(eigenvalues, apart)
        for group in found:
            part = x[:, group]
            middle = eigenvalues[group].mean()
            small = part.T @ (a @ part - middle * part)
            width = np.abs(small).max()
            # Equal up to the last digits of the refinement: any basis of the cluster will do.
            if width > 4 * d * np.finfo(NARROW).eps:
                turn = np.linalg.eigh(((small + small.T) / (2 * width)).astype(np.float64))[1].astype(NARROW)
                x[:, group] = part @ turn
                change = max(change, float(np.abs(np.abs(turn) - np.eye(len(group))[np.abs(turn).argmax(axis=1)]).max()))
        if change < 1e-17 or change >= last and change < 1e-15:
            break
        last = change
    eigenvalues = _step(a, x)[1]
    order = np.argsort(-eigenvalues, kind="stable")
    x, eigenvalues = x[:, order], eigenvalues[order] * NARROW(size)
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(d)])
    return eigenvalues.astype(np.float64), (x * signs).astype(np.float64)


# Sums ------------------------------------------------------------------------------------------


def _decimals(numbers) -> list:
    from decimal import Decimal

    return [Decimal(int(v)) for v in numbers]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, z in usable(batch.column(0), SCALE, MOST):
            size = z.shape[1]
            for at in range(0, len(z), 1 << 16):
                part = z[at : at + (1 << 16)]  # 2^16 numbers below 2^45 fit into a long
                total[size] = total.get(size, 0) + part.sum(axis=0).astype(object)
            count[size] = count.get(size, 0) + len(z)
    for size, sums in total.items():
        yield record_batch(SUMS, [[size] * size, range(size), [count[size]] * size, _decimals(sums)])


def sums(embeddings: DataFrame, vector: str) -> tuple[int, list[int]]:
    """(n, per-dimension sums of floor(64 c)) of the length that most usable vectors have; ties: the longer one."""
    partial = embeddings.select(vector).mapInArrow(_summed, "size int, j int, n bigint, s decimal(38,0)")
    totals = partial.groupBy("size", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    stored = materialise(totals.select("size", "j", "n", F.col("s").cast("decimal(38,0)").alias("s")), "vector-sums")
    most = stored.filter("j = 0 AND n > 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return 0, []
    rows = stored.filter(F.col("size") == most["size"]).orderBy("j").collect()  # one row per dimension
    return most["n"], [int(r["s"]) for r in rows]


def exact_products(z: np.ndarray) -> np.ndarray:
    """z'z of whole numbers without rounding: float64 products of blocks short enough, else Python numbers."""
    most = int(np.abs(z).max(initial=0))
    if most * most >= EXACT:
        wide = z.astype(object)
        return wide.T @ wide
    step = max(1, EXACT // max(1, most * most))
    total = np.zeros((z.shape[1], z.shape[1]), dtype=object if most * most * len(z) >= 1 << 62 else np.int64)
    for at in range(0, len(z), step):
        block = z[at : at + step].astype(np.float64)
        total += (block.T @ block).astype(np.int64)
    return total


def covariance(embeddings: DataFrame, vector: str, n: int, total: list[int]) -> np.ndarray:
    """Covariance (divisor n) of floor(64 c), centred at whole numbers before multiplying, then by exact fractions."""
    d = len(total)
    middle = np.array([round(Fraction(s, n)) for s in total], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(d)
        held, room = np.zeros((d, d), dtype=np.int64), 0

        def rows(matrix):
            picked = matrix[upper]
            for at in range(0, len(picked), 50_000):
                part = slice(at, at + 50_000)
                yield record_batch(PRODUCTS, [upper[0][part], upper[1][part], _decimals(picked[part])])

        for batch in batches:
            for _, z in usable(batch.column(0), SCALE, MOST):
                if z.shape[1] != d or not len(z):
                    continue
                z = z - middle
                products = exact_products(z)
                if products.dtype == object:
                    yield from rows(products)
                    continue
                bound = int(np.abs(z).max()) ** 2 * len(z)
                if room + bound >= 1 << 62:
                    yield from rows(held)
                    held, room = np.zeros((d, d), dtype=np.int64), 0
                held += products
                room += bound
        if room:
            yield from rows(held)

    partial = embeddings.select(vector).mapInArrow(run, "i int, j int, s decimal(38,0)")
    found = partial.groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()  # d (d + 1) / 2 rows
    rest = [s - n * int(m) for s, m in zip(total, middle)]
    exact = {(r["i"], r["j"]): int(r["s"]) for r in found}
    matrix = np.zeros((d, d), dtype=NARROW)
    for i in range(d):
        for j in range(i, d):
            # n^2 cov = n sum(zz') - sum(z) sum(z)', all whole numbers.
            top = n * exact.get((i, j), 0) - rest[i] * rest[j]
            matrix[i, j] = matrix[j, i] = NARROW(str(top)) / NARROW(str(n)) / NARROW(str(n))
    return matrix


class Whitener:
    """What the rows need: n, integer centre and its remainder, eigenvectors, eigenvalues."""

    def __init__(self, n: int, total: list[int], matrix: np.ndarray, components: int):
        self.n, self.size = n, len(total)
        self.middle = np.array([round(Fraction(s, n)) for s in total], dtype=np.int64)
        self.rest = [s - n * int(m) for s, m in zip(total, self.middle)]  # |rest| <= n / 2
        eigenvalues, vectors = refined_eigen(matrix)
        self.components = min(components, self.size)
        self.eigenvalues, self.vectors = eigenvalues[: self.components], vectors[:, : self.components]
        trace = float(np.trace(matrix))
        self.explained = self.eigenvalues / trace if trace > 0 else np.full(self.components, np.nan)
        # Directions without variance cannot be scaled to variance one.
        self.alive = self.eigenvalues > trace * self.size * np.finfo(np.float64).eps
        self.roots = np.sqrt(np.where(self.alive, self.eigenvalues, 1))

    def transform(self, z: np.ndarray) -> np.ndarray:
        shift = np.array(self.rest, dtype=np.float64) / self.n
        return ((z - self.middle).astype(np.float64) - shift) @ self.vectors / self.roots

    def deviations(self, z: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; null where the sum does not fit into a long."""
        z = z - self.middle
        most = self.n * (int(np.abs(z).max(initial=0)) + 1)
        if self.size * most * most < 1 << 63:
            far = z * self.n - np.array(self.rest, dtype=np.int64)
            return (far * far).sum(axis=1).tolist()
        rest = np.array(self.rest, dtype=object)
        sums_ = [int(((row.astype(object) * self.n - rest) ** 2).sum()) for row in z]
        return [s if s < 1 << 63 else None for s in sums_]


def identity_error(embeddings: DataFrame, vector: str, whitener: Whitener) -> float | None:
    """Largest entry of |covariance of the whitened rows - identity|, from the rows themselves; null without variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = whitener.components
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, z in usable(batch.column(0), SCALE, MOST):
                if z.shape[1] == whitener.size and len(z):
                    w = whitener.transform(z)
                    first += w.sum(axis=0)
                    second += w.T @ w
        i, j = np.indices((k, k))
        yield record_batch(MOMENTS, [i.ravel(), j.ravel(), second.ravel()])
        yield record_batch(MOMENTS, [[-1] * k, range(k), first])

    alive = np.flatnonzero(whitener.alive)
    if not len(alive):
        return None
    moments = embeddings.select(vector).mapInArrow(run, "i int, j int, s double")
    found = {(r["i"], r["j"]): r["s"] for r in moments.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    mean = np.array([found[-1, j] for j in alive]) / whitener.n
    second = np.array([[found[i, j] for j in alive] for i in alive]) / whitener.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(len(alive))).max())


def whiten(
    embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    Null vectors, those with a null or non-finite entry and empty ones are dropped; so are vectors of another
    length than most have, and entries of 2^45 / 64 or more, whose products have no exact sum. Repeated rows and null
    ids count and come out as often as they go in. A component without variance (constant or dependent
    dimensions, a single row) has null in `whitened`, and a table without usable rows gives no rows. `deviation` is null
    where it exceeds a long.
    """
    source = embeddings.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"))
    spark = embeddings.sparkSession
    n, total = sums(source, "vector")
    if not n:
        return spark.createDataFrame([], ddl(WHITENED))
    whitener = Whitener(n, total, covariance(source, "vector", n, total), components)
    error = identity_error(source, "vector", whitener)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = whitener.components
        explained = [None if np.isnan(v) else v for v in whitener.explained.tolist()]
        for batch in batches:
            ids = np.array(values(batch, "vec_id"), dtype=object)
            for rows, z in usable(batch.column(1), SCALE, MOST):
                if z.shape[1] != whitener.size:
                    continue
                for at in range(0, len(rows), 2_000):
                    part = slice(at, at + 2_000)
                    many = len(rows[part])
                    white = whitener.transform(z[part])
                    white[:, ~whitener.alive] = np.nan
                    yield record_batch(
                        WHITENED,
                        [np.repeat(ids[rows[part]], k), np.tile(np.arange(1, k + 1), many), np.full(many * k, n),
                         np.repeat(np.array(whitener.deviations(z[part]), dtype=object), k),
                         pa.array(white.ravel(), from_pandas=True), explained * many, [error] * (many * k)],
                    )

    return source.mapInArrow(run, ddl(WHITENED))
