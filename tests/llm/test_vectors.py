"""Whitening and hard negatives against numpy and whole numbers, on tables with every kind of trouble."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from limelight.llm import hard_negatives, queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, component int, n string, anchor string, row double, x int"


def embeddings(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, c, 1, "n", "a", 0.5, 7) for i, v, c in rows], schema)


def random_rows(seed, many, size=8, labels=3, grid=64):
    rng = np.random.default_rng(seed)
    return [
        (i, (rng.integers(-grid, grid, size) / 256).tolist(), int(rng.integers(0, labels))) for i in range(many)
    ]


TROUBLE = [
    (1, None, 1),
    (2, [0.5, None] + [0.1] * 6, 1),
    (3, [math.nan] + [0.1] * 7, 1),
    (4, [math.inf] + [0.1] * 7, 1),
    (5, [], 1),
    (6, [0.25], 1),
    (7, [1e30] * 8, 1),
    (None, [0.125] * 8, 1),
    (100, [0.125] * 8, 1),
    (100, [0.125] * 8, 1),
    (200, [0.125] * 8, None),
]

# Whitening -----------------------------------------------------------------------------------


def rotation(seed, d):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]


@pytest.mark.parametrize("gap", [1e-3, 1e-7, 1e-10, 0.0])
def test_clustered_eigenvalues(gap):
    d = 40
    eigenvalues = np.r_[1 + gap * np.arange(12), np.linspace(2, 9, d - 12)]
    q = rotation(1, d)
    a = (q * eigenvalues) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined_eigen(a)
    wide = lambda m: m.astype(np.longdouble)
    assert np.abs(wide(a) @ wide(x) - wide(x) * wide(found)).max() < 1e-15 * 9
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-13
    assert (np.diff(found) <= 0).all()


def test_refinement_beats_its_float32_start():
    a = np.cov(np.random.default_rng(2).normal(size=(64, 500)))
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    _, x = whitening.refined_eigen(a)
    residual = lambda v: np.abs(a @ v - v * np.diag(v.T @ a @ v)).max()
    assert residual(x) < 1e-14 < 1e-8 < residual(start)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.sampled_from([3, 1 << 20, 1 << 30, 1 << 44]), st.integers(0, 9))
def test_products_are_exact(rows, size, most, seed):
    z = np.random.default_rng(seed).integers(-most, most, (rows, size))
    wide = z.astype(object)
    assert (whitening.exact_products(z) == wide.T @ wide).all()


def check_whitened(found, rows, components):
    kept = [(i, v) for i, v, _ in rows]
    x = np.floor(64 * np.array([v for _, v in kept])).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    y = x - total / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    by = {}
    for r in found:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    assert len(by) == min(components, x.shape[1]) and len(found) == n * len(by)
    for c, of in by.items():
        expected = y @ u[:, c - 1] / math.sqrt(e[c - 1])
        got = np.array([of[i]["whitened"] for i, _ in kept])
        assert np.abs(got * np.sign(got @ expected) - expected).max() < 1e-9
        assert of[kept[0][0]]["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
        for k, (i, _) in enumerate(kept):
            assert of[i]["n"] == n and of[i]["identity_error"] < 1e-9
            assert of[i]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], total))


@pytest.mark.parametrize("components", [3, 32])
def test_whitened_rows(spark, components):
    rows = random_rows(3, 200)
    check_whitened(whitening.whiten(embeddings(spark, rows), components=components).collect(), rows, components)


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    check_whitened(queries.op11_whitening(spark, "/root/testdata/sf0.01").collect(), rows, 32)


def test_whitening_leaves_out_what_has_no_vector(spark):
    rows = random_rows(4, 30)
    found = whitening.whiten(embeddings(spark, [(i + 1000, v, c) for i, v, c in rows] + TROUBLE)).collect()
    ids = [r["vec_id"] for r in found if r["component"] == 1]
    assert sorted(ids, key=lambda i: i or 0) == [None, 100, 100, 200, *range(1000, 1030)]
    assert {r["n"] for r in found} == {34}


def test_whitening_without_variance(spark):
    assert whitening.whiten(embeddings(spark, [])).collect() == []
    assert whitening.whiten(embeddings(spark, TROUBLE[:5])).collect() == []
    one = whitening.whiten(embeddings(spark, [(1, [0.5, 0.25], 0)])).collect()
    assert [(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in one] == [(None, None, 0, None)] * 2
    flat = whitening.whiten(embeddings(spark, [(i, [i / 64, 0.5], 0) for i in range(4)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    assert max(r["identity_error"] for r in flat) < 1e-12


def test_deviation_beyond_a_long_is_null(spark):
    far = [(i, [float(2**38 * (i % 2)), 1.0], 0) for i in range(4)]
    found = whitening.whiten(embeddings(spark, far)).collect()
    assert {r["deviation"] for r in found} == {None} and max(r["identity_error"] for r in found) < 1e-9


# Hard negatives ------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 200), st.sampled_from([2, 100, 1 << 14, 1 << 22]), st.integers(0, 99))
def test_scores_are_exact(size, most, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-most, most + 1, (5, size)), rng.integers(-most, most + 1, (7, size))
    a[0], b[0] = most, -most  # the extremes
    longest = max(int((m.astype(object) ** 2).sum(axis=1).max()) for m in (a, b))
    primes = hard_negatives.primes_for(longest)
    got = hard_negatives.exact_scores(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
    assert (got == (a.astype(object) @ b.T.astype(object))).all()


def mined(rows, every, keep=5):
    """By the definition, over rows as (id, whole vector, label)."""
    found = []
    rank = lambda r: (r[0] is None, r[0] or 0)
    for k, (i, x, c) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), rank(r), r[0], r[2], m) for m, r in enumerate(rows) for y in [r[1]]]
        scored.sort()
        for s, _, p, _, _ in [t for t in scored if t[3] == c and t[4] != k][:keep]:
            inside = [t for t in scored if t[3] != c and 80 * -s <= 100 * -t[0] <= 100 * -s][:keep]
            found += [(i, p, at + 1, t[2], -s, -t[0]) for at, t in enumerate(inside)]
    return sorted(found, key=str)


def whole(rows):
    return [(i, [math.floor(256 * e) for e in v], c) for i, v, c in rows]


@pytest.mark.parametrize("grid, block", [(64, 4096), (2, 4096), (64, 3)])
def test_mined_rows(spark, monkeypatch, grid, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", block)
    rows = random_rows(5, 90, size=6, grid=grid)  # a coarse grid is full of ties
    found = hard_negatives.mine(embeddings(spark, rows).repartition(5), every=10)
    assert sorted(map(tuple, found.collect()), key=str) == mined(whole(rows), 10)


def test_whole_table_of_negatives(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    label = lambda r: (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
    rows = whole([(r["vec_id"], r["embedding"], label(r)) for r in table.collect()])
    found = queries.op13_hard_negatives(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, found), key=str) == mined(rows, 100)


def test_a_third_of_all_rows_alike(spark):
    same = [(i, [0.25, 0.5, 0.125], i % 2) for i in range(0, 300, 3)]
    rows = same + [(i, v, c) for i, v, c in random_rows(6, 300, size=3) if i % 3]
    found = hard_negatives.mine(embeddings(spark, rows), every=30)
    assert sorted(map(tuple, found.collect()), key=str) == mined(whole(rows), 30)


def test_negatives_with_trouble(spark):
    rows = random_rows(7, 40)
    usable = whole(rows) + whole([r for r in TROUBLE if r[0] in (None, 100) and r[2] is not None])
    found = hard_negatives.mine(embeddings(spark, rows + TROUBLE), every=10)
    assert sorted(map(tuple, found.collect()), key=str) == mined(usable, 10)
    assert hard_negatives.mine(embeddings(spark, [])).collect() == []
    assert hard_negatives.mine(embeddings(spark, TROUBLE[:5])).collect() == []
    assert hard_negatives.mine(embeddings(spark, [(1, [0.5], 1)])).collect() == []
    assert hard_negatives.mine(embeddings(spark, [(100, [0.5], 1)])).collect() == []
