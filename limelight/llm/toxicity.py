"""Toxicity classifier with a counterfactual penalty (operator 7).

A logistic model over hashed word features: each distinct word of a text gives itself and its
beginnings of 3 to 6 bytes, so inflected and compounded insults count as well. For a labelled text
with identity terms there is a twin in which they are swapped for another group's; the loss
adds `penalty` times the squared difference of the two logits. A group's mention alone then
hardly moves a score.

The model is fitted on at most `MAX_LABELLED` labelled rows, chosen by a hash of the id; all
rows are scored by their whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.llm.common import ddl, plain_words, record_batch, values

MAX_LABELLED = 5_000
DIMENSIONS = 1 << 18
PREFIXES = (3, 4, 5, 6)
PRIOR, LEAST_EVIDENCE = 10.0, 1.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
MEMO_ENTRIES = 300_000

# Groups of interchangeable identity terms.
IDENTITY_TERMS = (
    ("men", "women"),
    ("man", "woman"),
    ("boys", "girls"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("white", "black", "asian", "latino"),
    ("straight", "gay", "lesbian", "bisexual", "transgender"),
    ("european", "african", "american", "mexican", "chinese", "indian", "arab"),
    ("natives", "immigrants", "refugees"),
    ("young", "old"),
    ("disabled", "deaf", "blind"),
)


def swaps(groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[bytes, bytes]:
    """Each term with the next one of its group; the last with the first."""
    return {a.encode(): b.encode() for g in groups for a, b in zip(g, (*g[1:], g[0]))}


def word_features(word: bytes) -> list[int]:
    parts = {word + b"$", *(word[:k] for k in PREFIXES if len(word) >= k)}
    return [zlib.crc32(p) % DIMENSIONS for p in parts]


def text_features(words: set[bytes]) -> np.ndarray:
    return np.array([f for w in sorted(words) for f in word_features(w)], dtype=np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logit(self, features: np.ndarray) -> float:
        return self.bias + float(self.weights[features].sum())


FEATURES = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.int32())), ("twin", pa.list_(pa.int32()))])
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _features(labelled: DataFrame, swap: dict[bytes, bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [], [], []
            for y, text in zip(values(batch, "y"), values(batch, "text")):
                words = set(plain_words(text))
                twin = {swap.get(w, w) for w in words}
                rows[0].append(y)
                rows[1].append(text_features(words))
                rows[2].append(text_features(twin) if words & swap.keys() else None)
            yield record_batch(FEATURES, rows)

    return labelled.mapInArrow(run, ddl(FEATURES))


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray | None]:
    """Views of the lists of a column; no Python object per number."""
    return [item.values.to_numpy() if item.is_valid else None for chunk in column.chunks for item in chunk]


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    return owner, np.concatenate(rows) if rows else np.zeros(0, np.int32)


def evidence(y: np.ndarray, owner: np.ndarray, features: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log-odds of each feature against the base rate: near 0 for rare or neutral features."""
    base = y.mean()
    ones = np.bincount(features, y[owner], minlength=size)
    zeros = np.bincount(features, minlength=size) - ones
    odds = (ones + PRIOR * base) / (zeros + PRIOR * (1 - base))
    return np.log(odds * (1 - base) / base)


def fit(
    y: np.ndarray, x: list[np.ndarray], twins: list[np.ndarray | None], penalty: float = 5.0, ridge: float = 1e-3,
    steps: int = 150, rate: float = 0.05,
) -> Model:
    """Full-batch Adam on log-loss + penalty * mean squared twin difference + ridge; the same result every time.

    A feature's value is its evidence, so a rare insult needs few examples; features with next to no
    evidence are left out.
    """
    n, model = max(len(y), 1), Model(np.zeros(DIMENSIONS), 0.0)
    if not len(y):
        return model
    if y.min() == y.max():  # one class: its smoothed frequency is all there is to learn
        model.bias = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        return model
    owner, features = _flat(x)
    scale = evidence(y, owner, features, DIMENSIONS)
    scale[np.abs(scale) < LEAST_EVIDENCE] = 0
    used = np.flatnonzero(scale)
    place = np.full(DIMENSIONS, -1)
    place[used] = np.arange(len(used))

    def placed(owner: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = place[features] >= 0
        return owner[keep], place[features[keep]], scale[features[keep]]

    owner, at, value = placed(owner, features)
    paired = np.array([i for i, t in enumerate(twins) if t is not None], dtype=np.int64)
    t_owner, t_at, t_value = placed(*_flat([twins[i] for i in paired]))
    w = np.zeros(len(used) + 1)
    w[:-1], w[-1] = 0.5, np.log(y.sum() / (n - y.sum()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        raw = np.bincount(owner, w[at] * value, minlength=n)
        pull = (1 / (1 + np.exp(-np.clip(raw + w[-1], -30, 30))) - y) / n
        grad = np.empty_like(w)
        grad[-1] = pull.sum()
        grad[:-1] = ridge * w[:-1]
        if len(paired):
            difference = raw[paired] - np.bincount(t_owner, w[t_at] * t_value, minlength=len(paired))
            apart = 2 * penalty * difference / n
            pull[paired] += apart
            grad[:-1] -= np.bincount(t_at, apart[t_owner] * t_value, minlength=len(used))
        grad[:-1] += np.bincount(at, pull[owner] * value, minlength=len(used))
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights[used], model.bias = w[:-1] * scale[used], float(w[-1])
    return model


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED,
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = 5.0,
) -> Model:
    """Model of `label` (0 or 1) from at most `most` labelled rows; null labels and ids teach nothing.

    An id with several label rows counts once, with its largest label, and one with several texts with the smallest. Rows come in order of a hash of their id.
    """
    marks = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
    marks = marks.filter("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = docs.select("doc_id").distinct()
    chosen = marks.join(known, "doc_id", "left_semi").orderBy(order, "doc_id").limit(most)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    picked = texts.join(F.broadcast(chosen), "doc_id")  # at most `most` short rows
    # One text for an id, however many rows it has: no more than `most` are collected.
    picked = picked.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    found = _features(picked.select("y", "text"), swaps(terms)).toArrow()
    x, twins = _arrays(found["x"]), _arrays(found["twin"])
    return fit(found["y"].to_numpy().astype(float), x, twins, penalty)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row from its whole text; a null text scores like an empty one."""
    # A fixed number of weights, whatever the data.
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    class Words(dict):
        def __init__(self, weights):
            super().__init__()
            self.weights = weights

        def __missing__(self, word):
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = total = float(self.weights[word_features(word)].sum())
            return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from math import exp, fsum

        weights, bias = shared.value
        weight = Words(weights).__getitem__
        for batch in batches:
            scores = []
            for text in values(batch, "text"):
                z = bias + fsum(map(weight, set(plain_words(text))))
                scores.append(1 / (1 + exp(-max(-30.0, min(30.0, z)))))
            yield record_batch(SCORES, [values(batch, "doc_id"), scores])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, ddl(SCORES))


def held_out(key="doc_id"):
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; only rows that are not held out teach.

    Null or empty texts get the score of a text without words; repeated rows come out as often as they go in;
    without usable labels every score is 0.5.
    """
    model = train(docs, labels.filter(~held_out()))
    scored = score(docs, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def toxic_rows(keyed: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row) of the rows of `keyed` (row, doc_id, text) that `classify` would call toxic."""
    model = train(keyed, labels.filter(~held_out()))
    scored = score(keyed.select(F.col("row").alias("doc_id"), "text"), model)
    return scored.filter(F.col("score") >= threshold).select(F.col("doc_id").alias("row"))
