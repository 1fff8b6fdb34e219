"""Languages of a document as a mixture: shares by expectation-maximisation, the set of languages by penalised likelihood.

A text is a bag of letter n-grams, each drawn from one of the languages present. The n-gram frequencies of every
language are counted by Spark over all labelled rows; each is mixed with a little of the average of all languages, so that
an n-gram which nobody has seen favours no language. A document starts with its single best
language. Another one is tried where the slope of the likelihood towards it exceeds the penalty (the likelihood
is concave in the shares, so a smaller slope cannot gain as much); expectation-maximisation then finds the
shares, and the language stays if the gain in log-likelihood exceeds the penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.llm.common import ddl, record_batch, values
from limelight.sources.scratch import materialise

BITS = 16  # n-grams are hashed to this many bits
ORDERS = (3,)  # bytes, separators at the ends included
BACKGROUND = 0.02  # share of the average of all languages in each one
PENALTY = 3.0  # times log(n-grams) for a language more; n-grams overlap, so more than the half of a plain BIC
MOST_LANGUAGES = 256  # the model has 2^BITS numbers a language; with more, those with most n-grams are learnt
STEPS, SETTLED = 60, 1e-4
TEXT_SLICE = 1 << 20
HELD_OUT, FOLDS = 2, 4
UNKNOWN = "und"
# ASCII letters and all bytes of other characters stay, the rest separates words.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])
MIXTURE = pa.schema(
    [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())),
     ("shares", pa.list_(pa.float64()))]
)
MIXTURE_DDL = "doc_id bigint, lang_pred string, score double, languages array<string>, shares array<double>"


def held_out(key="doc_id"):
    """Rows that teach nothing; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


# N-grams -----------------------------------------------------------------------------------------


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _hashed(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, hash) of the n-grams of each order that have no separator but at their ends."""
    space = data == 32
    wide = data.astype(np.uint32)
    for order in ORDERS:
        many = len(data) - order + 1
        if many <= 0:
            continue
        code, inner = np.full(many, order, dtype=np.uint32), np.zeros(many, dtype=bool)
        for k in range(order):
            code = (code ^ wide[k : many + k]) * np.uint32(0x01000193)
            if 0 < k < order - 1:
                inner |= space[k : many + k]
        empty = space[:many] & space[order - 1 :] if order == 2 else inner
        at = np.flatnonzero(~empty)
        mixed = code[at] * np.uint32(0x9E3779B1)
        yield at, mixed >> np.uint32(32 - BITS)


def _long_grams(data: bytes) -> np.ndarray:
    """Counts of all hashed n-grams of one text, slice by slice."""
    total, overlap = np.zeros(1 << BITS, dtype=np.int64), max(ORDERS) - 1
    for start in range(0, len(data), TEXT_SLICE):
        piece = np.frombuffer(data[start : start + TEXT_SLICE + overlap], dtype=np.uint8)
        for at, grams in _hashed(piece):
            total += np.bincount(grams[at < TEXT_SLICE], minlength=1 << BITS)
    return total


def bags(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places of texts, text of each entry, gram, count): the bags of a few texts at a time; entries come text by text.

    Texts without n-grams have no entries; every text is in one group.
    """
    held, size = [], 0

    def counted():
        joined = np.frombuffer(b"  ".join([b"", *(t for _, t in held), b""]), dtype=np.uint8)
        lengths = np.array([len(t) + 2 for _, t in held])
        ends = np.cumsum(lengths) + 1  # an n-gram with one separator before it still belongs to its own text
        keys = []
        for at, grams in _hashed(joined):
            keys.append(np.searchsorted(ends, at, side="right").astype(np.int64) << BITS | grams)
        unique, count = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
        return np.array([p for p, _ in held]), unique >> BITS, unique & (1 << BITS) - 1, count

    for place, text in enumerate(texts):
        data = b"" if text is None else text.lower().encode("utf-8", "surrogatepass").translate(LETTERS)
        if len(data) > TEXT_SLICE:
            total = _long_grams(b" " + data + b" ")
            grams = np.flatnonzero(total)
            yield np.array([place]), np.zeros(len(grams), dtype=np.int64), grams, total[grams]
            continue
        held.append((place, data))
        size += len(data) + 2
        if size > TEXT_SLICE:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


# Model -------------------------------------------------------------------------------------------


@dataclass
class Model:
    languages: list[str]
    frequency: np.ndarray  # languages x hashed n-grams, rows sum up to one
    prior: np.ndarray  # share of the labelled n-grams; decides between languages that fit equally well

    def __post_init__(self):
        self.logs = np.log(self.frequency)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows with a language and a text; each task adds up its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def rows():
            for lang, total in totals.items():
                grams = np.flatnonzero(total)
                yield record_batch(COUNTS, [[lang] * len(grams), grams, total[grams]])
            totals.clear()

        for batch in batches:
            langs = values(batch, "lang")
            for places, owner, grams, count in bags(values(batch, "text")):
                names = [langs[p] for p in places]
                for lang in dict.fromkeys(names):
                    mine = np.array([n == lang for n in names])[owner]
                    if lang not in totals and len(totals) >= MOST_LANGUAGES:
                        yield from rows()
                    total = totals.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                    total += np.bincount(grams[mine], count[mine], minlength=1 << BITS).astype(np.int64)
        yield from rows()

    source = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = source.filter("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(run, ddl(COUNTS))
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Model:
    """The model of all labelled rows: a fixed number of counts a language, MOST_LANGUAGES at most."""
    counts = materialise(gram_counts(docs), "language-counts")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    languages = sorted(r["lang"] for r in sizes.collect())
    place = {lang: at for at, lang in enumerate(languages)}
    table = np.zeros((len(languages), 1 << BITS), dtype=np.float64)
    if languages:
        found = counts.join(F.broadcast(sizes.select("lang")), "lang").toArrow()  # 2^BITS rows a language at most
        names = found["lang"].combine_chunks().dictionary_encode()
        codes = np.array([place[v] for v in names.dictionary.to_pylist()])[names.indices.to_numpy()]
        table[codes, found["gram"].to_numpy()] = found["n"].to_numpy()
    return model_of(languages, table)


def model_of(languages: list[str], table: np.ndarray) -> Model:
    sums = table.sum(axis=1, keepdims=True)
    frequency = table / np.maximum(sums, 1)
    average = frequency.mean(axis=0) if len(languages) else np.zeros(1 << BITS)
    average = (average + 1e-3 / (1 << BITS)) / (average.sum() + 1e-3)
    mixed = (1 - BACKGROUND) * frequency + BACKGROUND * average
    return Model(languages, mixed.astype(np.float32), (sums[:, 0] / max(sums.sum(), 1)).astype(np.float64))


# Mixtures ----------------------------------------------------------------------------------------


def mixtures(model: Model, many: int, owner: np.ndarray, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Shares (texts x languages) of `many` texts whose bags follow one another; a text without n-grams has zeros."""
    L = len(model.languages)
    shares = np.zeros((many, L))
    present, start = np.unique(owner, return_index=True)
    if not len(present) or not L:
        return shares
    count = count.astype(np.float64)
    p = model.frequency[:, grams]
    total = np.add.reduceat(count, start)
    penalty = PENALTY * np.log(np.maximum(total, 2))
    place = np.searchsorted(present, owner)
    alone = np.add.reduceat(count * model.logs[:, grams], start, axis=1) + np.log(np.maximum(model.prior, 1e-12))[:, None]
    theta = np.zeros((len(present), L))
    theta[np.arange(len(present)), alone.argmax(axis=0)] = 1
    tried = theta > 0  # languages that are in the set or have been turned down
    inside = theta > 0
    open_ = np.arange(len(present))
    ends = np.append(start[1:], len(owner))
    while len(open_):
        rows = np.concatenate([np.arange(start[d], ends[d]) for d in open_])
        local = np.repeat(np.arange(len(open_)), ends[open_] - start[open_])
        heads = np.append(0, np.cumsum(ends[open_] - start[open_])[:-1])
        q, c = p[:, rows], count[rows]
        old = theta[open_]
        mix = np.einsum("lu,ul->u", q, old[local])
        slope = np.add.reduceat(c * (q / mix), heads, axis=1).T - total[open_, None]
        slope[tried[open_]] = -np.inf
        best = slope.argmax(axis=1)
        worth = slope[np.arange(len(open_)), best] > penalty[open_]
        if not worth.any():
            break
        # Those without a worthwhile language are done.
        keep = worth[local]
        q, c, mix, local = q[:, keep], c[keep], mix[keep], np.cumsum(worth)[local[keep]] - 1
        open_, best, old = open_[worth], best[worth], old[worth]
        heads = np.flatnonzero(np.diff(local, prepend=-1))
        before = np.add.reduceat(c * np.log(mix), heads)
        new = old * 0.9
        new[np.arange(len(open_)), best] = 0.1
        for _ in range(STEPS):
            weighted = q * new[local].T
            mix = weighted.sum(axis=0)
            fresh = np.add.reduceat(weighted * (c / mix), heads, axis=1).T / total[open_, None]
            moved = np.abs(fresh - new).max()
            new = fresh
            if moved < SETTLED:
                break
        mix = np.einsum("lu,ul->u", q, new[local])
        gained = np.add.reduceat(c * np.log(mix), heads) - before > penalty[open_]
        tried[open_, best] = True
        inside[open_[gained], best[gained]] = True
        theta[open_[gained]] = new[gained]
    shares[present] = theta
    return shares


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, languages, shares for every row, from its whole text.

    A null text or one without a letter is `und` with score 0 and no languages; so is every text if nothing was
    learnt. `score` is the share of the predicted language, the largest; ties go to the first in alphabetical order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_LANGUAGES * 2^BITS numbers at most: 64 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t if has_letter(t) else None for t in values(batch, "text")]
            shares = np.zeros((len(texts), len(model.languages)))
            for places, owner, grams, count in bags(texts):
                shares[places] = mixtures(model, len(places), owner, grams, count)
            rows = []
            for text, share in zip(texts, shares):
                found = np.argsort(-share, kind="stable")[: int((share > 0).sum())] if text is not None else []
                names = [model.languages[k] for k in found]
                parts = [min(1.0, float(share[k])) for k in found]
                rows.append((names[0] if names else UNKNOWN, parts[0] if names else 0.0, names, parts))
            columns = list(zip(*rows)) or [[]] * 4
            yield record_batch(MIXTURE, [values(batch, "doc_id"), *columns])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, MIXTURE_DDL)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, shares for every row of `docs`.

    Learnt from text and language of the rows that are not held out; rows without a language or a text teach nothing.
    Repeated rows teach and come out as often as they go in, null ids are not held out; an empty table gives no rows.
    """
    model = train(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "shares")
