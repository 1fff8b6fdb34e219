"""Removal of byte strings that occur twice, by distributed prefix doubling (operator 9).

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere else. Whether a string is
repeated is decided as in the building of a suffix array by prefix doubling: positions get a rank
for the string of some length that starts there, Spark sorts positions by rank, positions with a rank of
their own are out, and the pairs of the others' ranks and of what follows are ranked again, up to `LENGTH` bytes.
To rank every byte would cost many times the input, so the rounds go from coarse to fine:

1. *Runs.* The smallest hash in each window of `SPAN` positions is the window's anchor. Equal strings have the same
   anchor, so strings fall into runs by anchor (about one per SPAN / 2 bytes). A run's rank is that of the
   LENGTH - SPAN + 1 bytes at its anchor; a run with a rank of its own has no repeated string at all.
   The other runs are ranked by the pair of this and all bytes that they cover; if that is shared,
   every string of the run is repeated and the run is done.
2. *Blocks.* Undecided runs, and one run of each other kind with the same first rank, are cut into blocks
   of `BLOCK` positions from the anchor, ranked by the bytes common to all strings of a block, then by all its bytes.
3. *Positions.* Strings of undecided blocks are ranked one by one.

A rank is the 64-bit (where it settles anything, the 128-bit) fingerprint of the bytes: the same for equal
strings, wherever they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.llm.common import ddl, record_batch, row_keyed, stored, values
from limelight.plans.skew import broadcast_if_small, lookup_join
from limelight.sources.scratch import materialise

LENGTH = 400
PASSAGE, WORDS = 200, 50  # bytes of the first round's strings; words of a passage worth telling
BLOCK = 16
PIECE = 1 << 20  # bytes looked at in one step
GRAM = 16  # bytes that the order of anchors depends on
PLACE_BITS = 24

RUNS = pa.schema(
    [("row", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32())]
    + [(name, pa.int64()) for name in ("first", "all1", "all2")]
)
STRETCHES = pa.schema([("row", pa.int64()), ("lo", pa.int32()), ("at", pa.int32()), ("data", pa.binary())])
POSITIONS = pa.schema([("row", pa.int64()), ("lo", pa.int32()), ("all1", pa.int64()), ("all2", pa.int64())])
KEPT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64())]
    + [("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())]
)
# Islands of starting positions, both ends included.
ISLANDS = pa.schema([("row", pa.int64()), ("los", pa.list_(pa.int64())), ("his", pa.list_(pa.int64()))])
DIGESTS = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    + [("kept_sha256", pa.string()), ("n_passage", pa.int64())]
)
# Islands wide enough for the second round's strings, as documents of their own.
PARTS = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("text", pa.binary())])
JOINED = ["row", "doc_id", "text", "los", "his"]


def as_bytes(text: str | bytes | None) -> bytes:
    return text.encode() if isinstance(text, str) else text or b""


class Ranker:
    """Fingerprints of substrings of a buffer, in constant time each after one pass over it."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 59, 1 << 60)) * 8 + 3
        self.powers, self.inverse = self._powers(base, size), self._powers(pow(base, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size + 1, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def read(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.codes[data] * self.powers[: len(data)], out=sums[1:])
        return sums

    def rank(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (sums[stop] - sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(texts: list[bytes], length: int, piece: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """(buffer, parts): each part is (index of text, place in text, place in buffer, bytes).

    Texts shorter than `length` are left out; long ones come in parts that overlap by length - 1 bytes, so
    that every string of `length` bytes lies in exactly one part.
    """
    held, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(len(text) - length + 1, 0), piece):
            part = text[start : start + piece + length - 1]
            parts.append((i, start, size, len(part)))
            held.append(part)
            size += len(part)
            if size >= piece:
                yield b"".join(held), parts
                held, parts, size = [], [], 0
    if parts:
        yield b"".join(held), parts


def find_runs(texts: list[bytes], length: int, rankers: tuple[Ranker, Ranker], piece: int = PIECE) -> list[np.ndarray]:
    """Columns (index of text, lo, hi, at, first, all1, all2) of the runs that the strings of `texts` fall into.

    A run has the strings that start at lo to hi; at is its anchor.
    """
    span = length - length // 4 if length >= 2 * GRAM else max(length - GRAM + 1, 1)
    gram = min(GRAM, length - span + 1)
    found = []
    for buffer, parts in pieces(texts, length, piece):
        data = np.frombuffer(buffer, dtype=np.uint8)
        sums, more = rankers[0].read(data), rankers[1].read(data)
        index, inside, begin, size = (np.array(c, dtype=np.int64) for c in zip(*parts))
        p = np.arange(len(data) - gram + 1)
        order = rankers[0].rank(sums, p, p + gram)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        # The place in the low bits makes the leftmost of equals the anchor.
        least = window_minima(order & ~mask | p.astype(np.uint64), span)
        anchor = (least & mask).astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), size)[: len(data) - length + 1]
        start = np.arange(len(owner))
        whole = start + length <= (begin + size)[owner]
        start, owner, anchor = start[whole], owner[whole], anchor[start[whole]]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]
        lo, owner, at = start[new], owner[new], anchor[new]
        hi = np.r_[start[np.flatnonzero(new)[1:] - 1], start[-1:]]
        shift = (inside - begin)[owner]
        first = rankers[0].rank(sums, at, at + length - span + 1)
        all1, all2 = (r.rank(s, lo, hi + length) for r, s in zip(rankers, (sums, more)))
        # The extent is part of what a run covers.
        all1 = all1 ^ ((at - lo) * 0x10001 + (hi - at)).astype(np.uint64)
        found.append([index[owner], lo + shift, hi + shift, at + shift, first, all1, all2])
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 7


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def _rankers(length: int) -> tuple[Ranker, Ranker]:
    return Ranker(11, 2 * PIECE + 2 * length), Ranker(12, 2 * PIECE + 2 * length)


def _scan(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rankers = _rankers(length)
        for batch in batches:
            texts = [as_bytes(t) for t in values(batch, "text")]
            rows = np.array(values(batch, "row"), dtype=np.int64)
            index, *rest = find_runs(texts, length, rankers)
            yield record_batch(RUNS, [rows[index], *map(_signed, rest)])

    return docs.select("row", "text").mapInArrow(run, ddl(RUNS))


def settle(table: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """One round over (row, lo, hi, at, first, all1, all2): (decided, open).

    Rows whose `first` rank is their own are dropped. Of the others, those that share all their bytes are decided:
    each of their strings is repeated. Open are the rest, and one of each decided kind with the same first
    rank as one of the rest, because their strings may be equal to some of it.
    """
    seen = table.groupBy("first").agg(F.count("*").alias("n")).filter("n > 1")
    seen = materialise(seen, f"{label}-ranks")
    shared = lookup_join(table, seen, "first", lambda: seen, "n", "inner").drop("n")
    shared = materialise(shared, f"{label}-shared")
    whole = ["first", "all1", "all2"]
    kinds = shared.groupBy(*whole).agg(
        F.count("*").alias("n"), F.min(F.struct("row", "lo", "hi", "at")).alias("one")
    )
    kinds = materialise(kinds, f"{label}-kinds")
    decided = shared.join(kinds.filter("n > 1").select(*whole), whole, "left_semi")
    alone = kinds.filter("n = 1")
    unsettled = alone.select("first").distinct()
    open_ = alone.unionAll(kinds.filter("n > 1").join(unsettled, "first", "left_semi").select(*alone.columns))
    return decided.select("row", "lo", "hi"), open_.select("one.*")


def _cut_out(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """The bytes of the open runs. A document has at most as many runs as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[], [], [], []]
            for row, text, found in zip(values(batch, "row"), values(batch, "text"), values(batch, "runs")):
                data = as_bytes(text)
                for r in found:
                    for column, value in zip(columns, (row, r["lo"], r["at"], data[r["lo"] : r["hi"] + length])):
                        column.append(value)
                if len(columns[0]) > 20_000:
                    yield record_batch(STRETCHES, columns)
                    columns = [[], [], [], []]
            yield record_batch(STRETCHES, columns)

    grouped = runs.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "at")).alias("runs"))
    # Texts move only if too many documents have open runs.
    grouped, _ = broadcast_if_small(materialise(grouped, "open-runs"))
    return docs.join(grouped, "row").select("row", "text", "runs").mapInArrow(run, ddl(STRETCHES))


def _stretch_map(
    stretches: DataFrame, schema: pa.Schema, length: int, work: Callable[..., list[np.ndarray]]
) -> DataFrame:
    """`work` on the joined bytes of many stretches at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rankers = _rankers(length)
        for batch in batches:
            table = batch.to_pydict()
            n, start = len(table["row"]), 0
            while start < n:
                stop, size = start, 0
                while stop < n and (size < PIECE or stop == start):
                    size += len(table["data"][stop])
                    stop += 1
                part = {name: column[start:stop] for name, column in table.items()}
                data = np.frombuffer(b"".join(part["data"]), dtype=np.uint8)
                sums = [r.read(data) for r in rankers]
                begin = np.cumsum([0, *map(len, part["data"])])[:-1]
                yield record_batch(schema, [_signed(c) for c in work(rankers, sums, part, begin)])
                start = stop

    return stretches.mapInArrow(run, ddl(schema))


def _blocks(stretches: DataFrame, length: int) -> DataFrame:
    """Blocks of the runs, counted from the anchor, ranked by what all their strings have in common, then by all bytes.

    A block at the end of a run, which has fewer positions than BLOCK, is ranked by the bytes it has.
    """

    def work(rankers, sums, part, begin):
        lo, at = (np.array(part[c], dtype=np.int64) for c in ("lo", "at"))
        hi = lo + np.array([len(d) for d in part["data"]]) - length
        least, most = (at - hi) // BLOCK, (at - lo) // BLOCK  # numbers of blocks, to the left of the anchor
        i = np.repeat(np.arange(len(lo)), most - least + 1)
        number = np.concatenate([np.arange(a, b + 1) for a, b in zip(least, most)])
        right, left = at[i] - number * BLOCK, at[i] - number * BLOCK - BLOCK + 1  # full extent of the block
        b_lo, b_hi = np.maximum(left, lo[i]), np.minimum(right, hi[i])
        place = (begin - lo)[i]
        common = rankers[0].rank(sums[0], place + right, place + left + length) ^ number.astype(np.uint64)
        all1, all2 = (r.rank(s, place + b_lo, place + b_hi + length) for r, s in zip(rankers, sums))
        all1 = all1 ^ ((right - b_lo) * 0x10001 + (right - b_hi)).astype(np.uint64)
        rows = np.array(part["row"], dtype=np.int64)
        return [rows[i], b_lo, b_hi, at[i], common, all1, all2]

    return _stretch_map(stretches, RUNS, length, work)


def _positions(stretches: DataFrame, length: int) -> DataFrame:
    def work(rankers, sums, part, begin):
        lo = np.array(part["lo"], dtype=np.int64)
        count = np.array([len(d) for d in part["data"]]) - length + 1
        i = np.repeat(np.arange(len(lo)), count)
        step = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        p = begin[i] + step
        all1, all2 = (r.rank(s, p, p + length) for r, s in zip(rankers, sums))
        return [np.array(part["row"], dtype=np.int64)[i], lo[i] + step, all1, all2]

    return _stretch_map(stretches, POSITIONS, length, work)


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, los, his), stored: strings of `length` bytes that start at lo to hi in the text of `row` start elsewhere, too.

    `docs` has row (unique) and text (or bytes). A row per document with such strings; its islands lie in order and
    do not touch. Tables are removed as soon as nothing is to be read from them any more.
    """
    runs, drop_runs = stored(_scan(docs, length), "runs")
    decided, open_runs = settle(runs, "runs")
    drop_runs()
    # One position of an open run is one row here; a decided run that stands for its kind is looked at once more.
    stretches, drop_stretches = stored(_cut_out(docs, open_runs, length), "stretches")
    blocks, drop_blocks = stored(_blocks(stretches, length), "blocks")
    more, open_blocks = settle(blocks, "blocks")
    drop_blocks()
    pairs = open_blocks.select("row", "at", F.struct("lo", "hi").alias("block"))
    pairs = pairs.groupBy("row", "at").agg(F.collect_list("block").alias("blocks"))
    narrowed = stretches.join(pairs, ["row", "at"]).select(
        "row", "at", F.col("lo").alias("begin"), "data", F.explode("blocks").alias("block")
    )
    wanted = narrowed.filter("block.lo >= begin AND block.hi + {0} <= begin + length(data)".format(length))
    cut = F.substring("data", F.col("block.lo") - F.col("begin") + 1, F.col("block.hi") - F.col("block.lo") + length)
    strings = wanted.select("row", F.col("block.lo").alias("lo"), "at", cut.alias("data"))
    positions, drop_positions = stored(_positions(strings, length), "positions")
    drop_stretches()
    twice = positions.groupBy("all1", "all2").agg(F.count("*").alias("n")).filter("n > 1")
    twice = materialise(twice.withColumn("rank", F.struct("all1", "all2")).select("rank", "n"), "twice")
    ranked = positions.select("row", "lo", F.struct("all1", "all2").alias("rank"))
    single = lookup_join(ranked, twice, "rank", lambda: twice, "n", "inner").select("row", "lo", F.col("lo").alias("hi"))
    islands, _ = stored(_islands(decided.unionAll(more).unionAll(single)), "islands")
    drop_positions()
    return islands


def _islands(found: DataFrame) -> DataFrame:
    """Ranges (row, lo, hi) as islands by row. What is gathered for a row is bounded by the length of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(1)
            flat, offsets = packed.values.to_numpy(), packed.offsets.to_numpy()
            los, his = [], []
            for a, b in zip(offsets, offsets[1:]):
                ranges = np.sort(flat[a:b])
                lo, hi = ranges >> 32, np.maximum.accumulate(ranges & 0xFFFFFFFF)
                new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1] + 1])
                los.append(lo[new])
                his.append(hi[np.r_[new[1:] - 1, len(hi) - 1]])
            yield record_batch(ISLANDS, [values(batch, "row"), los, his])

    packed = F.collect_list(F.expr("shiftleft(CAST(lo AS BIGINT), 32) | hi"))
    return found.groupBy("row").agg(packed.alias("packed")).mapInArrow(run, ddl(ISLANDS))


def byte_ranges(los: list[int] | None, his: list[int] | None, length: int) -> tuple[list[int], list[int]]:
    """Maximal byte ranges (starts, ends) covered by the strings of `length` bytes that start in the islands."""
    starts: list[int] = []
    ends: list[int] = []
    for lo, hi in zip(los or [], his or []):
        if ends and lo <= ends[-1]:
            ends[-1] = hi + length
        else:
            starts.append(lo)
            ends.append(hi + length)
    return starts, ends


def without(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)]))


def _joined(docs: DataFrame, islands: DataFrame) -> DataFrame:
    """Documents with their islands; texts move only if too many documents have some."""
    sided, _ = broadcast_if_small(islands)
    return docs.join(sided, "row", "left").select(*JOINED)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, starts, ends (removed byte ranges), kept (remaining bytes); a row per row.

    A null text counts as empty; a text shorter than `length` keeps all; a null or repeated doc_id is no problem,
    and the texts of repeated rows repeat each other. Strings never cross documents. Strings are
    judged on the input, so every occurrence of a repeated string goes.
    """
    docs = row_keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in KEPT]
            for key, text, los, his in zip(*(values(batch, c) for c in JOINED[1:])):
                data = as_bytes(text)
                starts, ends = byte_ranges(los, his, length)
                keep = without(data, starts, ends)
                for column, value in zip(columns, (key, len(data), len(data) - len(keep), starts, ends, keep)):
                    column.append(value)
            yield record_batch(KEPT, columns)

    return _joined(docs, repeated_strings(docs, length)).mapInArrow(run, ddl(KEPT))


def passages(data: bytes, starts: list[int], ends: list[int], words: int) -> tuple[list[int], list[int]]:
    """The ranges with at least `words` words (white space between them) or, whatever their words, LENGTH bytes."""
    kept = [(a, b) for a, b in zip(starts, ends) if b - a >= LENGTH or len(data[a:b].split()) >= words]
    return [a for a, _ in kept], [b for _, b in kept]


def removal_digests(docs: DataFrame, length: int = LENGTH, short: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 as by `remove_repeats`, and n_passage; a row per row.

    Two rounds: strings of `short` bytes first; a string of `length` bytes can only be repeated where all
    the shorter ones in it are, so the second round ranks no more than those stretches. `n_passage` counts the
    bytes in runs of repeated `short` strings that have `words` words or LENGTH bytes: passages that are mostly
    too short for the removal by `length`. It removes nothing.
    """
    docs = row_keyed(docs)
    islands = repeated_strings(docs, short)
    digest = lambda data: hashlib.sha256(data).hexdigest()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in PARTS]
            for row, _, text, los, his in zip(*(values(batch, c) for c in JOINED)):
                data = as_bytes(text)
                for lo, hi in zip(los, his):
                    if hi + short - lo >= length:
                        for column, value in zip(columns, (row, lo, data[lo : hi + short])):
                            column.append(value)
            yield record_batch(PARTS, columns)

    wide = islands.filter(F.exists(F.arrays_zip("los", "his"), lambda at: at["his"] - at["los"] >= length - short))
    sided, _ = broadcast_if_small(islands, wide)
    parts = docs.join(sided, "row").select(*JOINED).mapInArrow(cut, ddl(PARTS))
    parts = materialise(parts.select(F.monotonically_increasing_id().alias("row"), F.col("row").alias("of"), "start", "text"), "wide-islands")
    again = repeated_strings(parts.select("row", "text"), length)
    shifted = lambda name: F.transform(name, lambda at: at + F.col("start"))
    moved = again.join(parts.select("row", "of", "start"), "row")
    moved = moved.select("of", F.explode(F.arrays_zip(shifted("los").alias("lo"), shifted("his").alias("hi"))).alias("at"))
    long = moved.groupBy(F.col("of").alias("row")).agg(F.sort_array(F.collect_list("at")).alias("long"))
    both, _ = broadcast_if_small(materialise(islands.join(long, "row", "left"), "both-rounds"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in DIGESTS]
            for key, text, los, his, long in zip(*(values(batch, c) for c in ("doc_id", "text", "los", "his", "long"))):
                data = as_bytes(text)
                told = passages(data, *byte_ranges(los, his, short), words)
                starts, ends = byte_ranges([at["lo"] for at in long or []], [at["hi"] for at in long or []], length)
                keep = without(data, starts, ends)
                result = (key, len(data), len(data) - len(keep), len(starts), digest(keep), sum(told[1]) - sum(told[0]))
                for column, value in zip(columns, result):
                    column.append(value)
            yield record_batch(DIGESTS, columns)

    return docs.join(both, "row", "left").select("doc_id", "text", "los", "his", "long").mapInArrow(finish, ddl(DIGESTS))


def whole_characters(data: bytes, starts: list[int], ends: list[int]) -> str:
    """What is left of UTF-8 `data`; a character goes only if all its bytes are removed."""
    inner = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    kept, at = [], 0
    for start, end in zip(starts, ends):
        while inner(start):
            start += 1
        while inner(end):
            end -= 1
        if start < end:
            kept.append(data[at:start])
            at = end
    kept.append(data[at:])
    return b"".join(kept).decode()


def trimmed(docs: DataFrame, *more: str, length: int = LENGTH, words: int = 0) -> DataFrame:
    """(doc_id, text, *more) with repeated strings cut out of the texts; a null text becomes empty.

    With `words`, only runs of repeated strings that have so many words, or LENGTH bytes, are cut.
    """
    keyed = row_keyed(docs, *more)
    sided, _ = broadcast_if_small(repeated_strings(keyed, length))
    joined = keyed.join(sided, "row", "left").select("doc_id", *more, "text", "los", "his")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, los, his in zip(*(values(batch, c) for c in ("text", "los", "his"))):
                data = as_bytes(text)
                starts, ends = byte_ranges(los, his, length)
                if words:
                    starts, ends = passages(data, starts, ends, words)
                texts.append(whole_characters(data, starts, ends))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", *more)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=["doc_id", *more, "text"])

    schema = joined.select("doc_id", *more, "text").schema
    return joined.mapInArrow(run, schema).select("doc_id", "text", *more)
