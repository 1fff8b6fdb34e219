"""Byte-level BPE encoding and decoding (operator 4).

Merges come out of a queue that is a hierarchical bitmap over merge ranks: every rank has a
bucket of linked-list positions, a set bit says that the bucket is not empty, and find-first-set on
two words gives the next rank. Entries are never removed; one whose pair has changed
meanwhile is stale and skipped when it comes up. A pre-token of n bytes takes O(n log n) steps at worst
(the log is for ties within a bucket), so a megabyte without a space is no problem.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.llm.common import ddl, record_batch, values

WORD = 8  # a bitmap word has 2 ** WORD bits
MEMO_ENTRIES = 400_000
MEMO_LENGTH = 48  # characters; longer pre-tokens are encoded each time


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes pre-tokens by their merge ranks.

    The queue has two levels of bitmaps: a bit of `words` for each rank with a bucket, a bit of the top word for each
    word that is not zero. The lowest bit of a number n is that of n & -n.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = [0] * ((max(ranks.values()) >> WORD) + 1)
        self.bits = [1 << i for i in range(max(1 << WORD, len(self.words)))]

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token. Of equal ranks the leftmost is merged first, so buckets are heaps."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n, words, bits, low = len(piece), self.words, self.bits, (1 << WORD) - 1
        after = list(range(1, n + 1))  # start of the next symbol
        before = list(range(-1, n - 1))
        pair = [-1] * n  # rank of the merge of the symbol at i with the next one
        buckets: dict[int, list[int]] = {}
        top = 0
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is None:
                continue
            pair[i] = rank
            if rank in buckets:
                buckets[rank].append(i)  # ascending, hence a heap
            else:
                buckets[rank] = [i]
                words[rank >> WORD] |= bits[rank & low]
                top |= bits[rank >> WORD]
        while top:
            word = (top & -top).bit_length() - 1
            bitmap = words[word]
            rank = word << WORD | (bitmap & -bitmap).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[word] = bitmap = bitmap ^ bits[rank & low]
                if not bitmap:
                    top ^= bits[word]
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = -1
            if end < n:
                before[end] = i
            for at in (before[i], i):
                if at < 0:
                    continue
                last = after[at]
                merged = rank_of(piece[at : after[last]]) if last < n else None
                if merged is None:
                    pair[at] = -1
                    continue
                pair[at] = merged
                if merged in buckets:
                    heappush(buckets[merged], at)
                else:
                    buckets[merged] = [at]
                    words[merged >> WORD] |= bits[merged & low]
                    top |= bits[merged >> WORD]
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids


class Memo(dict):
    """Little-endian ids by pre-token, in two generations: when the younger is full the older goes, so size is bounded."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.encoder.encode(piece.encode())
            ids = pack(f"<{len(found)}I", *found)
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]
)
DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def _codec(docs: DataFrame, vocabulary: str, pattern: str, schema: pa.Schema, finish) -> DataFrame:
    # A vocabulary has a fixed size, whatever the data.
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        ranks = shared.value
        memo = Memo(Encoder(ranks)).__getitem__
        split = regex.compile(pattern).findall
        token = {rank: piece for piece, rank in ranks.items()}.__getitem__
        for batch in batches:
            rows = [], [], [], []
            for key, text in zip(values(batch, "doc_id"), values(batch, "text")):
                ids = b"".join(map(memo, split(text or "")))
                decoded = b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))
                for column, value in zip(rows, (key, len(ids) // 4, finish(ids), finish(decoded))):
                    column.append(value)
            yield record_batch(schema, rows)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, ddl(schema))


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (the bytes the ids stand for).

    One row out for each row in, repeated rows included; a null text counts as empty (no tokens);
    a null doc_id stays null; other columns are not read. Every byte must be a token of the vocabulary.
    """
    return _codec(docs, vocabulary, pattern, OUT, bytes)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The same with SHA-256 digests in place of ids and decoded bytes, made before they leave the task."""
    return _codec(docs, vocabulary, pattern, DIGESTS, lambda data: hashlib.sha256(data).hexdigest())
