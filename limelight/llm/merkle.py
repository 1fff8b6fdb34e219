"""Document fingerprints as Merkle trees (operator 3).

A text is a tree: sections (they begin at headings and after blank lines) of paragraphs (lines) of pieces
(clauses; long ones are cut after words that a checksum picks, and what is still long, such as text without
spaces, where a hash of the last four bytes says so: a cut does not depend on what is far before it). The first
`HEAD` bytes of a text come in smaller pieces, so that short texts have several, too. A node's digest is that of its children's digests, so equal roots mean equal texts, and
two trees differ only below nodes with different digests: following those finds the edits.

The fingerprint is text: the root's digest, then the checksums of the pieces, paragraphs by commas and sections by semicolons.
The likeness of two fingerprints is 1 if the roots agree, else twice the pieces that they share, over all pieces.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.llm.common import Batches, ddl, values

CLAUSE = re.compile(rb"(?<=[.,;:!?]) ")
LONG = 60  # bytes; a longer clause is cut further, and no piece is longer
CUT = 4  # one word in so many ends a piece of a long clause
HEAD = 64  # bytes
FINE, COARSE = (4, 2, 12), (16, 4, LONG)  # least bytes of a piece, one place in 2^so many ends one, most bytes
SECTION = re.compile(r"\s*$|#")

OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def cut(data: bytes, least: int, bits: int, most: int) -> list[bytes]:
    """`data` in pieces of `least` to `most` bytes (the last may be shorter), cut by the four bytes before the cut."""
    if len(data) <= least:
        return [data] if data else []
    x = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    last = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
    places = (np.flatnonzero(last * np.uint32(0x9E3779B1) >> (32 - bits) == 0) + 4).tolist()
    out, at, i = [], 0, 0
    while at < len(data):
        i = bisect_left(places, at + least, i)
        stop = min(places[i] if i < len(places) else len(data), at + most)
        out.append(data[at:stop])
        at = stop
    return out


def pieces(paragraph: bytes, head: int = 0) -> list[bytes]:
    """Pieces of a line whose first `head` bytes belong to the head of the text."""
    out = cut(paragraph[:head], *FINE)
    if head >= len(paragraph):
        return out
    for clause in CLAUSE.split(paragraph[head:]):
        if len(clause) <= LONG:
            out.append(clause)
            continue
        words: list[bytes] = []
        for word in clause.split(b" "):
            words.append(word)
            if zlib.crc32(word) % CUT == 0:
                out += _bounded(b" ".join(words))
                words = []
        if words:
            out += _bounded(b" ".join(words))
    return out


def _bounded(piece: bytes) -> list[bytes]:
    """Parts after the first are marked by a byte that UTF-8 never has: no space stood before them."""
    if len(piece) <= LONG:
        return [piece]
    first, *rest = cut(piece, *COARSE)
    return [first, *(b"\xff" + part for part in rest)]


def sections(text: str) -> list[list[str]]:
    """Lines with their ends, grouped by section; joined they are the text."""
    out: list[list[str]] = []
    fresh = True
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        special = SECTION.match(line)
        if fresh or special and line.startswith("#"):
            out.append([])
        out[-1].append(line)
        fresh = bool(special) and not line.startswith("#")
    return out


def _digest(parts: list[bytes]) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for part in parts:
        h.update(len(part).to_bytes(8, "big") + part)
    return h.digest()


def fingerprint(text: str | None) -> str:
    tops, shown, head = [], [], HEAD
    for section in sections(text or ""):
        middles, lines = [], []
        for paragraph in section:
            data = paragraph.encode()
            leaves = pieces(data, head)
            head = max(head - len(data), 0)
            middles.append(_digest(leaves))
            lines.append("".join([f"{zlib.crc32(leaf):08x}" for leaf in leaves]))
        tops.append(_digest(middles))
        shown.append(",".join(lines))
    return _digest(tops).hex() + ":" + ";".join(shown)


def leaves(print_: str) -> list[str]:
    body = print_.partition(":")[2].replace(",", "").replace(";", "")
    return [body[i : i + 8] for i in range(0, len(body), 8)]


def likeness(a: str, b: str) -> float:
    if a[:32] == b[:32]:
        return 1.0
    x, y = leaves(a), leaves(b)
    shared = (Counter(x) & Counter(y)).total()
    return 2 * shared / (len(x) + len(y)) if x or y else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of `a` whose branch is not the same in `b`; none if the roots agree."""
    if a[:32] == b[:32]:
        return []
    mine, other = (p.partition(":")[2].split(";") for p in (a, b))
    out = []
    for i, section in enumerate(mine):
        if i < len(other) and other[i] == section:
            continue
        theirs = other[i].split(",") if i < len(other) else []
        out += [(i, j) for j, p in enumerate(section.split(",")) if j >= len(theirs) or theirs[j] != p]
    return out


def edited_pieces(a: str, b: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, piece) of `a` in the branches of `edits` that the same paragraph of `b` does not have."""
    mine, other = ([s.split(",") for s in p.partition(":")[2].split(";")] for p in (a, b))
    out = []
    for i, j in edits(a, b):
        spare = Counter(leaves(":" + other[i][j]) if i < len(other) and j < len(other[i]) else ())
        for k, piece in enumerate(leaves(":" + mine[i][j])):
            if spare[piece]:
                spare[piece] -= 1
            else:
                out.append((i, j, k))
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, part, turn, key, doc_id, text): before the documents of a key comes the text that follows them.

    Buckets are ranges of ids, cut at quantiles and read from the largest key down; each begins with the smallest text of
    the first key of the bucket above it (turn 0; the last bucket with that of the first one). A key that holds
    several quantiles has a bucket of its own, dealt in as many parts by the text. One shuffle of the texts.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 10_000)
    quantiles = Counter(source.select(asked.alias("q")).first()["q"] or ())
    parts = {key: n for key, n in quantiles.items() if n > 1}
    cuts = sorted({*quantiles, *(key + 1 for key in parts)})

    bucket = F.udf(lambda key: bisect_right(cuts, key), "int", useArrow=True)
    keys = source.select("key", bucket("key").alias("bucket"))
    starts = keys.groupBy("bucket").agg(F.min("key").alias("first")).orderBy("bucket").collect()  # a row per bucket
    firsts = [r["first"] for r in starts]
    above = [
        (r["bucket"], part, after)
        for r, after in zip(starts, [*firsts[1:], *firsts[:1]])
        for part in range(parts.get(r["first"], 1))
    ]
    least = source.filter(F.col("key").isin(firsts)).groupBy("key").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    ahead = docs.sparkSession.createDataFrame(above, "bucket int, part int, key bigint").join(least, "key")
    ahead = ahead.select("bucket", "part", F.lit(0).alias("turn"), "key", F.lit(None).cast("bigint").alias("doc_id"), "text")
    part_of = F.lit(0)
    for key, n in parts.items():
        part_of = F.when(F.col("key") == key, F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).otherwise(part_of)
    own = source.select(bucket("key").alias("bucket"), part_of.alias("part"), F.lit(1).alias("turn"), "key", "doc_id", "text")
    count = max(buckets // 2, 1)
    dealt = own.unionByName(ahead).repartition(count, "bucket", "part")
    return dealt.sortWithinPartitions("bucket", "part", "turn", F.desc("key"), F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document has the next larger doc_id; after the largest comes the smallest. Of rows with the same doc_id
    all have the same next one; where the next id has several rows, that with the smallest text counts. A null
    doc_id comes before all others. A null text counts as empty; a single document is its own next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(OUT, 2_000)
        place, following, near, ahead, last = None, "", "", "", ("", fingerprint(""))
        names = ("bucket", "part", "turn", "key", "doc_id", "text")
        for batch in batches:
            for bucket, part, turn, key, doc_id, text in zip(*(values(batch, c) for c in names)):
                text = text or ""
                if turn == 0:
                    ahead = text
                    continue
                mine = last[1] if text == last[0] else fingerprint(text)
                if (bucket, part, key) != place:
                    # Rows come from the largest key down: what was first of the last key follows this one.
                    place, following, ahead = (bucket, part, key), ahead, text
                    near = last[1] if following == last[0] else fingerprint(following)
                last = text, mine
                changed = edited(text, following)
                other = mine if changed == text else fingerprint(changed)
                digest = hashlib.sha256(changed.encode()).hexdigest()
                out.add(doc_id, len(text), digest, mine, other, likeness(mine, other), likeness(mine, near))
                yield from out.full()
        yield from out.rest()

    columns = ["bucket", "part", "turn", "key", "doc_id", "text"]
    return _neighbours(docs).select(*columns).mapInArrow(run, ddl(OUT))
