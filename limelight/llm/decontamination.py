"""Benchmark decontamination with a distributed positional inverted index (operator 6).

The test items become phrases: windows of `WINDOW` consecutive words. Document frequencies of the
test terms are counted over all documents; each phrase is looked up by its two rarest terms, so the index
needs postings (term, document, positions) of such terms only. It is a stored table. The rarest
term's positions less its place in the phrase are possible starts; intersecting them with those of the second
term leaves few, which are compared with the text, word by word.

The test set is taken in blocks of bounded size, so what is broadcast (its terms, its phrases) is bounded, too.
Documents are never broadcast or gathered.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.llm.common import ddl, plain_words, record_batch, row_keyed, values
from limelight.sources.scratch import materialise

WINDOW = 10
BLOCK_BYTES = 8 << 20

PHRASES = pa.schema([("item", pa.string()), ("phrase", pa.string())])
COUNTS = pa.schema([("term", pa.string()), ("n", pa.int64())])
POSTINGS = pa.schema([("term", pa.string()), ("row", pa.int64()), ("positions", pa.list_(pa.int32()))])
LOOKUPS = "phrase string, rare string, rare_at int, second string, second_at int, words int"
HITS = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
)
DIGESTS = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "n_words", "n_hit", "n_items")]
    + [("items_sha256", pa.string()), ("contaminated", pa.bool_())]
)


def phrases(items: DataFrame, window: int | None = WINDOW) -> DataFrame:
    """(item, phrase): distinct windows of each item, words joined by spaces; None takes whole items.

    An item with fewer words than a window is one phrase; one without words (null, too) has none.
    A null item_id has phrases like any other; only its name is missing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [], []
            for item, text in zip(values(batch, "item"), values(batch, "text")):
                words = plain_words(text)
                size = min(window or len(words), len(words))
                for i in range(len(words) - size + 1 if words else 0):
                    rows[0].append(item)
                    rows[1].append(b" ".join(words[i : i + size]).decode())
            yield record_batch(PHRASES, rows)

    source = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, ddl(PHRASES)).distinct()


def term_counts(docs: DataFrame, terms: set[bytes]) -> DataFrame:
    """(term, n): number of documents that have the term, for the given terms only."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, Counter()
        for batch in batches:
            for text in values(batch, "text"):
                seen.update(wanted.intersection(plain_words(text)))
        yield record_batch(COUNTS, [[t.decode() for t in seen], list(seen.values())])

    return docs.select("text").mapInArrow(run, ddl(COUNTS)).groupBy("term").agg(F.sum("n").alias("n"))


def index(docs: DataFrame, terms: set[bytes]) -> DataFrame:
    """Postings (term, row, positions ascending) of the given terms in `docs` (row, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            rows = [], [], []
            for row, text in zip(values(batch, "row"), values(batch, "text")):
                words = plain_words(text)
                if wanted.isdisjoint(words):
                    continue
                places: dict[bytes, list[int]] = {}
                for at, word in enumerate(words):
                    if word in wanted:
                        places.setdefault(word, []).append(at)
                rows[0].extend(w.decode() for w in places)
                rows[1].extend([row] * len(places))
                rows[2].extend(places.values())
            yield record_batch(POSTINGS, rows)

    return docs.select("row", "text").mapInArrow(run, ddl(POSTINGS))


def lookups(block: list[str], count: dict[str, int]) -> list[tuple]:
    """For each phrase its two rarest terms with their places; phrases with a term that no document has are left out."""
    out = []
    for phrase in block:
        words = phrase.split(" ")
        if all(w in count for w in words):
            first, *other = sorted(range(len(words)), key=lambda i: (count[words[i]], words[i], i))
            # The same term twice adds little: the next rarest other one if there is one.
            second = next((i for i in other if words[i] != words[first]), other[0] if other else None)
            tail = (None, None) if second is None else (words[second], second)
            out.append((phrase, words[first], first, *tail, len(words)))
    return out


def _candidates(docs: DataFrame, block: list[str], slop: int | None) -> DataFrame:
    """(row, phrase, start) where both terms stand at their places (slop None), or near enough to each other."""
    spark = docs.sparkSession
    count = {r["term"]: r["n"] for r in term_counts(docs, {w.encode() for p in block for w in p.split(" ")}).collect()}
    looked_up = lookups(block, count)
    wanted = {t for r in looked_up for t in (r[1], r[3]) if t is not None}
    stored = materialise(index(docs, {t.encode() for t in wanted}), "postings")
    asked = F.broadcast(spark.createDataFrame(looked_up, LOOKUPS))  # one block, whose size is bounded
    second = stored.select(F.col("term").alias("second"), "row", F.col("positions").alias("others"))
    if slop is None:
        starts = F.filter(F.transform("positions", lambda p: p - F.col("rare_at")), lambda s: s >= 0)
        meet = F.array_intersect("starts", F.transform("others", lambda p: p - F.col("second_at")))
    else:
        starts = F.col("positions")
        reach = F.col("words") + slop
        near = lambda p: F.exists("others", lambda q: F.abs(p - q) < reach)
        meet = F.filter("starts", near)
    found = stored.join(asked, stored["term"] == F.col("rare")).withColumn("starts", starts).filter("size(starts) > 0")
    alone = found.filter("second IS NULL").select("row", "phrase", "starts")
    both = found.filter("second IS NOT NULL").join(second, ["second", "row"]).withColumn("starts", meet)
    return alone.unionAll(both.select("row", "phrase", "starts")).select("row", "phrase", F.explode("starts").alias("start"))


def candidates(docs: DataFrame, wanted: DataFrame, slop: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Candidates (row, phrase, start) for all phrases of `wanted`, block after block."""
    size = wanted.agg(F.sum(F.octet_length("phrase") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = []
    for b in range(blocks):
        part = wanted.select("phrase").distinct().filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b)
        block = sorted(r["phrase"] for r in part.collect())
        if block:
            out.append(_candidates(docs, block, slop))
    if not out:
        return docs.sparkSession.createDataFrame([], "row bigint, phrase string, start int")
    return reduce(DataFrame.unionAll, out)


def within(words: list[bytes], near: int, phrase: list[bytes], reach: int) -> tuple[int, int] | None:
    """First stretch of at most `reach` words around place `near` that has all words of the phrase, in any order."""
    need = Counter(phrase)
    for left in range(max(0, near - reach + 1), near + 1):
        missing = need - Counter(words[left : left + reach])
        if not missing:
            stop = left + len(phrase)
            while need - Counter(words[left:stop]):
                stop += 1
            return left, stop
    return None


def matches(docs: DataFrame, items: DataFrame, window: int | None = WINDOW, slop: int | None = None) -> DataFrame:
    """(row, phrase, start, stop): every exact occurrence of a phrase, or with `slop` each stretch of at most
    phrase + slop words that has all its words, in any order, around an occurrence of its rarest word.

    `docs` has row (unique) and text.
    """
    schema = pa.schema([("row", pa.int64()), ("phrase", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for row, text, found in zip(*(values(batch, c) for c in ("row", "text", "found"))):
                words = plain_words(text)
                for f in found:
                    phrase, start = f["phrase"].encode().split(b" "), f["start"]
                    if slop is None:
                        if words[start : start + len(phrase)] == phrase:
                            rows.add((row, f["phrase"], start, start + len(phrase)))
                    elif stretch := within(words, start, phrase, len(phrase) + slop):
                        rows.add((row, f["phrase"], *stretch))
            yield record_batch(schema, list(zip(*sorted(rows))) or [[]] * 4)

    # Bounded by a document's length and the number of phrases.
    grouped = candidates(docs, phrases(items, window), slop).groupBy("row")
    grouped = grouped.agg(F.collect_list(F.struct("phrase", "start")).alias("found"))
    return docs.join(grouped, "row").select("row", "text", "found").mapInArrow(run, ddl(schema))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 5) -> DataFrame:
    """Whole items whose words lie together within `slop` extra words: (row, phrase, start, stop)."""
    return matches(docs, items, window=None, slop=slop)


def _report(docs: DataFrame, items: DataFrame, window: int, schema: pa.Schema, finish) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in schema]
            for key, text, found in zip(*(values(batch, c) for c in ("doc_id", "text", "found"))):
                words = plain_words(text)
                hits: set[int] = set()
                names: set[str] = set()
                unnamed = False
                for f in found or ():
                    phrase, start = f["phrase"].encode().split(b" "), f["start"]
                    if words[start : start + len(phrase)] == phrase:
                        hits.update(range(start, start + len(phrase)))
                        names.update(f["items"])
                        unnamed = unnamed or f["unnamed"]
                for column, value in zip(columns, finish(key, len(words), hits, sorted(names), unnamed)):
                    column.append(value)
            yield record_batch(schema, columns)

    keyed = row_keyed(docs)
    wanted = materialise(phrases(items, window), "phrases")
    named = wanted.groupBy("phrase").agg(
        F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("unnamed")
    )
    found = candidates(keyed, wanted).join(named, "phrase")
    grouped = found.groupBy("row").agg(F.collect_list(F.struct("phrase", "start", "items", "unnamed")).alias("found"))
    joined = keyed.join(grouped, "row", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(run, ddl(schema))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hits (places of hit words), items (sorted ids of items with an occurring window).

    One row per row of `docs`, repeated rows included. Null and empty texts have no words and no hits; a null doc_id
    stays null; without items nothing is hit. Item ids are compared and sorted as strings; items with a null id
    hit without being listed.
    """
    return _report(docs, items, window, HITS, lambda key, n, hits, names, _: (key, n, sorted(hits), names))


def contamination_digests(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same as counts, a SHA-256 of the comma-joined item ids, and whether anything is hit.

    In the number of items all those with a null id are one.
    """
    finish = lambda key, n, hits, names, unnamed: (
        key, n, len(hits), len(names) + unnamed, hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hits)
    )
    return _report(docs, items, window, DIGESTS, finish)
