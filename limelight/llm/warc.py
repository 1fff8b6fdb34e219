"""WARC archives with a gzip member per record (operator 8).

Archives are first written as Spark writes compressed text: one gzip stream per file, in which no record
can be reached without inflating all before it. The normaliser inflates such a stream once, from
front to back, in pieces of bounded size, rewrites every record as a gzip member of its own and keeps
(archive, offset, length) of each in a sidecar index, a Parquet table beside the archives. Reading a
record back is then one seek.

Archives lie in the folder shared by all executors; they are read and written there through
`pyarrow.fs`. A rewritten archive appears under its name only when complete, so a task that is run again,
or twice at the same time, does no harm.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limelight.llm.common import ddl, record_batch, values
from limelight.plans.skew import lookup_join
from limelight.sources.scratch import materialise, scratch_path

READ_BYTES = 8 << 20  # of an archive that one task reads back at least
REVISIT_BYTES = 100
RECORDS_PER_ARCHIVE = 5_000
PIECE = 1 << 20
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RECORDS = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("record_type", pa.string()), ("refers_to", pa.int64())]
)


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, first): rows whose payload of at least `least` bytes has a response with a smaller page_id.

    Takes (page_id, digest, size). Digests are counted before any join, and the rows of a digest are never gathered.
    """
    firsts = pages.filter(F.col("size") >= least).groupBy("digest")
    firsts = firsts.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    firsts = materialise(firsts, "payloads")
    found = lookup_join(pages.select("page_id", "digest"), firsts, "digest", lambda: firsts, "n", "inner")
    return found.filter("page_id IS NULL OR page_id > first").select("page_id", "digest", "first").distinct()


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """One column `value`: the record of each row of (page_id, url, html, digest, size, first), without its end."""
    text, first = F.coalesce("html", F.lit("")), F.col("first")
    again = first.isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END)
    )
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("size"))
    optional = lambda tag, c: F.coalesce(_line(tag, c), F.lit(""))
    url = F.nullif(F.regexp_replace("url", r"[\x00-\x20\x7f]+", "%20"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        optional("WARC-Record-ID", name(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        optional("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        optional("WARC-Refers-To", name(first)),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(""),
        _line("X-Payload-Length", F.col("size").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return pages.select(F.concat(head, http, F.when(again, "").otherwise(text)).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Archives of `pages` (page_id, url, html) below `path`, each one gzip stream."""
    source = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    text = F.coalesce("html", F.lit(""))
    digest, size = F.sha2(text.cast("binary"), 256), F.octet_length(text).cast("bigint")
    again = materialise(revisits(source.select("page_id", digest.alias("digest"), size.alias("size")), least), "revisits")
    keyed = source.withColumn("digest", digest).withColumn("size", size).alias("p")
    same = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest"))
    joined = keyed.join(again.alias("r"), same, "left").select("p.*", "r.first")
    writer = records(joined).write.option("compression", "gzip").option("lineSep", END)
    writer.option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def split_stream(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Records, each with its end, from the pieces of one gzip stream (or several one after another)."""
    held = bytearray()
    for data in _inflated(pieces):
        held += data
        at = 0
        while (stop := _record_end(held, at)) is not None:
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError(f"{len(held)} bytes after the last record")


def _inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What the pieces hold, PIECE bytes at a time however well they are compressed."""
    inflate = zlib.decompressobj(wbits=31)
    for piece in pieces:
        while piece:
            yield inflate.decompress(piece, PIECE)
            piece = inflate.unconsumed_tail
            if inflate.eof:
                piece, inflate = inflate.unused_data, zlib.decompressobj(wbits=31)
    yield inflate.flush()


def _record_end(data: bytearray, at: int) -> int | None:
    head = data.find(END.encode(), at)
    if head < 0:
        return None
    length = re.search(rb"\r\ncontent-length:\s*(\d+)", data[at:head], re.IGNORECASE)
    if not length:
        raise ValueError(f"no length in {bytes(data[at:head])!r}")
    stop = head + 2 * len(END) + int(length[1])
    return stop if stop <= len(data) else None


def member(record: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def normalise(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Rewrite every archive below `path` into `out`, a gzip member per record; returns the stored sidecar index.

    The index, (archive, offset, length) of every record, is the Parquet table `out`/index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in values(batch, "path"):
                store, place = _open(archive)
                target = f"{out}/{re.sub(r'[.]txt[.]gz$', '', archive.rpartition('/')[2])}.warc.gz"
                place_out = _open(target)[1]
                part, offset, rows = f"{place_out}.{uuid.uuid4().hex}", 0, ([], [], [])
                store.create_dir(place_out.rpartition("/")[0])
                with store.open_input_file(place) as source, store.open_output_stream(part, compression=None) as sink:
                    for record in split_stream(iter(lambda: source.read(PIECE), b"")):
                        data = member(record)
                        sink.write(data)
                        for column, value in zip(rows, (target, offset, len(data))):
                            column.append(value)
                        offset += len(data)
                store.move(part, place_out)
                yield record_batch(INDEX, rows)

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path")
    count = max(archives.count(), 1)
    archives.repartition(count).mapInArrow(run, ddl(INDEX)).write.parquet(f"{out}/index")
    return spark.read.parquet(f"{out}/index")


def fields(head: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines if name}


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (what follows the HTTP header) of one record."""
    head, _, rest = record.partition(END.encode())
    named = fields(head)
    block = rest[: int(named["content-length"])]
    return named, block.partition(END.encode())[2]


def read_archives(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each indexed record.

    A response's length and digest are those of its payload as read and must agree with its header; a revisit
    has no payload, so they come from its header.
    """

    def number(name: str | None) -> int | None:
        return int(name.removeprefix("<urn:page:").removesuffix(">")) if name else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            rows = [], [], [], [], []
            for archive, offset, length in zip(*(values(batch, c) for c in ("archive", "offset", "length"))):
                if archive != opened:
                    store, place = _open(archive)
                    opened, source = archive, store.open_input_file(place)
                source.seek(offset)
                named, payload = parse(zlib.decompress(source.read(length), 31))
                kind, size = named["warc-type"], int(named["x-payload-length"])
                digest = named["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"payload of {named.get('warc-record-id')} is not what its header says")
                row = number(named.get("warc-record-id")), size, digest, kind, number(named.get("warc-refers-to"))
                for column, value in zip(rows, row):
                    column.append(value)
            yield record_batch(RECORDS, rows)

    # The index is tiny whatever it points at: the bytes of the archives decide how many tasks read them.
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    stretch = F.expr(f"offset DIV {READ_BYTES}")
    ordered = index.repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, ddl(RECORDS))


def archive_and_read(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Write `pages` as WARC, normalise the archives, and read every record back through the index.

    A row per row of `pages`. A null html is an empty payload. Rows with equal payloads of `least` bytes or more
    revisit the smallest page_id; rows that share that smallest page_id are all responses; a null page_id
    revisits any other, and is a response if there is none. A null url has no target line.
    """
    spark = pages.sparkSession
    whole, single = scratch_path(spark, "archives"), scratch_path(spark, "warc")
    write_archives(pages, whole, least)
    return read_archives(normalise(spark, whole, single))
