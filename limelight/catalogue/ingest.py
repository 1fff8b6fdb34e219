"""Landed pages, batch and streaming, and the conversions of single fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.catalogue.fixtures import (
    FIRST_MICROS,
    HOUR_MICROS,
    PAGE_ROWS,
    land_pages,
    landed_sql,
    ntz,
    table,
)
from limelight.catalogue.registry import query
from limelight.functions import cleaning, timing
from limelight.schema import DATE_COLUMNS
from limelight.sources import pages as P
from limelight.sources.scratch import scratch_path
from limelight.streaming import ingest
from limelight.streaming.store import VersionedStore

FILES_PER_BATCH = 4


def _stored(rows: DataFrame) -> DataFrame:
    return rows.drop("ingest_seq").withColumns({c: ntz(F.col(c)) for c in DATE_COLUMNS})


@query(landed_sql(0))
def flatten_pages(spark, sf_dir):
    pages = P.read_pages(spark, land_pages(spark, sf_dir))
    return _stored(P.storable(P.repositories(P.page_nodes(pages))))


@query(
    f"""WITH p AS (SELECT DISTINCT doc_id // {PAGE_ROWS} AS page FROM documents)
    SELECT page AS seq, 'errors' AS reason, '[{{"message":"timeout ' || page || '"}}]' AS detail FROM p
    UNION ALL SELECT 0, 'corrupt', '{{"page":' || page || ',"data":{{"search":{{"edges":[' FROM p"""
)
def quarantine_pages(spark, sf_dir):
    """Failed attempts are kept with their reason; a cut-off page has lost its place in the order."""
    rejected = P.rejected_pages(P.read_pages(spark, land_pages(spark, sf_dir)))
    return rejected.select("origin.seq", "reason", "detail")


@query(
    """SELECT 'R' || doc_id AS id, 'createddate unreadable' AS reasons FROM documents WHERE doc_id % 11 = 0"""
)
def quarantine_rows(spark, sf_dir):
    nodes = P.page_nodes(P.read_pages(spark, land_pages(spark, sf_dir)))
    return P.rejected_rows(nodes).select("node.id", F.array_join("reasons", ", ").alias("reasons"))


@query(landed_sql(0))
def stream_ingest(spark, sf_dir):
    """The same rows through a stream that appends to Parquet, a few files at a time."""
    landing, out = land_pages(spark, sf_dir), scratch_path(spark, "appended")
    pages = P.stream_pages(spark, landing, FILES_PER_BATCH)
    ingest.run(ingest.append_pages(pages, out, scratch_path(spark, "stream")))
    return _stored(spark.read.parquet(out))


@query(
    f"""SELECT id, stars, run FROM (SELECT id, stars, 0 AS run FROM ({landed_sql(0)})
    UNION ALL SELECT id, stars, 1 FROM ({landed_sql(1)}))"""
)
def stream_resume(spark, sf_dir):
    """Two runs over one checkpoint: the second reads only what has landed in between."""
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "stream")
    out, seen = scratch_path(spark, "appended"), []
    for run in (0, 1):
        land_pages(spark, sf_dir, landing, run)
        ingest.run(ingest.append_pages(P.stream_pages(spark, landing), out, checkpoint))
        seen.append(spark.read.parquet(out))
    # Rows of the second run are those beyond the files present after the first.
    first_files = seen[0].select(F.input_file_name().alias("file")).distinct()
    tagged = seen[1].select("id", "stars", F.input_file_name().alias("file"))
    marked = tagged.join(first_files.withColumn("old", F.lit(True)), "file", "left")
    return marked.select("id", "stars", F.when(F.col("old"), 0).otherwise(1).alias("run"))


def _upserted(spark, sf_dir) -> VersionedStore:
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "stream")
    store = VersionedStore(spark, scratch_path(spark, "store"))
    for run in (0, 1):
        land_pages(spark, sf_dir, landing, run)
        ingest.run(ingest.upsert_pages(spark, landing, store, checkpoint))
    return store


@query(landed_sql(1))
def stream_two_checkpoints(spark, sf_dir):
    """The second arrival comes through a checkpoint of its own, whose batch numbers start again at 0."""
    store = VersionedStore(spark, scratch_path(spark, "store"))
    for run in (0, 1):
        landing = land_pages(spark, sf_dir, round=run)
        ingest.run(ingest.upsert_pages(spark, landing, store, scratch_path(spark, "stream")))
    return _stored(ingest.current_repositories(store))


@query(landed_sql(1))
def stream_upsert(spark, sf_dir):
    """Every repository arrives twice; the later row stays."""
    return _stored(ingest.current_repositories(_upserted(spark, sf_dir)))


@query(
    f"""SELECT make_timestamp({FIRST_MICROS} + page * {PAGE_ROWS * HOUR_MICROS}) AS startdate,
    make_timestamp({FIRST_MICROS} + (page + 1) * {PAGE_ROWS * HOUR_MICROS}) AS enddate,
    false AS nextpage, 'cursor:1:' || page AS after
    FROM (SELECT DISTINCT doc_id // {PAGE_ROWS} AS page FROM documents)"""
)
def stream_ledger(spark, sf_dir):
    """How far each period has been read, after the batches were folded into one."""
    store = _upserted(spark, sf_dir)
    ingest.compact(store)
    ledger = ingest.current_ledger(store)
    return ledger.withColumns({c: ntz(F.col(c)) for c in ("startdate", "enddate")})


@query(
    """SELECT event_id, (props->>'k')::BIGINT AS k, (props->>'missing') AS missing FROM events"""
)
def json_extract(spark, sf_dir):
    props = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id",
        cleaning.safe_int(cleaning.json_field(props, "k"), None).alias("k"),
        cleaning.json_field(props, "missing", "deeper").alias("missing"),
    )


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'vw' ELSE event_type END AS text
    FROM events"""
)
def clean_text(spark, sf_dir):
    dirty = (
        F.when(F.col("event_type") == "error", "")
        .when(F.col("event_type") == "view", F.concat(F.lit("v"), F.char(F.lit(0)), F.lit("w")))
        .otherwise(F.col("event_type"))
    )
    return table(spark, sf_dir, "events").select("event_id", cleaning.clean_text(dirty).alias("text"))


@query(
    """SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 5 = 0 THEN event_type ELSE user_id::VARCHAR END
    AS BIGINT), 1) AS users FROM events"""
)
def safe_int(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", cleaning.safe_int(raw, 1).alias("users"))


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN true ELSE false END AS flag FROM events"""
)
def safe_bool(spark, sf_dir):
    raw = (
        F.when(F.col("event_type") == "click", "true")
        .when(F.col("event_type") == "view", "false")
        .when(F.col("event_type") != "error", F.col("event_type"))
    )
    return table(spark, sf_dir, "events").select("event_id", cleaning.safe_bool(raw).alias("flag"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN date_trunc('second', ts)::TIMESTAMP END AS at FROM events"""
)
def parse_ts(spark, sf_dir):
    text = F.date_format("ts", cleaning.PAGE_TIME_FORMAT)
    raw = F.when(F.col("event_id") % 4 == 0, "bad").otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", ntz(cleaning.parse_time(raw)).alias("at"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS boundary FROM events""")
def iso_date(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", timing.boundary_text(F.col("ts")).alias("boundary"))


@query(
    """SELECT doc_id, nullif(array_to_string(list_filter([nullif(lang, 'es'), nullif(source, 'src3')],
    lambda x: x IS NOT NULL), ', '), '') AS topics FROM documents"""
)
def join_array(spark, sf_dir):
    names = F.array(F.nullif("lang", F.lit("es")), F.nullif("source", F.lit("src3")))
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.join_members(names).alias("topics"))


@query(
    """SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 5), ' ') AS first_five FROM documents"""
)
def limit_array(spark, sf_dir):
    words = F.split("text", " ")
    first = F.array_join(cleaning.first_members(words, 5), " ")
    return table(spark, sf_dir, "documents").select("doc_id", first.alias("first_five"))
