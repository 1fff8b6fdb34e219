"""Repository-shaped views of the given tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limelight.functions.timing import from_micros
from limelight.plans.layout import spread
from limelight.sources.scratch import scratch_path

FIRST_MICROS = 1_451_606_400_000_000  # 2016-01-01
HOUR_MICROS = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(c: Column) -> Column:
    """Result timestamps without zone, as the other engine has them."""
    return c.cast("timestamp_ntz")


def readme() -> Column:
    kind = F.col("doc_id") % 3
    return (
        F.when(kind == 0, F.concat(F.lit("# "), "text"))
        .when(kind == 1, F.concat(F.lit("intro\n## "), "text"))
        .otherwise(F.col("text"))
    )


README_SQL = """CASE doc_id % 3 WHEN 0 THEN '# ' || text WHEN 1 THEN 'intro' || chr(10) || '## ' || text ELSE text END"""


def readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", readme().alias("readme"))


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as repositories: length for stars, labels for flags, lines for commits."""
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    labels = table(spark, sf_dir, "labels")
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("bigint")
    created = FIRST_MICROS + F.col("doc_id") * HOUR_MICROS
    return documents.join(labels, "doc_id", "left").select(
        F.concat(F.lit("R"), "doc_id").alias("id"),
        F.concat(F.lit("repo-"), "doc_id").alias("name"),
        F.nullif(F.col("source"), F.lit("src3")).alias("description"),
        F.concat_ws(", ", "lang", "source").alias("topics"),
        F.col("source").alias("license"),
        readme().alias("readme"),
        F.nullif(F.col("lang"), F.lit("es")).alias("primarylanguage"),
        from_micros(created).alias("createddate"),
        from_micros(created + HOUR_MICROS).alias("lastpusheddate"),
        (F.col("quality") == 1).alias("fork"),
        (F.col("toxic") == 1).alias("archived"),
        F.lit(False).alias("locked"),
        F.lit(0).cast("bigint").alias("forkcount"),
        lines.alias("commits"),
        F.lit(0).cast("bigint").alias("issues"),
        F.lit(0).cast("bigint").alias("pullrequests"),
        F.lit(1).cast("bigint").alias("users"),
        F.lit(1).cast("bigint").alias("watchs"),
        F.col("n_chars").alias("stars"),
    )


REPOSITORIES_SQL = f"""
    SELECT 'R' || d.doc_id AS id, 'repo-' || d.doc_id AS name, nullif(source, 'src3') AS description,
           lang || ', ' || source AS topics, source AS license,
           CASE d.doc_id % 3 WHEN 0 THEN '# ' || text WHEN 1 THEN 'intro' || chr(10) || '## ' || text ELSE text END
               AS readme,
           nullif(lang, 'es') AS primarylanguage,
           make_timestamp({FIRST_MICROS} + d.doc_id * {HOUR_MICROS}) AS createddate,
           make_timestamp({FIRST_MICROS} + (d.doc_id + 1) * {HOUR_MICROS}) AS lastpusheddate,
           quality = 1 AS fork, toxic = 1 AS archived, false AS locked, 0::BIGINT AS forkcount,
           (length(text) - length(replace(text, chr(10), '')))::BIGINT AS commits,
           0::BIGINT AS issues, 0::BIGINT AS pullrequests, 1::BIGINT AS users, 1::BIGINT AS watchs,
           n_chars AS stars
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days with events as periods, with their number of events."""
    start = F.date_trunc("day", F.col("ts").cast("timestamp"))
    counted = table(spark, sf_dir, "events").groupBy(start.alias("startdate")).agg(F.count("*").alias("numrepos"))
    return counted.select("startdate", (F.col("startdate") + F.expr("interval 1 day")).alias("enddate"), "numrepos")


DAYS_SQL = """
    SELECT date_trunc('day', ts)::TIMESTAMP AS startdate,
           date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS enddate, count(*) AS numrepos
    FROM events GROUP BY ALL"""

# Landed pages ------------------------------------------------------------------------------
# Documents become nodes with every kind of damage the cleaning has to cope with; 100 nodes
# make a page. Each page comes after two failed attempts: one answered with errors, one cut off.
# Round 1 repeats every document with one star more.

PAGE_ROWS = 100


def _node(bonus: int) -> Column:
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    counted = lambda c: F.struct(text(c).alias("totalCount"))
    zoned = lambda micros: F.date_format(from_micros(micros), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    created = FIRST_MICROS + i * HOUR_MICROS
    topic = lambda c: F.struct(F.struct(F.struct(c.alias("name")).alias("topic")).alias("node"))
    return F.struct(
        F.concat(F.lit("R"), i).alias("id"),
        F.concat(F.lit("repo"), F.char(F.lit(0)), F.lit("-"), i).alias("name"),
        F.when(i % 5 == 0, "").when(i % 5 == 1, F.char(F.lit(0))).otherwise(F.col("source")).alias("description"),
        F.when(i % 7 == 0, "many").otherwise(text(i % 13)).alias("forkCount"),
        (i % 2 == 0).alias("isFork"),
        F.when(i % 3 != 0, i % 3 == 1).alias("isArchived"),
        F.lit(None).cast("boolean").alias("isLocked"),
        F.when(i % 11 == 0, "yesterday").otherwise(zoned(created)).alias("createdAt"),
        zoned(created + HOUR_MICROS).alias("pushedAt"),
        F.when(F.col("lang") != "es", F.struct(F.col("lang").alias("name"))).alias("primaryLanguage"),
        F.when(i % 4 != 0, counted(i % 17)).alias("assignableUsers"),
        counted(F.col("n_chars") + bonus).alias("stargazers"),
        F.when(i % 6 != 0, counted(i % 19)).alias("watchers"),
        counted(i % 23).alias("issues"),
        counted(i % 29).alias("pullRequests"),
        F.when(
            i % 8 != 0,
            F.struct(
                F.array(
                    topic(F.col("lang")),
                    topic(F.lit(None).cast("string")),
                    topic(F.col("source")),
                    topic(F.lit("t4")),
                    topic(F.lit("t5")),
                    topic(F.lit("t6")),
                ).alias("edges")
            ),
        ).alias("repositoryTopics"),
        F.struct(F.col("source").alias("key")).alias("licenseInfo"),
        F.when(i % 9 != 0, F.struct(counted(i % 31).alias("history"))).alias("commits"),
        F.struct(F.col("text").alias("text")).alias("readme"),
    )


def land_pages(spark: SparkSession, sf_dir: str, landing: str | None = None, round: int = 0) -> str:
    """Write one round of pages as JSON lines; returns the landing folder."""
    page = F.call_function("div", F.col("doc_id"), F.lit(PAGE_ROWS))
    nodes = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        page.alias("page"), "doc_id", F.struct(_node(round).alias("node")).alias("edge")
    )
    # doc_id is a key, so a page cannot hold more than PAGE_ROWS nodes.
    grouped = nodes.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("doc_id", "edge"))).alias("rows"))
    start = from_micros(FIRST_MICROS + F.col("page") * PAGE_ROWS * HOUR_MICROS)
    stop = from_micros(FIRST_MICROS + (F.col("page") + 1) * PAGE_ROWS * HOUR_MICROS)
    zoned = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    info = F.struct(
        F.lit(round == 0).alias("hasNextPage"),
        F.concat(F.lit(f"cursor:{round}:"), "page").alias("endCursor"),
    )
    search = F.struct(F.col("rows.edge").alias("edges"), info.alias("pageInfo"))
    documents = grouped.select(
        F.struct(search.alias("search")).alias("data"),
        F.array(F.struct(F.concat(F.lit("timeout "), "page").alias("message"))).alias("errors"),
        F.struct(zoned(start).alias("startdate"), zoned(stop).alias("enddate")).alias("period"),
        (F.lit(round * 1_000_000_000_000) + F.col("page")).alias("seq"),
    )
    good = F.to_json(F.struct("data", "period", "seq"), {"ignoreNullFields": "false"})
    failed = F.to_json(F.struct("errors", "period", "seq"))
    cut_off = F.concat(F.lit('{"page":'), F.col("seq"), F.lit(',"data":{"search":{"edges":['))
    landing = landing or scratch_path(spark, "landing")
    lines = documents.select(F.explode(F.array(failed, cut_off, good)).alias("value"))
    lines.write.mode("append").text(landing)
    return landing


def landed_sql(bonus: int) -> str:
    """The rows that must come out of a round of pages."""
    return f"""
    SELECT 'R' || doc_id AS id, 'repo-' || doc_id AS name,
           CASE WHEN doc_id % 5 < 2 THEN NULL ELSE source END AS description,
           CASE WHEN doc_id % 8 <> 0 THEN lang || ', ' || source || ', t4, t5' END AS topics,
           source AS license, text AS readme, nullif(lang, 'es') AS primarylanguage,
           CASE WHEN doc_id % 11 <> 0 THEN make_timestamp({FIRST_MICROS} + doc_id * {HOUR_MICROS}) END AS createddate,
           make_timestamp({FIRST_MICROS} + (doc_id + 1) * {HOUR_MICROS}) AS lastpusheddate,
           doc_id % 2 = 0 AS fork, doc_id % 3 = 1 AS archived, false AS locked,
           CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id % 13 END AS forkcount,
           CASE WHEN doc_id % 9 = 0 THEN 0 ELSE doc_id % 31 END AS commits,
           doc_id % 23 AS issues, doc_id % 29 AS pullrequests,
           CASE WHEN doc_id % 4 = 0 THEN 1 ELSE doc_id % 17 END AS users,
           CASE WHEN doc_id % 6 = 0 THEN 1 ELSE doc_id % 19 END AS watchs,
           n_chars + {bonus} AS stars
    FROM documents"""
