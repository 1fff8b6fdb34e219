"""Feature stages and splits."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.catalogue.fixtures import README_SQL, REPOSITORIES_SQL, ntz, readmes, repositories, table
from limelight.catalogue.registry import query
from limelight.functions.hashing import key_hash
from limelight.functions.text import FIRST_HEADING_OLD
from limelight.operators import features, sampling
from limelight.operators.quantiles import ExactQuantileBuckets
from limelight.schema import FEATURES, conform
from limelight.sources.datasets import materialise_once
from limelight.sources.scratch import scratch_path

FLAG_SQL = "CASE WHEN {0} THEN 1 WHEN NOT {0} THEN 0 END AS {0}"
FRAME_SQL = f"""
WITH r AS ({REPOSITORIES_SQL}), m AS (SELECT min(stars) AS lo, max(stars) AS hi FROM r)
SELECT name, description, topics, license, readme, primarylanguage, createddate, lastpusheddate,
       {FLAG_SQL.format("fork")}, {FLAG_SQL.format("archived")}, {FLAG_SQL.format("locked")}, commits,
       round((stars - lo)::DOUBLE / (hi - lo), 6) AS target,
       coalesce(regexp_extract(readme, '^#+.*', 0), '') AS titles, length(readme)::INTEGER AS length,
       CASE WHEN ('0x' || substring(sha256('split:1:' || id), 1, 8))::BIGINT < 3435973837 THEN 'train' ELSE 'test' END
           AS split
FROM r, m"""


def processed(spark, sf_dir: str) -> DataFrame:
    """Repositories after all stages, with the name of their part."""
    model = Pipeline(stages=features.popularity_stages()).fit(
        # The scaler needs the stars only: fitting on this spares it the join with the labels.
        table(spark, sf_dir, "documents").select(F.col("n_chars").alias("stars"))
    )
    return model.transform(sampling.with_split(repositories(spark, sf_dir), "id"))


@query(FRAME_SQL)
def feature_frame(spark, sf_dir):
    return processed(spark, sf_dir).withColumns(
        {
            "target": F.round("target", 6),
            "createddate": ntz(F.col("createddate")),
            "lastpusheddate": ntz(F.col("lastpusheddate")),
        }
    )


@query(FRAME_SQL)
def stored_split(spark, sf_dir):
    """`feature_frame` through the Parquet sink: conform, write train and test, read both back."""
    rows = processed(spark, sf_dir)
    parts = lambda: {p: rows.filter(F.col("split") == p).drop("split") for p in sampling.DEFAULT_SPLIT}
    root = scratch_path(spark, "split")
    stored = materialise_once(spark, {p: f"{root}/{p}" for p in sampling.DEFAULT_SPLIT}, FEATURES, parts)
    both = stored["train"].withColumn("split", F.lit("train")).unionByName(
        stored["test"].withColumn("split", F.lit("test"))
    )
    return both.withColumns(
        {
            "target": F.round("target", 6),
            "createddate": ntz(F.col("createddate")),
            "lastpusheddate": ntz(F.col("lastpusheddate")),
        }
    )


@query("SELECT doc_id, lang, n_chars FROM documents")
def remove_columns(spark, sf_dir):
    return features.RemoveColumns("text", "source", "no_such_column").transform(table(spark, sf_dir, "documents"))


@query(
    f"""SELECT doc_id, {FLAG_SQL.format("fork")}, {FLAG_SQL.format("archived")}
    FROM (SELECT d.doc_id, quality = 1 AS fork, toxic = 1 AS archived
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
)
def cast_to_int(spark, sf_dir):
    flags = (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .select("doc_id", (F.col("quality") == 1).alias("fork"), (F.col("toxic") == 1).alias("archived"))
    )
    return features.CastToInt("fork", "archived").transform(flags)


def _scaled(spark, sf_dir, stages):
    stars = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("stars"))
    stages = [*stages, features.CleanUp("target")]
    return Pipeline(stages=stages).fit(stars).transform(stars).withColumn("target", F.round("target", 6))


@query(
    """SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS target
    FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)"""
)
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, features.min_max_stages())


@query(
    """SELECT o_orderkey, round(o_totalprice / sd, 6) AS target
    FROM orders, (SELECT stddev_samp(o_totalprice) AS sd FROM orders)"""
)
def scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, features.standard_stages())


@query(
    f"""SELECT doc_id, coalesce(regexp_extract(readme, '^#+.*', 0), '') AS titles, length(readme)::INTEGER AS length
    FROM (SELECT doc_id, {README_SQL} AS readme FROM documents)"""
)
def heading_first(spark, sf_dir):
    return features.ExtractTextFeatures("readme").transform(readmes(spark, sf_dir)).drop("readme")


@query(
    """SELECT doc_id, lang, source, n_chars FROM documents
    WHERE ('0x' || substring(sha256('sample:1:' || doc_id), 1, 8))::BIGINT < 429496730"""
)
def sample_keyed(spark, sf_dir):
    return sampling.sample_keyed(table(spark, sf_dir, "documents"), "doc_id", 10).drop("text")


@query(
    """SELECT o_orderkey, CASE WHEN h < 3435973837 THEN 'train' ELSE 'test' END AS split
    FROM (SELECT o_orderkey, ('0x' || substring(sha256('split:1:' || o_orderkey), 1, 8))::BIGINT AS h FROM orders)"""
)
def split_keyed(spark, sf_dir):
    return sampling.with_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(
    """SELECT o_orderkey, ('0x' || substring(sha256('subset:7:' || o_orderkey), 1, 8))::BIGINT % 16 AS subset_id FROM orders"""
)
def subset_id(spark, sf_dir):
    return sampling.with_subset(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 16, seed=7)


@query("""SELECT o_orderkey, ('0x' || substring(sha256('hash:1:' || o_orderkey), 1, 8))::BIGINT AS hash FROM orders""")
def hash_of_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", key_hash(F.col("o_orderkey"), 1).alias("hash"))


def buckets_sql(points: str, buckets: int) -> str:
    """`points` gives id and v; a bucket begins with the value at rank ceil(k n / buckets), a missing value has none."""
    return f"""WITH p AS ({points}), r AS (SELECT v, row_number() OVER (ORDER BY v) AS rank, count(*) OVER () AS n
        FROM p WHERE v IS NOT NULL),
    e AS (SELECT DISTINCT r.v AS edge FROM r, range(1, {buckets}) k(k) WHERE rank = greatest(1, ceil(k * n / {buckets})))
    SELECT id, v, CASE WHEN v IS NOT NULL THEN (SELECT count(*) FROM e WHERE edge <= v)::DOUBLE END AS bucket FROM p"""


@query(buckets_sql("SELECT o_orderkey AS id, o_totalprice::DOUBLE AS v FROM orders", 10))
def quantile_bucket(spark, sf_dir):
    """Tenths of the orders by price, cut at exact quantiles."""
    prices = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("v"))
    return ExactQuantileBuckets("v").fit(prices).transform(prices)


@query(
    buckets_sql(
        """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber <> 5 THEN l_quantity::DOUBLE END AS v
        FROM lineitem""", 7
    )
)
def quantile_bucket_ties(spark, sf_dir):
    """Fifty different values in all lines, and missing ones."""
    quantity = F.when(F.col("l_linenumber") != 5, F.col("l_quantity").cast("double"))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), quantity.alias("v"))
    return ExactQuantileBuckets("v", buckets=7).fit(lines).transform(lines)


@query(
    """SELECT doc_id, coalesce(regexp_extract(readme, '^[# ]+(.*[\\p{L}\\p{N}_])', 1), '') AS titles, length(readme)::INTEGER AS length
    FROM (SELECT doc_id, """
    + README_SQL
    + """ AS readme FROM documents)"""
)
def heading_old(spark, sf_dir):
    """The older pattern: the heading without its marks, up to the last end of a word."""
    stage = features.ExtractTextFeatures("readme", FIRST_HEADING_OLD, 1)
    return stage.transform(readmes(spark, sf_dir)).drop("readme")


@query(
    """SELECT doc_id::BIGINT AS id, lang AS primarylanguage, n_chars::DOUBLE AS target FROM documents"""
)
def conform_schema(spark, sf_dir):
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("primarylanguage", T.StringType()),
            T.StructField("target", T.DoubleType()),
        ]
    )
    given = table(spark, sf_dir, "documents").select(
        F.col("n_chars").alias("target"), F.col("lang").alias("primarylanguage"), F.col("doc_id").alias("id")
    )
    return conform(given, schema)


PARTS_SQL = """(SELECT o_orderkey, ('0x' || substring(sha256('sample:1:' || o_orderkey), 1, 8))::BIGINT AS a,
    ('0x' || substring(sha256('split:1:' || o_orderkey), 1, 8))::BIGINT AS b,
    ('0x' || substring(sha256('subset:1:' || o_orderkey), 1, 8))::BIGINT AS c FROM orders)"""


@query(
    f"""SELECT o_orderkey, CASE WHEN b < 3435973837 THEN 'train' ELSE 'test' END AS split, c % 20 AS subset_id
    FROM {PARTS_SQL} WHERE a < 536870912"""
)
def sample_split_subsets(spark, sf_dir):
    """12.5 % of the orders, split, and in 20 subsets: three draws that do not depend on each other."""
    drawn = sampling.sample_keyed(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 12.5)
    return sampling.with_subset(sampling.with_split(drawn, "o_orderkey"), "o_orderkey", 20)
