"""Text measures and token statistics over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.catalogue.fixtures import README_SQL, readmes, table
from limelight.catalogue.registry import query
from limelight.functions import text as X
from limelight.operators import vocabulary as V
from limelight.sources.scratch import materialise

READMES_SQL = f"(SELECT doc_id, {README_SQL} AS readme FROM documents)"
EMOJI_SQL = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"


@query(
    f"""SELECT doc_id, array_to_string(regexp_extract_all(readme, '(?m)^#+.*', 0), chr(10)) AS headings
    FROM {READMES_SQL}"""
)
def headings_all(spark, sf_dir):
    found = F.array_join(X.headings(F.col("readme")), "\n")
    return readmes(spark, sf_dir).select("doc_id", found.alias("headings"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS words FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query(
    f"""SELECT doc_id, len(regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN text || '😀☕' ELSE text END,
    '{EMOJI_SQL}'))::BIGINT AS emojis FROM documents"""
)
def emoji_count(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("😀☕"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.emoji_count(text).alias("emojis"))


@query(
    f"""SELECT doc_id, title, NOT regexp_matches(title, '(^|[ ])\\p{{Ll}}') AS title_case FROM
    (SELECT doc_id, regexp_replace(regexp_extract(readme, '^#+.*', 0), '^[# ]+', '') AS title FROM {READMES_SQL})"""
)
def title_case(spark, sf_dir):
    title = X.heading_text(X.first_heading(F.col("readme")))
    titled = readmes(spark, sf_dir).select("doc_id", title.alias("title"))
    return titled.withColumn("title_case", X.is_title_case(F.col("title")))


TOKENS_SQL = """(SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'),
    lambda x: x <> '')) AS token FROM documents)"""


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT token, count(*) AS n FROM {TOKENS_SQL} GROUP BY token")
def token_counts(spark, sf_dir):
    return V.token_counts(_documents(spark, sf_dir), "doc_id", "text")


@query(f"SELECT doc_id, token, count(*) AS n FROM {TOKENS_SQL} GROUP BY doc_id, token")
def bag_of_words(spark, sf_dir):
    return V.bag_of_words(_documents(spark, sf_dir), "doc_id", "text")


@query(
    """SELECT w[i] || ' ' || w[i + 1] AS bigram, count(*) AS n FROM
    (SELECT w, unnest(range(1, len(w))) AS i FROM
     (SELECT list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents))
    GROUP BY 1"""
)
def bigrams(spark, sf_dir):
    return V.bigram_counts(_documents(spark, sf_dir), "doc_id", "text")


# A stop word list handed to the operator.
STOP_WORDS = ["the", "of", "and", "to", "in", "le", "la", "les", "de", "der", "die", "und", "el", "los", "que"]
QUOTED_STOP_WORDS = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    f"""SELECT token, df FROM (SELECT token, count(DISTINCT doc_id) AS df FROM {TOKENS_SQL} GROUP BY token)
    WHERE df >= (SELECT count(*) FROM documents) * 0.01 AND df <= (SELECT count(*) FROM documents) * 0.5
    AND token NOT IN ({QUOTED_STOP_WORDS})"""
)
def vocab_filtered(spark, sf_dir):
    return V.vocabulary(_documents(spark, sf_dir), "doc_id", "text", 0.01, 0.5, STOP_WORDS)


DICTIONARY_SQL = f"""(SELECT a.token, b.token AS lemma FROM (SELECT DISTINCT token FROM {TOKENS_SQL}) a
    JOIN (SELECT DISTINCT token FROM {TOKENS_SQL}) b ON a.token = b.token || 's')"""


def _dictionary(spark, sf_dir) -> DataFrame:
    """Plain plurals of the corpus: tokens that are another token followed by 's'."""
    known = materialise(V.token_counts(_documents(spark, sf_dir), "doc_id", "text").select("token"), "known")
    stems = known.select(F.col("token").alias("lemma"), F.concat("token", F.lit("s")).alias("token"))
    return materialise(stems.join(known, "token"), "dictionary")


@query(
    f"""SELECT coalesce(lemma, t.token) AS lemma, count(*) AS n FROM {TOKENS_SQL} t
    LEFT JOIN {DICTIONARY_SQL} d ON t.token = d.token GROUP BY 1"""
)
def lemmatise(spark, sf_dir):
    return V.lemma_counts(_documents(spark, sf_dir), "doc_id", "text", _dictionary(spark, sf_dir))


@query(
    f"""SELECT doc_id, coalesce(lemma, t.token) AS lemma, count(*) AS n FROM {TOKENS_SQL} t
    LEFT JOIN {DICTIONARY_SQL} d ON t.token = d.token GROUP BY 1, 2"""
)
def lemma_bags(spark, sf_dir):
    return V.lemma_bags(_documents(spark, sf_dir), "doc_id", "text", _dictionary(spark, sf_dir))


@query(
    f"""WITH b AS (SELECT doc_id, token, count(*) AS tf FROM {TOKENS_SQL} GROUP BY doc_id, token),
    f AS (SELECT token, count(*) AS df FROM b GROUP BY token)
    SELECT doc_id, token, tf, df, round(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS tfidf
    FROM b JOIN f USING (token)"""
)
def tfidf(spark, sf_dir):
    return V.tf_idf(_documents(spark, sf_dir), "doc_id", "text").withColumn("tfidf", F.round("tfidf", 6))
