"""Token statistics over a table of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limelight.functions.text import bigrams, tokens
from limelight.plans.layout import spread
from limelight.plans.skew import broadcast_if_small, lookup_join
from limelight.sources.scratch import materialise


def token_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    texts = spread(df.select(key, text), key)
    return texts.select(key, F.explode(tokens(F.col(text))).alias("token"))


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    words = token_rows(df, key, text)
    return words.groupBy("token").agg(F.count("*").alias("n"))


def bag_of_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """How often each document holds each token. `df` is read twice.

    A row's tokens are counted within the row, so nothing of it is moved. Only the rows of a key that has several
    are grouped; which keys these are is found among the keys alone.
    """
    texts = df.select(key, text)
    repeated = texts.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")).filter("__n > 1").select("__key")
    repeated = materialise(repeated, "repeated-keys")
    counted = lambda rows: spread(rows, key).select(key, F.inline(_counted(F.col(text))))
    if repeated.isEmpty():
        return counted(texts)
    repeated, _ = broadcast_if_small(repeated)
    same = F.col(key).eqNullSafe(F.col("__key"))
    words = token_rows(texts.join(repeated, same, "left_semi"), key, text)
    return counted(texts.join(repeated, same, "left_anti")).unionByName(
        words.groupBy(key, "token").agg(F.count("*").alias("n"))
    )


def _counted(text: Column) -> Column:
    """(token, n) for the distinct tokens of a text: the lengths of the runs of its sorted tokens."""

    def runs(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        return F.flatten(F.transform(F.array(starts), lambda s: F.transform(s, lambda at, k: run(words, s, at, k))))

    def run(words: Column, starts: Column, at: Column, k: Column) -> Column:
        n = F.coalesce(F.get(starts, k + 1), F.size(words)) - at
        return F.struct(F.get(words, at).alias("token"), n.cast("bigint").alias("n"))

    # An array of one makes the sorted tokens a lambda's variable, which is evaluated once.
    words = F.filter(F.array(F.sort_array(tokens(text))), lambda w: F.size(w) > 0)
    return F.flatten(F.transform(words, runs))


def bigram_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """How often two tokens follow each other in a document."""
    words = spread(df.select(key, text), key).select(tokens(F.col(text)).alias("words"))
    pairs = words.select(F.inline(bigrams(F.col("words")))).filter("second is not null")
    counts = pairs.groupBy("first", "second").agg(F.count("*").alias("n"))
    return counts.select(F.concat_ws(" ", "first", "second").alias("bigram"), "n")


def document_frequency(df: DataFrame, key: str, text: str) -> DataFrame:
    """Number of documents holding each token."""
    texts = spread(df.select(key, text), key)
    words = texts.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("df"))


def vocabulary(
    df: DataFrame, key: str, text: str, min_share: float = 0.0, max_share: float = 1.0, stop_words: Sequence[str] = ()
) -> DataFrame:
    """Tokens with their document frequency, without rare, frequent and stop words.

    Shares are of the number of documents. The stop words are a fixed list given by the
    caller (for instance `StopWordsRemover.loadDefaultStopWords`).
    """
    documents = df.agg(F.count("*")).scalar()
    kept = document_frequency(df, key, text).filter(
        (F.col("df") >= documents * min_share) & (F.col("df") <= documents * max_share)
    )
    return kept.filter(~F.col("token").isin(list(stop_words))) if stop_words else kept


def lemma_counts(df: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Token counts after replacing tokens by their lemma; `dictionary` has `token` (unique) and `lemma`.

    Tokens are counted before the join, so each is one row in it.
    """
    counts = token_counts(df, key, text).join(dictionary, "token", "left")
    lemma = F.coalesce("lemma", "token").alias("lemma")
    return counts.groupBy(lemma).agg(F.sum("n").alias("n"))


def lemma_bags(df: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """`bag_of_words` over lemmas; pass a stored `dictionary`.

    Tokens are counted by document first. Only those that have a lemma or are one can meet others of their document;
    the rest is not moved again. A small dictionary is broadcast to the counted tokens.
    """
    bags = bag_of_words(df, key, text)
    sided, small = broadcast_if_small(dictionary)
    if not small:
        bags = materialise(bags, "bags")
        weights = lambda: materialise(bags.groupBy("token").agg(F.count("*").alias("df")), "weights")
        found = lookup_join(bags, dictionary, "token", weights, "df", "left")
        return found.groupBy(key, F.coalesce("lemma", "token").alias("lemma")).agg(F.sum("n").alias("n"))
    stems = F.broadcast(dictionary.select(F.col("lemma").alias("token"), F.lit(True).alias("__stem")).distinct())
    found = bags.join(sided, "token", "left").join(stems, "token", "left")
    meets = F.col("lemma").isNotNull() | F.col("__stem").isNotNull()
    lemma = F.coalesce("lemma", "token").alias("lemma")
    merged = found.filter(meets).groupBy(key, lemma).agg(F.sum("n").alias("n"))
    return found.filter(~meets).select(key, lemma, "n").unionByName(merged)


def tf_idf(df: DataFrame, key: str, text: str) -> DataFrame:
    """tf * ln((documents + 1) / (df + 1)) per document and token.

    While the frequencies are few, they are broadcast and the counted tokens are neither moved nor stored: counting
    them twice costs less than writing them.
    """
    documents = df.agg(F.count("*")).scalar()
    bags = bag_of_words(df, key, text)
    frequency = materialise(bags.groupBy("token").agg(F.count("*").alias("df")), "frequency")
    sided, small = broadcast_if_small(frequency)
    if small:
        weighted = bags.join(sided, "token")
    else:
        weighted = lookup_join(materialise(bags, "bags"), frequency, "token", lambda: frequency, "df", "inner")
    idf = F.log((documents + 1) / (F.col("df") + 1))
    return weighted.select(key, "token", F.col("n").alias("tf"), "df", (F.col("n") * idf).alias("tfidf"))
