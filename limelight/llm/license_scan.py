"""Licence scan: MinHash bands over overlapping windows, then exact containment (operator 2).

DataFrame expressions only, and no shuffle: a document's windows are sketched inside its row, and the templates'
band keys, a few thousand numbers, are constants of the plan.

Texts become words (runs of ASCII letters and digits, lower case) and shingles of five words. Windows come in two
scales, because a window must fit into the template that it is to find:

* one shingle, at every place, for templates of up to `SHORT` shingles. All permutations agree on a set of one, so one
  band is enough and the collision is certain;
* `WINDOW` shingles, every `WINDOW` / 2, for longer templates, which are cut into windows at every place. A copy of a
  template contains whole windows of the document; such a window equals one of the template's. With
  `BANDS` bands of `ROWS` rows, two windows of similarity 0.8 collide with probability 1 - (1 - 0.8^ROWS)^BANDS = 0.998.

A permutation of the shingles' 64-bit hashes is their order after exclusive-or with a constant of its own.
A retrieved template is reported if the document has at least `LEAST` of its distinct shingles, compared as text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limelight.llm.license_templates import TEMPLATES

SHINGLE = 5
LEAST = 0.8
WINDOW = 16
SHORT = WINDOW + WINDOW // 2 - 1  # shingles; any longer run contains a whole window of the document
BANDS, ROWS = 6, 2
GOLDEN = 0x9E3779B97F4A7C15


def template_shingles(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def _places(n: Column) -> Column:
    """0 to n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _salts() -> list[int]:
    """One constant for each row of each band."""
    return [((i + 1) * GOLDEN + (1 << 63)) % (1 << 64) - (1 << 63) for i in range(BANDS * ROWS)]


def band_keys(minima: list[Column]) -> Column:
    """Array of one key per band from the window's minima, a column for each permutation."""
    return F.array(
        *(F.xxhash64(F.lit(b), *minima[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS))
    )


def shingle_hashes(words: Column) -> Column:
    at = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE)))
    return F.transform(_places(F.size(words) - SHINGLE + 1), at)


def _minima(hashes: Column) -> Column:
    return F.array(*(F.array_min(F.transform(hashes, lambda x, s=s: x.bitwiseXOR(F.lit(s)))) for s in _salts()))


def window_keys(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """Band keys of all windows of WINDOW shingles: minima of half windows first, then of each two neighbours."""
    half, h = WINDOW // 2, F.col(hashes)
    parts = F.transform(_places(F.ceil(F.size(h) / half)), lambda b: F.slice(h, b * half + 1, half))
    df = df.withColumn("__halves", F.transform(parts, _minima))
    halves = F.col("__halves")

    def keys(k: Column) -> Column:
        this, following = F.get(halves, k), F.get(halves, k + 1)
        return band_keys([F.least(F.get(this, j), F.get(following, j)) for j in range(BANDS * ROWS)])

    return df.withColumn(out, F.flatten(F.transform(_places(F.size(halves) - 1), keys))).drop("__halves")


def template_keys(spark: SparkSession, templates: dict[str, str]) -> tuple[dict[int, set[int]], dict[int, set[int]]]:
    """Numbers of templates by shingle hash (short ones) and by band key (long ones)."""
    rows = [(i, text) for i, text in enumerate(templates.values())]
    df = spark.createDataFrame(rows, "template int, text string").withColumn("words", words_of(F.col("text")))
    df = df.withColumn("h", shingle_hashes(F.col("words")))
    short = df.filter(F.size("h") <= SHORT).select("template", F.explode("h").alias("key"))
    windows = F.transform(_places(F.size("h") - WINDOW + 1), lambda i: F.slice("h", i + 1, WINDOW))
    long = df.filter(F.size("h") > SHORT).select("template", F.explode(windows).alias("w"))
    long = long.withColumn("m", _minima(F.col("w")))
    keys = band_keys([F.get("m", F.lit(j)) for j in range(BANDS * ROWS)])
    long = long.select("template", F.explode(keys).alias("key"))
    found: list[dict[int, set[int]]] = []
    for part in (short, long):
        by_key: dict[int, set[int]] = {}
        for row in part.collect():  # as many as the templates have shingles and bands
            by_key.setdefault(row["key"], set()).add(row["template"])
        found.append(by_key)
    return found[0], found[1]


def _retrieved(keys: Column, by_key: dict[int, set[int]]) -> Column:
    """Numbers of the templates that any of the keys stands for."""
    if not by_key:
        return F.array().cast("array<int>")
    hits = F.filter(keys, lambda k: k.isin(list(by_key)))
    entries = [x for k, t in by_key.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(t))))]
    return F.flatten(F.transform(F.array_distinct(hits), lambda k: F.element_at(F.create_map(*entries), k)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, n_shingles, n_found, containment, first_word: a row for each template that a document contains.

    n_shingles and n_found count the template's distinct shingles and those of them in the document; first_word
    is the place of the first one. A document without a template (a null or short text, too) has no row;
    repeated rows are reported as often as they occur; a null doc_id stays null. Templates of fewer than five
    words have no shingle and are never found.
    """
    spark = docs.sparkSession
    short, long = template_keys(spark, templates)
    df = docs.select(F.col("doc_id").alias("doc_id"), words_of(F.col("text").cast("string")).alias("words"))
    df = df.withColumn("h", shingle_hashes(F.col("words")))
    df = window_keys(df, "h", "keys")
    retrieved = F.array_distinct(F.concat(_retrieved(F.col("h"), short), _retrieved(F.col("keys"), long)))
    # The outer form keeps the optimizer from sketching everything a second time for a filter.
    df = df.select("doc_id", "words", F.explode_outer(retrieved).alias("template")).filter("template IS NOT NULL")
    rows = [(i, name, sorted(set(template_shingles(t)))) for i, (name, t) in enumerate(templates.items())]
    known = spark.createDataFrame(rows, "template int, license string, shingles array<string>")
    at = lambda i: F.concat_ws(" ", F.slice("words", i + 1, SHINGLE))
    df = df.withColumn("own", F.transform(_places(F.size("words") - SHINGLE + 1), at))
    df = df.join(F.broadcast(known), "template")  # the templates, a parameter
    n, found = F.size("shingles"), F.array_intersect("shingles", "own")
    df = df.select("doc_id", "license", n.alias("n_shingles"), "own", found.alias("found"))
    df = df.withColumn("n_found", F.size("found")).withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    first = F.array_min(F.transform("found", lambda s: F.array_position("own", s))) - 1
    return df.filter(F.col("containment") >= least).select(
        "doc_id", "license", "n_shingles", "n_found", "containment", first.cast("int").alias("first_word")
    )


def oracle(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """SQL for the rows of `scan`: the containment of every template in every document."""
    rows = ", ".join(
        f"('{name}', '{s}', {len(found)})"
        for name, found in ((n, sorted(set(template_shingles(t)))) for n, t in templates.items())
        for s in found
    )
    return f"""
WITH t(license, shingle, n_shingles) AS (VALUES {rows}),
d AS (
    SELECT row_number() OVER () AS k, doc_id,
           list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)) AS w
    FROM documents
), s AS (
    SELECT k, doc_id, i, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS shingle
    FROM (SELECT k, doc_id, w, unnest(range(len(w) - {SHINGLE - 1})) AS i FROM d)
)
SELECT doc_id, license, n_shingles, count(DISTINCT shingle)::INT AS n_found,
       count(DISTINCT shingle)::DOUBLE / n_shingles AS containment, min(i)::INT AS first_word
FROM s JOIN t USING (shingle) GROUP BY k, doc_id, license, n_shingles
HAVING count(DISTINCT shingle)::DOUBLE / n_shingles >= {least}
"""
