"""Text measures of one row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns are part of the feature definitions.
FIRST_HEADING = "^#+.*"
FIRST_HEADING_OLD = r"^[# ]+(.*)\b"
EVERY_HEADING = "(?m)^#+.*"
WORD = r"\S+"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
LOWER_CASE_START = r"(^|[ ])\p{Ll}"
TOKEN_GAP = r"[^\p{L}\p{N}]+"


def first_heading(text: Column, pattern: str = FIRST_HEADING, group: int = 0) -> Column:
    """The heading on the first line, '' if that line is none."""
    return F.regexp_extract(text, pattern, group)


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EVERY_HEADING), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def emoji_count(text: Column) -> Column:
    """Code points, so an emoji with a skin tone counts twice."""
    return F.regexp_count(text, F.lit(EMOJI)).cast("bigint")


def heading_text(heading: Column) -> Column:
    """A heading without its leading marks."""
    return F.regexp_replace(heading, "^[# ]+", "")


def is_title_case(title: Column) -> Column:
    """No word starts with a lower-case letter."""
    return ~title.rlike(LOWER_CASE_START)


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), TOKEN_GAP), "")


def bigrams(words: Column) -> Column:
    """Neighbouring pairs in order, as (first, second); built inside the row. The last pair has no second word."""
    following = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(0)))
    return F.arrays_zip(words.alias("first"), following.alias("second"))
