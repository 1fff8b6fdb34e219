"""Small tables with every kind of trouble."""

import random

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, fp string, chunk int, digest string"


def documents(spark, rows):
    """`rows` of (doc_id, text), with more columns whose names operators use themselves."""
    full = [(i, t, "en", "s", None if t is None else len(t), "r", "f", 1, "d") for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def prose(seed, words, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


TROUBLE = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, prose(1, 400)),
    (6, prose(1, 400)),
    (7, "É ß 世界 \U0001f600 " + prose(2, 30)),
    (8, prose(3, 30_000)),
    (8, prose(4, 50)),
    (8, prose(4, 50)),
    (None, prose(5, 40)),
    (None, None),
]
