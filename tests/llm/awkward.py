"""Documents that operators tend to trip over, with clashing extra columns."""

import random

from pyspark.sql import functions as F

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "n_words bigint, key string, id string, start bigint, size bigint, label string, total bigint")


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def rows():
    base, other = prose(1, 300), prose(2, 260)
    texts = [
        (1, base, "a"), (2, base, "a"), (3, base + " tail", "a"), (4, other, "b"),
        (5, None, "a"), (6, "", None), (7, " \n\t ", "b"), (8, "word", "b"), (9, "two words", "b"),
        (10, "a\x0bb\x1cc d ü ÄÖ é ﬁ 你好 <|endoftext|> x  y \n\n z", "c"),
        (11, prose(3, 30_000, 50_000), "a"), (12, "ab " * 900, "a"), (13, "The the THE " * 200, "b"),
        (None, base[:900], "a"), (None, prose(4, 50), None), (14, prose(5, 120), "c"), (14, prose(6, 120), "c"),
        (15, prose(7, 80), "b"), (15, prose(7, 80), "b"), (16, "x" * 5000, "a"),
    ]
    return [(d, t, "en", s, None if t is None else len(t), 7, "k", "i", 3, None, "l", 9) for d, t, s in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, F.col("n_chars"))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
