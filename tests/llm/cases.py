"""Odd documents that every operator must take: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score string, size string, n string, "
    "key string, node string, pos string, _digest string, _source string, row_key string, uid string"
)


def prose(words: int, seed: int, letters: str = "abcdefghij") -> str:
    draw = random.Random(seed)
    made = ["".join(draw.choices(letters, k=draw.randint(2, 8))) for _ in range(words)]
    return "\n".join(" ".join(made[i:i + 30]) for i in range(0, words, 30))


LONG = prose(60_000, 1)
ONE_WORD = "x" * 100_000
NEAR = prose(400, 2)


def rows() -> list[tuple]:
    texts = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t \x0b", "b"), (4, "word", "b"), (4, "word", "b"), (None, prose(100, 3), None), (None, None, None),
        (None, prose(100, 3), None), (5, LONG, "c"), (6, LONG, "c"), (7, ONE_WORD, None), (8, NEAR, "a"), (9, NEAR.replace("a", "A", 3), "b"),
        (9, "same id, other text", "b"), (10, "ça été 日本語 \u2028 \x1c \x85 naïve\r\nline", "é"), (11, "a b c", "a"), (12, "A B C", "a"),
        (13, "\n".join([prose(60, 4).replace("\n", " ")] * 5), "a"),
    ]
    return [(i, t, "en", s, len(t) if t is not None else None, *["z"] * 10) for i, t, s in texts]


def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]
