import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang) rows, with columns whose names operators might use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, 1, 7, "x", 0.5) for r in rows]
        extra = [T.StructField("n", T.LongType()), T.StructField("words", T.StringType()), T.StructField("score", T.DoubleType())]
        return spark.createDataFrame(full, T.StructType([*DOCS.fields, *extra])).repartition(3)

    return make


@pytest.fixture
def prose():
    """Makes pseudo-random prose of so many words."""

    def make(n, seed):
        rng = random.Random(seed)
        parts = ["the", "er", "ing", "tion", "ou", "and", "st", "ly", "en", "re"]
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make


#: Texts that every operator must take.
ODD_TEXTS = [None, "", "   \n\t ", "a", "É", "😀 \u0000 x", " ", "word " * 3000, "x" * 20000]
