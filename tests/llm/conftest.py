from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table from (doc_id, text) rows."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], SCHEMA)

    return make


@pytest.fixture
def prose():
    """Random texts of invented words."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "tes", "ur", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]

    def make(words, seed):
        own = random.Random(seed)
        return " ".join(own.choice(vocabulary) for _ in range(words))

    return make
