"""Inputs that every operator of this package must take: nulls, empty and long texts, ties, repeats, odd columns."""

import pytest

LONG = "lorem ipsum dolor " * 30_000
HARD = [
    (1, None, "en", None, None), (2, "", "en", "s", 0), (3, "one", "en", "s", 3), (4, "the quick brown fox jumps over the lazy dog", None, "s", 43),
    (5, "the quick brown fox jumps over the lazy dog", "en", None, 43), (5, "the quick brown fox jumps over the lazy dog", "en", None, 43),
    (5, "another text under the same key", "en", "s", 1), (None, "text without a key", "en", "s", 1), (None, None, None, None, None),
    (7, LONG, "la", "s", len(LONG)), (8, LONG, "la", "s", len(LONG)), (9, "日本語 \U0001d11e é́ \x00 <|endoftext|> don't", "ja", "s", 9), (10, " \n\t ", "en", "s", 4),
]
#: Columns that an operator might use itself.
CLASHES = ("id", "n", "key", "row_id", "piece", "component", "score", "kept", "items", "__gone", "text_hash", "hits")


@pytest.fixture(scope="session")
def hard(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({name: F.lit(name) for name in CLASHES})


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
