import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: Nulls in every column, empty and very long texts, repeated rows, ties, odd blanks.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, "The Quick brown fox jumps over the lazy dog", "en", None, 43),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (None, "the quick brown fox jumps over the lazy dog", "en", "b", 43),
    (None, None, None, None, None),
    (None, "no other document says this sentence here", "en", "b", 41),
    (5, LONG, "en", "c", len(LONG)),
    (6, "a" * 20_000, "en", "c", 20_000),
    (7, " \t\n\x0b\x0c\r\u00a0\u2003x\u00a0y", "en", "c", 10),
    (8, "one", "en", "c", 3),
    (9, "x\n\n\n", "fr", "", 4),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
