import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]), with the columns of the table."""

    def make(rows):
        full = [(*r, *([None] * (4 - len(r)))) for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCUMENT)

    return make


@pytest.fixture(scope="session")
def odd():
    """Rows that any operator must take: nulls, empty, long, repeated, and odd texts."""
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    return [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "One two three", "en", "b"), (5, long, "en", "b"), (6, long, "en", "a"),
        (7, "Same row", "de", "c"), (7, "Same row", "de", "c"), (None, "No id here", "fr", "c"), (None, None, None, None), (8, "é ü 日本   \x1c $$$ 123", "fr", "a"), (9, "x" * 70_000, "es", "a"),
    ]
