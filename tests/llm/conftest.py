import pytest

from pyspark.sql import functions as F

#: Nulls in any column, empty, blank and very long texts, ties, repeated rows.
LONG = " ".join(f"word{i % 977} tail{i}" for i in range(20_000))
ODD = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "one two three", "en", "a"),
       (4, "one two three", "en", "a"), (None, "one two three", None, "b"), (5, LONG, "en", "b"),
       (6, LONG, "en", "b"), (7, "é ß 😀 ñ\n\nÀ la", "fr", "c"), (None, None, None, None)]


@pytest.fixture
def documents(spark):
    """A table of documents from texts or rows; more columns, with names the operators use."""
    def make(rows, clash=True):
        rows = [r if isinstance(r, tuple) else (i, r, "en", "s") for i, r in enumerate(rows, 1)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
        df = df.withColumn("n_chars", F.length("text").cast("bigint"))
        if clash:
            for name in ("key", "h", "a", "b", "n", "start", "words", "first", "drop", "fp", "row_id",
                         "row_key", "score", "places", "spans", "lang_pred"):
                df = df.withColumn(name, F.lit("x"))
        return df
    return make


@pytest.fixture
def odd(documents):
    return documents(ODD)
