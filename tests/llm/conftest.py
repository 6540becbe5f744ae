import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        *[T.StructField(n, T.StringType()) for n in ("id", "sig", "digest", "run", "p", "rows", "size", "kept", "text_key", "x", "y", "score", "path", "block")],
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """(id, text[, source]) rows as a ``documents`` table with extra columns of clashing names."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), *["clash"] * (len(SCHEMA) - 5)) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows."""
    long = "Sentence number one goes here and on. " * 4000
    return [
        (1, "Alpha beta gamma delta epsilon zeta."), (2, "alpha BETA gamma delta epsilon zeta."), (2, "alpha BETA gamma delta epsilon zeta."),
        (3, None), (4, ""), (5, " \n\t "), (None, "no id here at all, none"), (None, "no id here at all, none"), (6, long), (7, long + "tail"),
        (8, "É é Straße\x00nul 日本 😀"), (9, "é É Straße\x00nul 日本 😀"), (10, "one two"), (11, "ONE two"), (12, "x" * 50000),
    ]
