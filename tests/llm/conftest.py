import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside.
        T.StructField("id", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("n_tokens", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with inner ones."""

    def make(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, None if t is None else len(t), "x", "y", "z") for i, t, s in zip(ids, texts, sources)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def make_vectors(spark):
    def make(rows):
        return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vec string, id string")

    return make
