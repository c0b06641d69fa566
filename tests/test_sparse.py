import math

import pytest
from pyspark.sql import functions as F

from quillrank.operators import sparse

POSTINGS = "id string, term string, weight double"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def active(spark):
    data = [("a", 0, "x", 2.0), ("a", 1, "x", 3.0), ("a", 1, "y", -1.0), ("a", 2, "y", 1.0), ("b", 0, "x", -4.0)]
    return spark.createDataFrame(data, sparse.ACTIVATIONS)


def test_pooling(spark, active):
    close = lambda df: {(r["id"], r["term"]): round(r["weight"], 9) for r in df.collect()}
    log = lambda x: round(math.log1p(x), 9)
    assert close(sparse.pool(active, "max")) == {("a", "x"): log(3), ("a", "y"): log(1), ("b", "x"): 0.0}
    assert close(sparse.pool(active, "last")) == {("a", "y"): log(1), ("b", "x"): 0.0}
    sizes = spark.createDataFrame([("a", 4), ("b", 0)], "id string, n_tokens int")
    assert close(sparse.pool(active, "mean", sizes)) == {("a", "x"): log(5 / 4), ("a", "y"): 0.0, ("b", "x"): 0.0}
    with pytest.raises(ValueError):
        sparse.pool(active, "sum")


def test_top_terms_breaks_ties_by_term(spark):
    rows = spark.createDataFrame([("a", "z", 1.0), ("a", "y", 1.0), ("a", "x", 0.5), ("b", "q", 1.0)], POSTINGS)
    assert rows_of(sparse.top_terms(rows, 1)) == [("a", "y", 1.0), ("b", "q", 1.0)]


def test_quantise_rounds_half_to_even_and_up(spark):
    rows = spark.createDataFrame([("a", "p", 0.005), ("a", "q", 0.015), ("a", "r", 0.025), ("a", "s", -1.0)], POSTINGS)
    assert rows_of(sparse.quantise(rows)) == [("a", "q", 2), ("a", "r", 2)]
    assert rows_of(sparse.quantise(rows, "ceil")) == [("a", "p", 1), ("a", "q", 2), ("a", "r", 3)]


def test_cap_before_rounding_can_leave_fewer_terms(spark):
    rows = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 0.004), ("a", "r", 0.003)], POSTINGS)
    assert rows_of(sparse.quantise(sparse.top_terms(rows, 2))) == [("a", "p", 100)]


def test_empty_vectors_get_a_pad_term(spark):
    rows = spark.createDataFrame([("a", "p", 0.0), ("b", "q", 0.5)], POSTINGS)
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert rows_of(sparse.fill_empty(sparse.quantise(rows), ids)) == [("a", "[PAD]", 1), ("b", "q", 50), ("c", "[PAD]", 1)]
    assert rows_of(sparse.fill_empty(sparse.positive_weights(rows), ids)) == [("a", "[PAD]", 1.0), ("b", "q", 0.5), ("c", "[PAD]", 1.0)]


def test_scatter_max_leaves_out_special_ids(spark):
    rows = spark.createDataFrame([("a", 101, 9.0), ("a", 7, 1.0), ("a", 7, 2.0), ("a", 8, -1.0)], "id string, term_id int, weight double")
    assert rows_of(sparse.scatter_max(rows)) == [("a", 7, 2.0)]


def test_names_drop_unknown_ids(spark):
    rows = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 1.0)], "id string, term_id int, weight double")
    assert rows_of(sparse.name_terms(rows, spark.createDataFrame([(1, "x")], "term_id int, term string"))) == [("a", "x", 9.0)]


def test_l2_and_report(spark):
    rows = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 4.0), ("b", "x", 0.0)], POSTINGS)
    assert rows_of(sparse.l2_normalise(rows)) == [("a", "x", 0.6), ("a", "y", 0.8), ("b", "x", 0.0)]
    report = sparse.sparsity_report(rows, 2).first()
    assert (report["flops"], report["active_terms"], report["terms"]) == (1.5**2 + 2.0**2, 1.0, 2)


def test_lexical_weights_equal_pooled_activations(spark):
    docs = spark.createDataFrame([("a", "One two one"), ("b", "two"), ("c", "")], "id string, text string")
    df = sparse.document_frequencies(docs)
    pooled = sparse.pool_max(sparse.lexical_activations(docs, df, 3))
    assert rows_of(sparse.lexical_weights(docs, df, 3)) == rows_of(pooled)
    assert rows_of(df) == [("one", 1), ("two", 2)]
    shuffled = sparse.lexical_activations(docs, df, 3, frequencies_fit=False)
    assert rows_of(shuffled) == rows_of(sparse.lexical_activations(docs, df, 3))


def test_vectors_and_repeated_tokens(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "id string, term string, weight int")
    vectors = sparse.to_vectors(rows)
    assert vectors.first()["vector"] == {"y": 2, "x": 1}
    assert sparse.repeated_tokens(vectors).first()["tokens"] == "y y x"
    assert rows_of(sparse.to_postings(vectors)) == rows_of(rows)
