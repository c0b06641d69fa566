"""Cases of the findings of the third round that were open."""

import pytest
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import blocks, sparse
from quillrank.session import fresh_path


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_cut_at_what_lies_between(spark):
    texts = ["", " ", "a", ",a b", "a  b,", "Äß-x٣ýz", "日本 語。", "x y\nz\x00w", "12½ 𝒜b_c", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    taken = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(tx.WORD_PATTERN), F.lit(0))
    words = rows.select(tx.word_tokens(F.col("text")).alias("a"), taken.alias("b"), F.col("text"))
    assert all(r["a"] == r["b"] for r in words.collect())
    assert "regexp_extract_all" not in plan_of(rows.select(tx.word_tokens(F.col("text"))))


@pytest.mark.parametrize("repeated", [False, True])
def test_postings_are_filled_without_a_join_of_all(spark, repeated):
    ids = [("a",), ("b",), ("c",), (None,), (None,)] + [("a",), ("c",)] * repeated
    ids = spark.createDataFrame(ids, "id string")
    postings = [("a", "x", 1), ("a", "y", 2), ("b", "x", 3), (None, "x", 4)] + [("a", "x", 1), ("a", "y", 2)] * repeated
    postings = spark.createDataFrame(postings, "id string, term string, weight int")
    path = fresh_path(spark, "filled")
    sparse.write_filled(postings, ids, path)
    assert rows_of(spark.read.parquet(path)) == rows_of(sparse.fill_empty(postings, ids)) != []


def test_blocks_are_made_without_a_sort_of_postings(spark):
    rows = [(f"d{i}", f"t{j}", 1 + (i * j) % 7) for i in range(40) for j in range(5)] + [("d0", "t0", 5), (None, "t0", 1)]
    postings = spark.createDataFrame(rows, "id string, term string, weight int")
    packed = blocks.pack(postings, 20)
    assert "Sort" not in plan_of(packed)
    assert packed.count() == packed.select("block").distinct().count() > 1
    summed = postings.dropna().groupBy("id", "term").agg(F.sum("weight").alias("weight"))
    assert rows_of(blocks.unpack(packed)) == rows_of(summed)


def test_top_terms_of_pooled_rows_take_one_shuffle(spark):
    rows = [(f"d{i}", i, f"t{j}", float(j % 4)) for i in range(6) for j in range(9)]
    active = spark.createDataFrame(rows + rows[:9], "id string, pos long, term string, logit double")
    top = sparse.top_terms(sparse.pool_max(active, by_row=True), 3)
    assert plan_of(top).count("Exchange hashpartitioning") == 1
    assert rows_of(top) == rows_of(sparse.top_terms(sparse.pool_max(active), 3))


def test_terms_of_a_vocabulary_that_does_not_fit_are_not_stored(spark, monkeypatch):
    from quillrank.operators import placement

    monkeypatch.setattr(placement, "BROADCAST_ROWS", 2)
    docs = spark.createDataFrame([("1", "a b c"), ("2", "a b d"), ("3", "a e a")], "id string, text string")
    known = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1), ("d", 1)], "term string, df long")
    monkeypatch.setattr(sparse, "settled", lambda *_: pytest.fail("stored"))
    large = sparse.lexical_activations(docs, known, 3, frequencies_fit=False)
    assert rows_of(large) == rows_of(sparse.lexical_activations(docs, known, 3, frequencies_fit=True))


def test_words_of_pieces_are_cut_at_markers():
    import public_tokenizers

    from quillrank.llm import piece_codec

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        codec = piece_codec.Codec(f.read(), 1)
    texts = ["", " ", "a", " a", "a ", "a  b", "a b\nc", "▁", "a▁b", "  a   b  ", "\t x", "Ä ß", "a b " * 3]
    for text in texts:
        normal = codec._normal(text)
        assert codec._words(normal) == codec.cut.findall(normal)
    ids, parity, back = codec.encode(texts)
    whole = codec.encode_whole(texts)
    assert ids == whole[0] and back == [a and "▁" not in t for a, t in zip(whole[2], texts)]
    assert codec.encode(texts) == (ids, parity, back)
