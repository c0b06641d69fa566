"""Cases of the third round of findings."""

import pytest
from pyspark.sql import functions as F

from quillrank.plans.registry import QUERIES
from quillrank.session import fresh_path
from quillrank.streaming import incremental


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_table_of_several_files_is_streamed(spark, sf_dir):
    """A table may be one file or a folder of part files."""
    import quillrank.plans  # noqa: F401

    base = fresh_path(spark, "tables")
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.parquet(f"{base}/documents.parquet")
    encode = QUERIES["t1_incremental_encode"]
    assert rows_of(encode(spark, base)) == rows_of(encode(spark, sf_dir)) != []


@pytest.mark.parametrize("kind", ["file", "folder"])
def test_stream_of_a_file_or_a_folder(spark, kind):
    base = fresh_path(spark, "arriving")
    spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string").coalesce(1).write.parquet(base)
    path = base
    if kind == "file":
        path = next(r["f"] for r in spark.read.parquet(base).select(F.input_file_name().alias("f")).collect())
    out, marks = fresh_path(spark, "encoded"), fresh_path(spark, "marks")
    texts = incremental.arriving_texts(spark, path, "id string, text string")
    incremental.encode_stream(texts, lambda batch: batch, out, marks).awaitTermination()
    assert rows_of(incremental.read_encoded(spark, out).select("id", "text")) == [("a", "x"), ("b", "y")]


def test_encoders_get_pieces_of_bounded_size(spark):
    """Activations of a whole Arrow batch at once took gigabytes."""
    import pandas as pd

    from quillrank.operators import sparse

    def encoder(batch):
        assert len(batch) == 1 or batch["text"].str.len().sum() <= sparse.ENCODED_CHARS
        rows = [(i, p, w, len(batch) * 0 + 1.0) for i, x in zip(batch["id"], batch["text"]) for p, w in enumerate(x.split(" "))]
        return pd.DataFrame(rows, columns=["id", "pos", "term", "logit"])

    texts = [(str(i), "ab cd " * 20_000 + "ef") for i in range(9)] + [("big", "x" * 600_000)]
    rows = spark.createDataFrame(texts, "id string, text string").coalesce(1)
    assert sparse.encode_batches(rows, encoder).count() == 9 * 40_001 + 1
    assert sparse.encode_pooled(rows, encoder).count() == 9 * 3 + 1


def test_plugged_tokenizer_gets_pieces_of_bounded_size(spark):
    from quillrank.functions import text as tx
    from quillrank.operators import plugins

    def split(texts):
        assert len(texts) == 1 or sum(map(len, texts[:-1])) < tx.TOKENIZED_CHARS
        return [x.split() for x in texts]

    words = plugins.tokenizer(split)
    rows = spark.createDataFrame([(i, "ab cd " * 20_000 if i % 4 else None) for i in range(12)], "i int, text string").coalesce(1)
    found = rows.select(F.size(words.one(F.col("text"))).alias("n"))
    assert sorted(r["n"] for r in found.collect()) == [0] * 3 + [40_000] * 9
    lists = spark.createDataFrame([(["a b", None, "c"],), (None,), ([],), (["d"],)], "x array<string>").coalesce(1)
    assert [r[0] for r in lists.select(words.many(F.col("x"))).collect()] == [[["a", "b"], [], ["c"]], [], [], [["d"]]]


def test_stream_of_versions_holds_no_state(spark):
    """A Python call for each document and a state store in memory took hours."""
    from quillrank.streaming import running

    base, out, marks = (fresh_path(spark, n) for n in ("arriving", "followed", "marks"))
    schema = "id string, version long, text string"
    for shard in ([("a", 1, "x y"), ("b", 2, "x")], [("a", 2, "y z"), ("b", 1, "q"), ("c", 1, "")]):
        spark.createDataFrame(shard, schema).coalesce(1).write.mode("append").parquet(base)
        running.follow_stream(incremental.arriving_texts(spark, base, schema), out, marks).awaitTermination()
    assert rows_of(running.statistics(spark, out)[0]) == [("x", 1), ("y", 1), ("z", 1)]
    assert running.statistics(spark, out)[1] == 3
    state = spark._jvm.org.apache.hadoop.fs.Path(f"{marks}/state")
    assert not state.getFileSystem(spark._jsc.hadoopConfiguration()).exists(state)


def test_a_small_mini_batch_is_one_stage(spark, monkeypatch):
    """A shuffle and eight files for each batch of some hundred vectors took seconds per batch."""
    import numpy as np

    from quillrank.operators import evaluation

    rng = np.random.default_rng(1)
    rows = [(str(i), [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(4)
    paths = []
    monkeypatch.setattr(evaluation, "fresh_path", lambda s, n: paths.append(fresh_path(s, n)) or paths[-1])
    centers = evaluation.minibatch_centers(df, 2, batch_rows=30, epochs=1)
    assert centers.shape == (2, 3)
    assert len(spark.read.parquet(paths[0]).inputFiles()) == 2
    sums, counts = evaluation._nearest_sums(df, np.array([[0.0, 0.0, 0.0]]))
    assert counts.tolist() == [60] and np.allclose(sums[0], np.sum([r[1] for r in rows], axis=0))


def test_a_product_meets_a_bounded_number_of_documents(monkeypatch):
    """A block of queries against all documents of a cell at once took gigabytes."""
    import numpy as np
    import pandas as pd

    from quillrank.operators import search

    rng = np.random.default_rng(2)
    docs = pd.DataFrame({"id": [f"{i:03d}" for i in range(50)], "embedding": list(rng.integers(0, 3, (50, 4)).astype(float))})
    queries = rng.integers(0, 3, (6, 4)).astype(float)
    widths = []

    class Watched(search._Best):
        def add(self, rows, scores, ids):
            widths.append(scores.shape[1])
            super().add(rows, scores, ids)

    monkeypatch.setattr(search, "DOC_BLOCK", 8)
    best = Watched(6, 5)
    search._score_batch(best, np.arange(6), queries, docs.sample(frac=1, random_state=3))
    assert max(widths) <= 8
    scores = queries @ np.stack(docs["embedding"]).T
    for q in range(6):
        order = np.lexsort((np.arange(50), -scores[q]))[:5]
        assert sorted(best.ids[q]) == sorted(docs["id"].iloc[order])


def test_buckets_of_an_index_grow_with_its_postings(spark, monkeypatch):
    from quillrank.operators import search

    monkeypatch.setattr(search, "BUCKET_POSTINGS", 10)
    rows = spark.createDataFrame([(str(i), f"t{i % 3}", 1) for i in range(55)], "id string, term string, weight int")
    path = fresh_path(spark, "index")
    assert rows_of(search.write_index(rows, path, 2)) == rows_of(rows)
    assert spark.read.parquet(f"{path}/facts").first()["buckets"] == 6


@pytest.mark.parametrize("common", [0, 1, 2, 9])
@pytest.mark.parametrize("every", [True, False])
def test_only_rare_terms_of_a_large_vocabulary_are_shuffled(spark, monkeypatch, common, every):
    from quillrank.operators import placement, sparse

    docs = spark.createDataFrame([("a", "x y x q"), ("b", "x z"), ("c", ""), (None, "y w"), ("a", "x")], "id string, text string")
    df = spark.createDataFrame([("x", 3), ("y", 2), ("z", 1), ("v", None), (None, 5)], "term string, df long")
    want = rows_of(sparse.lexical_activations(docs, df, 5, every_position=every, frequencies_fit=True))
    monkeypatch.setattr(placement, "BROADCAST_ROWS", common)
    met = []
    joined = sparse.spread_join
    monkeypatch.setattr(sparse, "spread_join", lambda left, *a, **k: met.append(left.count()) or joined(left, *a, **k))
    assert rows_of(sparse.lexical_activations(docs, df, 5, every_position=every, frequencies_fit=False)) == want
    assert (met[0] < len(want)) == (common > 1)


def test_vectors_of_shards_are_made_once(spark, sf_dir, monkeypatch):
    """Each of the five shards grouped all postings again."""
    from quillrank.operators import sparse
    from quillrank.plans import source_queries

    base = fresh_path(spark, "tables")
    rows = [(1, "b a", "en"), (2, "a", "de"), (3, "c a", None), (4, "d", "it")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).write.parquet(f"{base}/documents.parquet")
    made = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: made.add(1) or x, "string").asNondeterministic()
    monkeypatch.setattr(source_queries, "_vectors", lambda s, d: sparse.to_vectors(source_queries.t.doc_postings(s, d)).withColumn("id", count("id")))
    assert rows_of(QUERIES["s7_shard_merge"](spark, base).select("id")) == [("1",), ("2",), ("3",), ("4",)]
    assert made.value <= 8
