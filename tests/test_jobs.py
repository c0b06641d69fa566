"""File-to-file jobs over the smallest tables, against the operators they are made of."""

import pytest
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import search
from quillrank.operators.plugins import pair_scorer
from quillrank.plans import jobs, tables
from quillrank.session import fresh_path
from quillrank.sources import readers, writers


@pytest.fixture(scope="module")
def encoded(spark, sf_dir):
    corpus, queries = tables.corpus(spark, sf_dir), tables.queries(spark, sf_dir)
    statistics = jobs.term_statistics(corpus)
    paths = {n: fresh_path(spark, n) for n in ("corpus", "queries", "index", "ranks")}
    jobs.encode_corpus(corpus, statistics, paths["corpus"], whole=True)
    jobs.encode_queries(queries, statistics, paths["queries"], max_terms=128, whole=True)
    return paths


def pairs(df):
    return sorted((r["qid"], r["docid"], r["rank"]) for r in df.collect())


def test_encode_and_retrieve_equal_the_run(spark, sf_dir, encoded):
    wanted = pairs(tables.run(spark, sf_dir).where("rank <= 20"))
    for index in (None, encoded["index"], encoded["index"]):
        out = fresh_path(spark, "ranks")
        bad = jobs.retrieve_from_files(spark, encoded["corpus"], encoded["queries"], out, 20, index=index, block_postings=20_000)
        assert bad == {"bad_queries": 0, "bad_documents": 0}
        assert pairs(readers.read_ranks(spark, out)) == wanted
    out = fresh_path(spark, "ranks")
    jobs.retrieve_from_files(spark, encoded["corpus"], encoded["queries"], out, 20, query_cut=10_000)
    assert pairs(readers.read_ranks(spark, out)) == wanted


def test_merge_keeps_every_line(spark, encoded):
    out = fresh_path(spark, "merged")
    jobs.merge_encodings(spark, encoded["corpus"], out, files=1)
    lines = lambda p: sorted(r["value"] for r in spark.read.text(p).collect())
    assert lines(out) == lines(encoded["corpus"])


def test_evaluate_ranks(spark, sf_dir, encoded):
    base, out = fresh_path(spark, "bundle"), fresh_path(spark, "ranks")
    tables.corpus(spark, sf_dir).withColumnRenamed("docid", "_id").write.json(f"{base}/msmarco/corpus.jsonl")
    tables.queries(spark, sf_dir).toDF("_id", "text").write.json(f"{base}/msmarco/queries.jsonl")
    tables.qrels(spark, sf_dir).select("qid", "docid", "rel").write.csv(f"{base}/msmarco/qrels/dev.tsv", sep="\t", header=True)
    jobs.retrieve_from_files(spark, encoded["corpus"], encoded["queries"], out)
    row = jobs.evaluate_ranks(spark, out, base, "msmarco").first()
    assert row["queries"] == tables.qrels(spark, sf_dir).select("qid").distinct().count() and 0.5 < row["recall_at_100"] <= 1


def test_vector_search_and_reduce(spark, sf_dir):
    rows = tables.vectors(spark, sf_dir).select("id", "embedding")
    stored, run, out = (fresh_path(spark, n) for n in ("vectors", "run", "reduced"))
    writers.write_vectors(rows, stored)
    jobs.search_vectors(spark, stored, stored, run, 5)
    jobs.reduce_run_files(spark, run, out, 3)
    got = sorted((r["qid"], r["docid"]) for r in readers.read_run(spark, out)[0].collect())
    assert got == sorted((r["qid"], r["docid"]) for r in search.dense_topk(rows, rows, 3).collect())


def test_mining_rerank_and_training_jobs(spark, sf_dir):
    corpus, queries, qrels = tables.corpus(spark, sf_dir), tables.queries(spark, sf_dir), tables.qrels(spark, sf_dir)
    run_file, mined, pairs_file, reranked, shards = (fresh_path(spark, n) for n in ("run", "mined", "pairs", "reranked", "shards"))
    writers.write_run(tables.run(spark, sf_dir), run_file)
    train = tables.judged(spark, sf_dir)
    jobs.mine_negatives(spark, train, corpus, run_file, mined, depth=20)
    rows = readers.read_training(spark, mined)
    assert rows.count() == 2 * train.where(F.size("positive_passages") > 0).count()
    jobs.mine_negatives(spark, train, corpus, run_file, fresh_path(spark, "mined"), by_answer=True)
    jobs.prepare_rerank(spark, run_file, queries, corpus, pairs_file, 4)
    score = pair_scorer(lambda qs, ps: [float(len(p)) for p in ps])
    jobs.rerank_file(spark, pairs_file, score(F.col("query"), F.col("text")), reranked)
    assert readers.read_run(spark, reranked)[0].count() == 4 * queries.count()
    jobs.training_shards(spark, run_file, qrels, queries, corpus, shards, n_sample=3)
    schema = "query array<string>, positives array<array<string>>, negatives array<array<string>>"
    examples = spark.read.schema(schema).json(shards).collect()
    assert examples and all(len(r["negatives"]) == 3 and len(r["positives"]) >= 1 for r in examples)


def test_text_jobs_and_model_encoding(spark, sf_dir):
    from quillrank.plans.sparse_queries import word_length_encoder

    packed, tokens, model = (fresh_path(spark, n) for n in ("packed", "tokens", "model"))
    jobs.pack_texts(tables.documents(spark, sf_dir), ["doc_id"], 64, packed)
    assert all(len(r["tokens"]) == 64 for r in spark.read.parquet(packed).collect())
    corpus = tables.corpus(spark, sf_dir)
    jobs.tokenise_corpus(corpus, tokens, 16, shards=3)
    assert spark.read.schema("text_id string, text array<string>").json(tokens).count() == corpus.count()
    texts = tables.encoder_docs(spark, sf_dir)
    for pooling in ("max", "mean", "last"):
        jobs.encode_with_model(texts, word_length_encoder, f"{model}-{pooling}", pooling, max_terms=8)
        good, bad = readers.read_sparse_corpus(spark, f"{model}-{pooling}")
        assert good.count() == corpus.count() and bad.count() == 0
        assert good.agg(F.max(F.size("vector"))).first()[0] <= 8
    assert tx.LEXICAL is not tx.WORDS
