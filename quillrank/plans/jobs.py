"""Whole jobs from files to files: encode, search, evaluate, mine, rerank, build training shards.

Every job reads folders or files and writes folders of part files; only small reports come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import block_index, blocks, metrics, mining, rerank, search, sparse, text_rows, trainset
from quillrank.session import settled
from quillrank.sources import readers, writers


def term_statistics(corpus: DataFrame, tokenizer=tx.LEXICAL) -> tuple[DataFrame, int]:
    """Document frequencies, stored once, and the number of documents; corpus rows are (docid, title, text)."""
    rows = _corpus_texts(corpus)
    return settled(sparse.document_frequencies(rows, tokenizer), "frequencies"), corpus.count()


def _corpus_texts(corpus: DataFrame) -> DataFrame:
    title = F.col("title") if "title" in corpus.columns else None
    return corpus.select(F.col("docid").alias("id"), tx.passage_text(title, F.col("text")).alias("text"))


def _finish(weights: DataFrame, ids: DataFrame, max_terms: int | None, whole: bool, pad: str) -> DataFrame:
    kept = weights if max_terms is None else sparse.top_terms(weights, max_terms)
    kept = sparse.quantise(kept) if whole else sparse.positive_weights(kept)
    return sparse.fill_empty(kept, ids, pad)


def encode_corpus(
    corpus: DataFrame, statistics: tuple[DataFrame, int], out: str, max_terms: int | None = None, whole: bool = False, pad: str = "[PAD]", tokenizer=tx.LEXICAL
) -> None:
    """Corpus rows to JSON lines of sparse vectors, with the built-in lexical encoder."""
    rows = _corpus_texts(corpus)
    weights = sparse.lexical_weights(rows, *statistics, tokenizer)
    writers.write_lines(writers.corpus_lines(sparse.to_vectors(_finish(weights, rows, max_terms, whole, pad))), out)


def encode_queries(
    queries: DataFrame, statistics: tuple[DataFrame, int], out: str, max_terms: int | None = None, whole: bool = False, pad: str = "[PAD]", tokenizer=tx.LEXICAL
) -> None:
    """Query rows to lines of sparse vectors: JSON for float weights, repeated terms for whole ones."""
    rows = queries.select(F.col("query_id").alias("id"), F.col("query").alias("text"))
    frequencies, n_docs = statistics
    weights = sparse.lexical_weights(rows, sparse.frequencies_for(rows, frequencies, tokenizer), n_docs, tokenizer)
    vectors = sparse.to_vectors(_finish(weights, rows, max_terms, whole, pad))
    writers.write_lines(writers.query_lines(vectors, repeated=whole), out)


def encode_with_model(
    texts: DataFrame, encoder, out: str, pooling: str = "max", max_terms: int | None = None, whole: bool = False, pad: str = "[PAD]", tokenizer=tx.LEXICAL
) -> None:
    """Rows (id, text) through a model put in as a batch function, pooled and cut in the batch, written as JSON lines.

    `tokenizer` is the model's: it counts the tokens that the mean is over and says which place is the last.
    """
    weights = sparse.encode_pooled(texts, encoder, pooling, max_terms, tokenizer)
    writers.write_lines(writers.corpus_lines(sparse.to_vectors(_finish(weights, texts, None, whole, pad))), out)


def merge_encodings(spark: SparkSession, shards: str, out: str, files: int | None = None) -> None:
    """All shards of a folder as one set of lines."""
    writers.write_lines(spark.read.text(shards, recursiveFileLookup=True), out, files)


def retrieve_from_files(
    spark: SparkSession,
    corpus_files: readers.Paths,
    query_file: readers.Paths,
    out: str,
    top_k: int = 100,
    index: str | None = None,
    rebuild: bool = False,
    query_cut: int | None = None,
    block_postings: int = blocks.BLOCK_POSTINGS,
) -> dict[str, int]:
    """Encoded corpus and queries to a rank file; gives the numbers of lines that could not be read.

    With an index path the postings are stored there in blocks and used again, with the number of bad lines they had;
    without, they are read for this search only. A query cut searches by candidates.
    """
    asked, bad_queries = readers.read_sparse_queries(spark, query_file)
    query_terms = settled(sparse.to_postings(asked), "query_terms")
    stored = None if index is None else block_index.BlockIndex(spark, index, block_postings)
    if stored is None or rebuild or not stored.version():
        vectors, bad = readers.read_sparse_corpus(spark, corpus_files)
        bad_documents = bad.count()
        postings = sparse.to_postings(vectors)
        if stored is not None:
            stored.rebuild(settled(postings, "postings"), bad_documents)
    if stored is not None:
        found, bad_documents = stored.search(query_terms, top_k, query_cut), stored.bad_lines()
    elif query_cut is None:
        found = search.sparse_topk(postings, query_terms, top_k)
    else:
        found = search.sparse_topk_cut(postings, query_terms, top_k, query_cut)
    ranked = found.select("qid", "docid", "rank").orderBy("qid", "rank")
    writers.write_lines(ranked.select(F.concat_ws("\t", "qid", "docid", F.col("rank").cast("string")).alias("value")), out)
    return {"bad_queries": bad_queries.count(), "bad_documents": bad_documents}


def evaluate_ranks(spark: SparkSession, rank_file: str, bundle_path: str, dataset: str, ks=(10, 100)) -> DataFrame:
    """A rank file against the judgments of a dataset."""
    qrels = readers.read_bundle(spark, bundle_path, dataset)["qrels"]
    return metrics.evaluate(readers.read_ranks(spark, rank_file), qrels, ks)


def search_vectors(spark: SparkSession, query_vectors: str, passage_vectors: readers.Paths, out: str, depth: int = 1000) -> None:
    """Stored query vectors against all shards of passage vectors, to a run file."""
    queries = readers.read_vectors(spark, query_vectors)
    writers.write_run(settled(search.dense_topk(queries, readers.read_vectors(spark, passage_vectors), depth), "run"), out)


def reduce_run_files(spark: SparkSession, runs: readers.Paths, out: str, depth: int = 100) -> dict[str, int]:
    """Run files of several shards to the best `depth` per query; gives the number of lines that could not be read."""
    found, bad = readers.read_run(spark, runs)
    writers.write_run(settled(search.reduce_runs([found], depth), "run"), out)
    return {"bad_lines": bad.count()}


def mine_negatives(
    spark: SparkSession, train: DataFrame, corpus: DataFrame, run_file: readers.Paths, out: str, depth: int = 100, min_negatives: int = 1, by_answer: bool = False, regex: bool = False
) -> dict[str, int]:
    """Judged rows and their mined copies, as JSON lines; gives the number of run lines that could not be read."""
    found, bad = readers.read_run(spark, run_file)
    if by_answer:
        mined = mining.answer_negatives(train, found, corpus, depth, regex)
    else:
        mined = mining.basic_negatives(train, found, corpus, depth)
    mining.with_mined(train, mined, min_negatives).write.mode("overwrite").json(out)
    return {"bad_lines": bad.count()}


def prepare_rerank(spark: SparkSession, run_file: readers.Paths, queries: DataFrame, corpus: DataFrame, out: str, depth: int = 1000) -> dict[str, int]:
    """A run with both texts, as JSON lines; gives the number of run lines that could not be read."""
    found, bad = readers.read_run(spark, run_file)
    rerank.rerank_input(found, queries, corpus, depth).write.mode("overwrite").json(out)
    return {"bad_lines": bad.count()}


def rerank_file(spark: SparkSession, pairs: str, score: Column, out: str) -> None:
    """Rerank input to a run file, by a score column over query, title and text."""
    rows = spark.read.schema("query_id string, query string, docid string, title string, text string, score float").json(pairs)
    writers.write_run(settled(rerank.rerank(rows, score), "run"), out)


def training_shards(
    spark: SparkSession, run_file: readers.Paths, qrels: DataFrame, queries: DataFrame, corpus: DataFrame, out: str, depth: int = 200, n_sample: int = 30, seed: int = 0, max_len: int = 128, shard_rows: int = 45_000
) -> dict[str, int]:
    """Ranked negatives to token arrays, in JSON shards; gives the number of run lines that could not be read."""
    found, bad = readers.read_run(spark, run_file)
    negatives = settled(mining.ranked_negatives(found, qrels, depth, n_sample, seed), "negatives")
    rows = mining.assemble_examples(negatives, qrels, queries, corpus, max_len)
    writers.write_json_shards(rows.select("query", "positives", "negatives"), out, shard_rows)
    return {"bad_lines": bad.count()}


def pack_texts(texts: DataFrame, order: list[str], length: int, out: str, group_rows: int = 1000, tokenizer=tx.WORDS) -> None:
    """Texts to packed token chunks, in Parquet."""
    rows = texts.select(*order, tokenizer.one(F.col("text")).alias("tokens"))
    trainset.pack_tokens(rows, order, length, group_rows).write.mode("overwrite").parquet(out)


def tokenise_corpus(corpus: DataFrame, out: str, max_len: int = 256, shards: int | None = None, **options) -> None:
    """Corpus rows to tokenised JSON lines."""
    rows = text_rows.corpus_rows(corpus, max_len, **options)
    if shards is None:
        rows.write.mode("overwrite").json(out)
    else:
        writers.write_json_splits(rows, out, shards, "text_id")
