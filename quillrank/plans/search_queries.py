"""Search, run merging, reranking and lookup joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.operators import block_index, blocks, cells, evaluation, plugins, rerank, search
from quillrank.plans import tables as t
from quillrank.plans.registry import part, query, using
from quillrank.session import fresh_path
from quillrank.sources import readers, writers


def _out(found):
    return found.select("qid", "docid", "score", F.col("rank").cast("long").alias("rank"))


@query("j1_sparse_topk", using("SELECT qid, docid, score, rank FROM run", "run"))
def _(spark, d):
    return _out(blocks.topk(t.doc_blocks(spark, d), t.query_postings(spark, d), t.DEPTH))


@query(
    "j2_sparse_topk_cut",
    using(
        "SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM scores SEMI JOIN "
        "(SELECT DISTINCT c.id AS qid, p.id AS docid FROM (SELECT id, term FROM query_post "
        "QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) <= 10) c JOIN doc_post p USING (term)) USING (qid, docid) "
        "QUALIFY rank <= 20",
        "scores",
    ),
)
def _(spark, d):
    return _out(blocks.topk(t.doc_blocks(spark, d), t.query_postings(spark, d), 20, query_cut=10))


@query("j4_stored_index", using("SELECT qid, docid, score, rank FROM run WHERE rank <= 10", "run"))
def _(spark, d):
    path = fresh_path(spark, "index")
    search.write_index(t.doc_postings(spark, d), path, buckets=8)
    index = search.open_index(spark, path)
    return _out(search.sparse_topk(index, t.query_postings(spark, d), 10, by_document=True))


@query(
    "j4_index_generations",
    using(
        "SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM ("
        "SELECT q.id AS qid, p.id AS docid, CAST(sum(q.weight * (p.weight + CASE WHEN lang = 'de' THEN 1 ELSE 0 END)) AS BIGINT) AS score "
        "FROM query_post q JOIN doc_post p USING (term) JOIN documents ON p.id = CAST(doc_id AS VARCHAR) "
        "WHERE lang IS DISTINCT FROM 'es' GROUP BY q.id, p.id) QUALIFY rank <= 20",
        "query_post",
        "doc_post",
    ),
)
def _(spark, d):
    """All documents, then a generation in which the German ones are replaced, then one without the Spanish ones."""
    index = block_index.BlockIndex(spark, fresh_path(spark, "index"))
    postings = t.doc_postings(spark, d)
    langs = t.documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), "lang")
    index.rebuild(postings)
    german = postings.join(langs.where("lang = 'de'"), "id", "left_semi")
    index.add(german.withColumn("weight", F.col("weight") + 1))
    index.delete(langs.where("lang = 'es'").select("id"))
    return _out(index.search(t.query_postings(spark, d), 20))


part("dense", "SELECT q.id AS qid, p.id AS docid, round(list_dot_product(q.e, p.e), 9) AS score FROM vec q, vec p", "vec")
part("dense_run", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM dense QUALIFY rank <= 10", "dense")


@query("j5_dense_topk", using("SELECT qid, docid, score, rank FROM dense_run", "dense_run"))
def _(spark, d):
    rows = t.vectors(spark, d)
    return _out(search.dense_topk(rows, rows, 10))


part(
    "centers",
    "SELECT label - 1 AS cell, list(v ORDER BY i) AS c FROM (SELECT dense_rank() OVER (ORDER BY label) AS label, i, v FROM "
    "(SELECT label, i, avg(e[i]) AS v FROM vec, generate_series(1, 64) g(i) WHERE label IS NOT NULL GROUP BY label, i)) GROUP BY label",
    "vec",
)
part(
    "cell_order",
    "SELECT id, cell, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(c, c) - 2 * list_dot_product(e, c), cell) AS nth FROM vec, centers",
    "vec",
    "centers",
)


@query(
    "j6_stored_cells",
    using(
        "SELECT d.qid, d.docid, d.score, row_number() OVER (PARTITION BY d.qid ORDER BY d.score DESC, d.docid) AS rank FROM dense d "
        "JOIN cell_order a ON a.id = d.docid AND a.nth = 1 JOIN cell_order b ON b.id = d.qid AND b.nth <= 3 AND b.cell = a.cell "
        "QUALIFY rank <= 10",
        "dense",
        "cell_order",
    ),
)
def _(spark, d):
    """Cells around the mean of each label, stored; every vector asks in its three nearest ones."""
    rows = t.vectors(spark, d)
    means = evaluation.pool_vectors(rows.where("label is not null").select(F.col("label").alias("id"), F.lit(0).alias("pos"), F.col("embedding").alias("vec")))
    centers = [r["embedding"] for r in means.orderBy("id").collect()]
    index = cells.CellIndex(spark, fresh_path(spark, "cells"))
    index.write(rows, centers)
    return _out(index.search(rows, 10, probes=3))


@query("j6_dense_topk_cells")
def _(spark, d):
    rows = t.vectors(spark, d)
    model = search.train_cells(rows, 16)
    celled = search.assign_cells(rows, model)
    return _out(search.dense_topk_cells(rows, celled, model.clusterCenters(), 10, probes=4))


@query("j6_every_cell", using("SELECT qid, docid, score, rank FROM dense_run", "dense_run"))
def _(spark, d):
    rows = t.vectors(spark, d)
    model = search.train_cells(rows, 8, iterations=5)
    celled = search.assign_cells(rows, model)
    return _out(search.dense_topk_cells(rows, celled, model.clusterCenters(), 10, probes=8))


@query(
    "j8_cosine_topk",
    using(
        "SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM "
        "(SELECT q.id AS qid, p.id AS docid, round(list_cosine_similarity(q.e, p.e), 9) AS score FROM vec q, vec p WHERE q.id <> p.id) "
        "QUALIFY rank <= 10",
        "vec",
    ),
)
def _(spark, d):
    rows = t.vectors(spark, d)
    return _out(search.cosine_topk(rows, rows, 10))


@query("j9_shard_reduce", using("SELECT qid, docid, score, rank FROM dense_run", "dense_run"))
def _(spark, d):
    rows = t.vectors(spark, d)
    low = F.coalesce(F.col("label") < 5, F.lit(False))
    shards = [rows.where(low), rows.where(~low)]
    return _out(search.reduce_runs([search.dense_topk(rows, s, 10) for s in shards], 10))


@query("j10_run_reduce", using("SELECT qid, docid, CAST(score AS DOUBLE) AS score, rank FROM run WHERE rank <= 20", "run"))
def _(spark, d):
    base = fresh_path(spark, "runs")
    langs = t.documents(spark, d).select(F.col("doc_id").cast("string").alias("docid"), "lang")
    run = t.run(spark, d).join(langs, "docid")
    writers.write_run(run.where("lang <=> 'en'"), f"{base}/a")
    writers.write_run(run.where("not (lang <=> 'en')"), f"{base}/b")
    parts, _bad = readers.read_run(spark, [f"{base}/a", f"{base}/b"])
    return _out(search.reduce_runs([parts], 20))


part("token_vec", "SELECT CAST(vec_id // 4 AS VARCHAR) AS id, vec_id % 4 AS pos, CAST(embedding AS DOUBLE[]) AS e FROM embeddings")
part(
    "text_vec",
    "SELECT id, list(v ORDER BY i) AS e FROM (SELECT id, i, avg(e[i]) AS v FROM token_vec, generate_series(1, 64) g(i) GROUP BY id, i) GROUP BY id",
    "token_vec",
)
part(
    "text_run",
    "SELECT q.id AS qid, p.id AS docid FROM text_vec q, text_vec p "
    "QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.e, p.e), 9) DESC, p.id) <= 10",
    "text_vec",
)


@query(
    "j11_maxsim",
    using(
        "SELECT qid, docid, round(sum(best), 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(sum(best), 9) DESC, docid) AS rank FROM "
        "(SELECT qid, docid, a.pos, greatest(max(list_dot_product(a.e, b.e)), 0) AS best FROM text_run JOIN token_vec a ON a.id = qid "
        "JOIN token_vec b ON b.id = docid GROUP BY qid, docid, a.pos) GROUP BY qid, docid",
        "text_run",
    ),
)
def _(spark, d):
    tokens = t.token_vectors(spark, d)
    texts = evaluation.pool_vectors(tokens, "mean").withColumn("embedding", F.col("embedding").cast("array<double>"))
    near = search.dense_topk(texts, texts, 10)
    matrices = t.token_matrices(spark, d)
    return _out(search.maxsim(near, matrices, matrices, padded=True))


@query(
    "j13_rerank_input",
    using(
        "SELECT qid AS query_id, query, docid, title, text, CAST(score AS DOUBLE) AS score FROM run JOIN queries ON qid = query_id "
        "JOIN corpus USING (docid) WHERE rank <= 20",
        "run",
        "queries",
        "corpus",
    ),
)
def _(spark, d):
    rows = rerank.rerank_input(t.run(spark, d), t.queries(spark, d), t.corpus(spark, d), 20)
    return rows.withColumn("score", F.col("score").cast("double"))


def shared_words(queries: list[str], passages: list[str]) -> list[float]:
    """A scorer to put in: words of the query that the passage has too, by blanks."""
    return [float(len(set(q.split(" ")) & set(p.split(" ")))) for q, p in zip(queries, passages)]


SHARED = "CAST(len(list_intersect(list_distinct(string_split(query, ' ')), list_distinct(string_split(text, ' ')))) AS DOUBLE)"


@query(
    "j14_rerank",
    using(
        f"SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM "
        f"(SELECT qid, docid, {SHARED} AS score FROM run JOIN queries ON qid = query_id JOIN corpus USING (docid) WHERE rank <= 50)",
        "run",
        "queries",
        "corpus",
    ),
)
def _(spark, d):
    pairs = rerank.rerank_input(t.run(spark, d), t.queries(spark, d), t.corpus(spark, d), 50)
    score = plugins.pair_scorer(shared_words)
    return _out(rerank.rerank(pairs, score(F.col("query"), F.col("text"))))


@query("j15_add_titles", using("SELECT docid, coalesce(title, '') AS title, text FROM corpus", "corpus"))
def _(spark, d):
    rows = t.corpus(spark, d)
    titles = rows.where(F.col("title").isNotNull()).select("docid", "title")
    return rerank.add_titles(rows.select("docid", "text"), titles).select("docid", "title", "text")


@query(
    "j16_negative_lists",
    using(
        "SELECT qid, CAST(0 AS BIGINT) AS part, string_agg(docid, ',' ORDER BY docid) AS negatives FROM run ANTI JOIN qrels USING (qid, docid) GROUP BY qid",
        "run",
        "qrels",
    ),
)
def _(spark, d):
    other = t.run(spark, d).join(t.qrels(spark, d), ["qid", "docid"], "left_anti")
    triples = other.select("qid", F.lit("").alias("positive"), F.col("docid").alias("negative"))
    return rerank.group_negatives(triples)


@query("j17_positive_lookup", using("SELECT qid, docid, query FROM qrels JOIN queries ON qid = query_id", "qrels", "queries"))
def _(spark, d):
    return rerank.lookup_positives(t.queries(spark, d), t.qrels(spark, d)).select("qid", "docid", "query")
