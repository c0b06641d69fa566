"""Search results against brute force, and equal results on every path."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.operators import cells, rerank, search
from quillrank.session import fresh_path

WHOLE = "id string, term string, weight int"


def rows_of(df):
    return sorted(map(tuple, df.select("qid", "docid", "score", "rank").collect()))


@pytest.fixture(scope="module")
def sparse_data(spark):
    rng = np.random.default_rng(3)
    terms = [f"t{i}" for i in range(30)]
    draw = lambda n, most: [(str(i), t, int(w)) for i in range(n) for t, w in zip(rng.choice(terms, most, replace=False), rng.integers(1, 9, most))]
    docs, queries = draw(80, 8), draw(12, 5)
    docs += [(str(i), "hot", 1) for i in range(80)]
    queries += [(str(i), "hot", 2) for i in range(12)]
    return docs, queries


def brute(docs, queries, k, cut=None):
    out = []
    by_doc, by_query = {}, {}
    for i, t, w in docs:
        by_doc.setdefault(i, {})[t] = w
    for i, t, w in queries:
        by_query.setdefault(i, {})[t] = w
    for q, qv in by_query.items():
        chosen = sorted(qv, key=lambda t: (-qv[t], t))[:cut]
        scores = [(-sum(w * dv[t] for t, w in qv.items() if t in dv), d) for d, dv in by_doc.items() if set(chosen) & set(dv)]
        out += [(q, d, -s, r) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 7, 500])
@pytest.mark.parametrize("fit", [True, False])
def test_sparse_topk(spark, sparse_data, k, fit):
    docs, queries = (spark.createDataFrame(x, WHOLE) for x in sparse_data)
    assert rows_of(search.sparse_topk(docs, queries, k, queries_fit=fit)) == brute(*sparse_data, k)


@pytest.mark.parametrize("cut", [1, 2, 99])
@pytest.mark.parametrize("fit", [True, False])
def test_sparse_topk_cut(spark, sparse_data, cut, fit):
    docs, queries = (spark.createDataFrame(x, WHOLE) for x in sparse_data)
    assert rows_of(search.sparse_topk_cut(docs, queries, 9, cut, queries_fit=fit)) == brute(*sparse_data, 9, cut)


def test_float_weights_do_not_depend_on_partitions(spark, sparse_data):
    scaled = [[(i, t, w * 0.1) for i, t, w in x] for x in sparse_data]
    make = lambda x, n: spark.createDataFrame(x, "id string, term string, weight double").repartition(n)
    one, many = (rows_of(search.sparse_topk(make(scaled[0], n), make(scaled[1], n), 10)) for n in (1, 8))
    assert one == many


def test_index_is_reused_rebuilt_and_read_without_a_shuffle(spark, sparse_data, capsys):
    docs, queries = (spark.createDataFrame(x, WHOLE) for x in sparse_data)
    path = fresh_path(spark, "index")
    assert search.open_index(spark, path) is None
    index = search.write_index(docs, path, 4)
    found = search.sparse_topk(index, queries, 5, by_document=True)
    assert rows_of(found) == brute(*sparse_data, 5)
    found.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    fewer = docs.where("id < '4'")
    assert search.write_index(fewer, path, 4).count() == docs.count()
    rebuilt = search.write_index(fewer, path, 4, rebuild=True)
    assert rebuilt.count() == fewer.count() == search.open_index(spark, path).count()


def test_shard_runs_reduce_to_the_whole_run(spark, sparse_data):
    docs, queries = (spark.createDataFrame(x, WHOLE) for x in sparse_data)
    shards = [docs.where("id < '3'"), docs.where("id >= '3' and id < '6'"), docs.where("id >= '6'")]
    runs = [search.sparse_topk(s, queries, 6) for s in shards]
    assert rows_of(search.reduce_runs(runs, 6)) == brute(*sparse_data, 6)


@pytest.fixture(scope="module")
def dense(spark):
    rng = np.random.default_rng(5)
    docs = rng.integers(-3, 4, (90, 6)).astype(float)
    docs[30:60] = docs[0]  # a third of the documents are copies
    queries = rng.integers(-3, 4, (11, 6)).astype(float)
    frame = lambda m: spark.createDataFrame([(str(i), [float(v) for v in row]) for i, row in enumerate(m)], "id string, embedding array<float>")
    return docs, queries, frame(docs).repartition(5), frame(queries)


def dense_brute(docs, queries, k, skip_self=False):
    out = []
    for q, d in itertools.product(range(len(queries)), [None]):
        scores = sorted((-round(float(queries[q] @ docs[i]), 9), str(i)) for i in range(len(docs)) if not (skip_self and i == q))
        out += [(str(q), i, -s, r) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 10, 500])
def test_dense_topk(dense, k):
    docs, queries, d, q = dense
    wanted = dense_brute(docs, queries, k)
    assert rows_of(search.dense_topk(q, d, k)) == wanted
    assert rows_of(search.dense_topk(q, d, k, chunk_rows=4)) == wanted
    assert rows_of(search.dense_topk(q, d, k, chunk_rows=4, floor_rows=15)) == wanted
    assert rows_of(search.dense_topk(q, d, k, chunk_kept=3 * k, floor_rows=5)) == wanted


def test_floors_cut_what_a_task_hands_on(dense, spark):
    """With floors from most documents, tasks hand on little more than the result; without, k rows each."""
    docs, queries, _, q = dense
    rng = np.random.default_rng(1)
    many = rng.normal(size=(4000, 6))
    frame = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(many)], "id string, embedding array<double>").repartition(16)
    matrix, ids = search._send_queries(q)
    scores = matrix.value @ many.T
    floors = np.sort(scores[:, :1000], axis=1)[:, -10]
    handed = {}
    for name, known in (("none", None), ("sample", floors)):
        handed[name] = 0
        for part in np.array_split(np.arange(4000), 16):
            best = search._Best(len(ids.value), 10, known)
            search._score_batch(best, np.arange(len(ids.value)), matrix.value, frame.toPandas().iloc[part])
            handed[name] += sum(len(s) for s in best.scores)
    assert handed["none"] == 16 * 10 * len(queries) and handed["sample"] < 6 * 10 * len(queries)


def test_stored_cells(spark, dense, capsys):
    docs, queries, d, q = dense
    index = cells.CellIndex(spark, fresh_path(spark, "cells"))
    centers = np.random.default_rng(3).normal(size=(6, 6))
    index.write(d.where("cast(id as int) < 50"), centers)
    index.add(d.where("cast(id as int) >= 50"))
    cell = np.argmin((centers**2).sum(1)[None, :] - 2 * docs @ centers.T, axis=1)
    assert {r["id"]: r["cell"] for r in index.documents().collect()} == {str(i): c for i, c in enumerate(cell)}
    for probes in (1, 3, 6):
        near = np.argsort((centers**2).sum(1)[None, :] - 2 * queries @ centers.T, axis=1, kind="stable")[:, :probes]
        wanted = []
        for i, seen in enumerate(near):
            scores = sorted((-round(float(queries[i] @ docs[j]), 9), str(j)) for j in range(len(docs)) if cell[j] in seen)
            wanted += [(str(i), j, -s, r) for r, (s, j) in enumerate(scores[:8], 1)]
        for chunk_rows in (100, 3, 1):
            assert rows_of(index.search(q, 8, probes, chunk_rows)) == sorted(wanted)
    index.documents([2, 3]).explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert rows_of(index.search(q.limit(0), 8)) == []
    index.write(d.limit(0), centers)
    assert rows_of(index.search(q, 8)) == []


def test_cosine_topk_leaves_out_the_query(dense):
    docs, queries, d, q = dense
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    got = [(a, b, r) for a, b, _, r in rows_of(search.cosine_topk(q, d, 7))]
    wanted = [(a, b, r) for a, b, _, r in dense_brute(unit(docs), unit(queries), 7, skip_self=True)]
    assert got == wanted and all(a != b for a, b, _ in got)


def test_cosine_counts_nan_as_lowest(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [float("nan"), 1.0]), ("c", [-0.5, 0.1])], "id string, embedding array<float>")
    got = {(r[0], r[1]): r[2] for r in rows_of(search.cosine_topk(rows, rows, 5))}
    assert got[("a", "b")] == -1.0 and got[("a", "c")] > -1.0


def test_cells_with_all_probes_are_exact(dense):
    docs, queries, d, q = dense
    model = search.train_cells(d, 4)
    celled = search.assign_cells(d, model)
    every = search.dense_topk_cells(q, celled, model.clusterCenters(), 8, probes=4)
    assert rows_of(every) == dense_brute(docs, queries, 8)
    some = {(r[0], r[1], r[2]) for r in rows_of(search.dense_topk_cells(q, celled, model.clusterCenters(), 8, probes=1))}
    scores = {(r[0], r[1], r[2]) for r in dense_brute(docs, queries, 500)}
    assert some <= scores
    for probes in (1, 4):
        fits, blocks = (
            rows_of(search.dense_topk_cells(q, celled, model.clusterCenters(), 8, probes, queries_fit=f, cell_rows=7)) for f in (True, False)
        )
        assert fits == blocks


def test_maxsim(spark):
    docs = spark.createDataFrame([("d", 0, [1.0, 0.0]), ("d", 1, [0.0, 2.0]), ("e", 0, [-1.0, -1.0])], "id string, pos int, vec array<float>")
    queries = spark.createDataFrame([("q", 0, [1.0, 1.0]), ("q", 1, [-1.0, 3.0])], "id string, pos int, vec array<float>")
    pairs = spark.createDataFrame([("q", "d"), ("q", "e")], "qid string, docid string")
    assert rows_of(search.maxsim(pairs, queries, docs)) == [("q", "d", 8.0, 1), ("q", "e", -4.0, 2)]
    assert rows_of(search.maxsim(pairs, queries, docs, padded=True)) == [("q", "d", 8.0, 1), ("q", "e", 0.0, 2)]


def test_maxsim_of_stored_matrices_in_chunks(spark, capsys):
    rng = np.random.default_rng(2)
    texts = lambda p, n: {f"{p}{i}": rng.integers(-4, 5, (int(rng.integers(1, 6)), 4)).astype(float) for i in range(n)}
    docs, queries = texts("d", 20), texts("q", 9)
    frame = lambda m: spark.createDataFrame([(i, p, v.tolist()) for i, rows in m.items() for p, v in enumerate(rows)], "id string, pos int, vec array<double>")
    pairs = [(q, d) for q in queries for d in docs if rng.random() < 0.6] + [("q0", "unknown"), ("unknown", "d0")]
    asked = spark.createDataFrame(pairs, "qid string, docid string")
    wanted = []
    for q in queries:
        scores = sorted((-(queries[q] @ docs[d].T).max(axis=1).sum(), d) for a, d in pairs if a == q and d in docs)
        wanted += [(q, d, -s, r) for r, (s, d) in enumerate(scores, 1)]
    path = fresh_path(spark, "matrices")
    search.token_matrix(frame(docs)).write.parquet(path)
    stored = spark.read.parquet(path)
    for documents, limits in ((frame(docs), {}), (stored, {}), (stored, {"chunk_pairs": 20})):
        assert rows_of(search.maxsim(asked, frame(queries), documents, **limits)) == sorted(wanted)
    search.maxsim(asked, frame(queries), stored).explain()
    plan = capsys.readouterr().out
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "matrix" in line]
    assert "hashpartitioning(qid" in plan and plan.count("Exchange hashpartitioning") == 2


def test_rerank_input_and_missing_keys(spark):
    run = spark.createDataFrame([("1", "a", 3.0), ("1", "b", 2.0), ("1", "zz", 1.0), ("9", "a", 1.0)], "qid string, docid string, score double")
    queries = spark.createDataFrame([("1", "ask"), ("2", "none")], "query_id string, query string")
    corpus = spark.createDataFrame([("a", None, "A"), ("b", "T", "B")], "docid string, title string, text string")
    rows = rerank.rerank_input(run, queries, corpus, 1).collect()
    assert [(r["query_id"], r["docid"], r["text"], r["score"]) for r in rows] == [("1", "a", "A", 3.0)]
    missing = {r["kind"]: r["rows"] for r in rerank.missing_keys(run, queries, corpus).collect()}
    assert missing == {"query": 1, "document": 1}
    ranked = rerank.rerank(rerank.rerank_input(run, queries, corpus, 5), -F.length("text").cast("double")).collect()
    assert sorted((r["docid"], r["rank"]) for r in ranked) == [("a", 1), ("b", 2)]


def test_grouped_lists_go_on_in_parts(spark):
    rows = spark.createDataFrame([("q", f"d{i}") for i in range(7)] + [("q", "d3"), ("p", "x")], "qid string, docid string")
    parts = {(r["qid"], r["part"]): r["docids"] for r in rerank.grouped_lists(rows, "qid", "docid", "docids", 3).collect()}
    assert parts == {("p", 0): ["x"], ("q", 0): ["d0", "d1", "d2"], ("q", 1): ["d3", "d3", "d4"], ("q", 2): ["d5", "d6"]}
    triples = rows.withColumn("positive", F.lit("")).withColumnRenamed("docid", "negative")
    text = {r["qid"]: r["negatives"] for r in rerank.group_negatives(triples).collect()}
    assert text == {"p": "x", "q": "d0,d1,d2,d3,d3,d4,d5,d6"}
