"""Sparse, dense and multi-vector search. Every result is (qid, docid, score, rank), rank from 1.

Ties go to the smaller docid. Float scores are held to nine digits so that ties are the same at any partitioning.
"""

from __future__ import annotations

import hashlib
import uuid
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.functions.vectors import steady, unit
from quillrank.operators import blocks
from quillrank.operators.placement import fits_broadcast, spread_join, top_k
from quillrank.session import fresh_path, settled

DENSE_QUERY_ROWS = 20_000
DENSE_KEPT = 4_000_000
#: Documents that give the first bounds, and how many times as many there must be for that to be worth a pass.
FLOOR_ROWS, FLOOR_SHARE = 100_000, 4
PAIR_ROWS = 1_000_000
QUERY_BLOCK = 512
#: Documents that a block of queries meets in one product.
DOC_BLOCK = 8_192
#: Postings of a bucket of a stored index, about: one task sorts it and adds up its scores.
BUCKET_POSTINGS = 2_000_000


def _best(scored: DataFrame, k: int) -> DataFrame:
    return top_k(scored, ["qid"], [F.desc("score"), F.asc("docid")], k, "rank", spread="docid")


def _integral(df: DataFrame) -> bool:
    return isinstance(df.schema["weight"].dataType, (T.IntegerType, T.LongType, T.ShortType))


def _summed(whole: bool) -> Column:
    kind = "long" if whole else "double"
    total = F.sum(F.col("q_weight").cast(kind) * F.col("d_weight").cast(kind))
    return total if whole else steady(total)


def _meeting(
    postings: DataFrame, query_terms: DataFrame, by_document: bool, queries_fit: bool | None
) -> tuple[DataFrame, bool]:
    """Rows of postings and query terms that share a term, placed by docid; and whether all weights are whole."""
    docs = postings.select(F.col("id").alias("docid"), "term", F.col("weight").alias("d_weight"))
    rest = [c for c in query_terms.columns if c not in ("id", "term", "weight")]
    queries = query_terms.select(F.col("id").alias("qid"), "term", F.col("weight").alias("q_weight"), *rest)
    if queries_fit is None:
        queries_fit = fits_broadcast(queries)
    if queries_fit:
        if not by_document:
            wanted = queries.select("term").distinct()
            docs = docs.join(F.broadcast(wanted), "term", "left_semi").repartition("docid")
        pairs = docs.join(F.broadcast(queries), "term")
    else:
        pairs = spread_join(docs, queries, "term", "inner", ["docid"], right_fits=False)
    return pairs, _integral(postings) and _integral(query_terms)


def sparse_scores(
    postings: DataFrame, query_terms: DataFrame, by_document: bool = False, queries_fit: bool | None = None
) -> DataFrame:
    """Sum of weight products over shared terms, per (qid, docid).

    With queries that fit a broadcast, postings are first cut to query terms and shuffled once by docid, which
    moves each posting once whatever the number of queries. Scores then add up inside the task. `by_document`
    says that postings are stored by docid already (see write_index): no shuffle is left.
    """
    pairs, whole = _meeting(postings, query_terms, by_document, queries_fit)
    return pairs.groupBy("qid", "docid").agg(_summed(whole).alias("score"))


def sparse_topk(
    postings: DataFrame,
    query_terms: DataFrame,
    k: int = 100,
    by_document: bool = False,
    queries_fit: bool | None = None,
) -> DataFrame:
    """Exact sparse search over postings (id, term, weight) and query terms of the same shape.

    Queries that do not fit a broadcast go over blocks of documents, a chunk of them at a time.
    """
    if queries_fit is None:
        queries_fit = fits_broadcast(query_terms)
    if not queries_fit:
        return blocks.topk(blocks.pack(postings), query_terms, k)
    return _best(sparse_scores(postings, query_terms, by_document, queries_fit), k)


def sparse_topk_cut(
    postings: DataFrame,
    query_terms: DataFrame,
    k: int = 100,
    query_cut: int = 10,
    by_document: bool = False,
    queries_fit: bool | None = None,
) -> DataFrame:
    """Search by candidates: the `query_cut` heaviest terms of a query choose documents, all terms score them.

    One pass does both: a pair's score and whether a chosen term led to it add up in the same aggregate, and
    pairs without one are dropped in the task, before anything is ranked or shuffled. Over stored blocks
    (blocks.topk), the other terms are looked up for the chosen documents alone.
    """
    if queries_fit is None:
        queries_fit = fits_broadcast(query_terms)
    if not queries_fit:
        return blocks.topk(blocks.pack(postings), query_terms, k, query_cut)
    heaviest = Window.partitionBy("id").orderBy(F.desc("weight"), F.asc("term"))
    marked = query_terms.withColumn("cut", F.row_number().over(heaviest) <= query_cut)
    pairs, whole = _meeting(postings, marked, by_document, queries_fit)
    scored = pairs.groupBy("qid", "docid").agg(_summed(whole).alias("score"), F.max("cut").alias("chosen"))
    return _best(scored.where("chosen").drop("chosen"), k)


def write_index(postings: DataFrame, path: str, buckets: int = 64, rebuild: bool = False) -> DataFrame:
    """Stores postings by docid bucket, sorted by docid, and opens them; an index in place is used again.

    `buckets` is the least number: there are more where a bucket would hold more than about BUCKET_POSTINGS. Postings
    are counted first, so stored ones are best.

    Search reads buckets as they lie: no shuffle before the top-k, and the postings of a document stand together,
    which keeps the aggregate on few keys at a time. Each build has a folder of its own, and the facts that name it are
    written last: a build that breaks off leaves the index before it in use.
    """
    spark = postings.sparkSession
    if not rebuild:
        found = open_index(spark, path)
        if found is not None:
            return found
    buckets = max(buckets, math.ceil(postings.count() / BUCKET_POSTINGS))
    path, folder = _qualified(spark, path), f"postings-{uuid.uuid4().hex}"
    (
        postings.select("id", "term", "weight")
        .repartition(buckets, "id")
        .write.mode("overwrite")
        .bucketBy(buckets, "id")
        .sortBy("id", "term")
        .option("path", f"{path}/{folder}")
        .format("parquet")
        .saveAsTable(_index_table(f"{path}/{folder}"))
    )
    kind = postings.schema["weight"].dataType.simpleString()
    facts = spark.createDataFrame([(buckets, kind, folder)], "buckets int, kind string, folder string")
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return spark.table(_index_table(f"{path}/{folder}"))


def open_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored index, or None where there is none."""
    path = _qualified(spark, path)
    try:
        facts = spark.read.parquet(f"{path}/facts").first()
    except Exception as error:  # the reader reports a missing path as an analysis error
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    place = f"{path}/{facts['folder']}"
    table = _index_table(place)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (id STRING, term STRING, weight {facts['kind']}) USING parquet "
        f"CLUSTERED BY (id) SORTED BY (id, term) INTO {facts['buckets']} BUCKETS LOCATION '{place}'"
    )
    return spark.table(table)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and all folders, so that the catalogue and the writer mean the same place."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")


def _index_table(place: str) -> str:
    """A catalogue name that no other place has."""
    return f"index_{hashlib.sha256(place.encode()).hexdigest()}"


def _held(products: np.ndarray) -> np.ndarray:
    """Products to nine digits; what is not a number counts as -1."""
    return np.nan_to_num(np.rint(products * 1e9) / 1e9, nan=-1.0)


class _Best:
    """Running best k per query inside one task: the smaller id first on equal scores."""

    def __init__(self, n_queries: int, k: int, floors: np.ndarray | None = None):
        self.k = k
        self.scores = [np.empty(0)] * n_queries
        self.ids = [np.empty(0, dtype=object)] * n_queries
        # The score to reach: known from before, or once a query has k documents here.
        self.lowest = np.full(n_queries, -np.inf) if floors is None else floors.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Products of query rows (in order) with ids, which are sorted; only those that can count are rounded."""
        # What rounding can add to a product.
        least = self.lowest[rows]
        least = least - (1e-9 + 1e-14 * np.abs(least))
        for at in np.flatnonzero(~(scores.max(axis=1) < least)):
            row, line = rows[at], scores[at]
            near = np.flatnonzero(~(line < least[at]))
            held = _held(line[near])
            kept = held >= self.lowest[row]
            held, near = held[kept], near[kept]
            if len(held) > self.k:
                floor = np.partition(held, len(held) - self.k)[len(held) - self.k]
                above = np.flatnonzero(held > floor)
                kept = np.concatenate([above, np.flatnonzero(held == floor)[: self.k - len(above)]])
                held, near = held[kept], near[kept]
            s = np.concatenate([self.scores[row], held])
            d = np.concatenate([self.ids[row], ids[near]])
            if len(s) > self.k:
                order = np.lexsort((d.astype(str), -s))[: self.k]
                s, d = s[order], d[order]
            if len(s) == self.k:
                self.lowest[row] = max(self.lowest[row], s.min())
            self.scores[row], self.ids[row] = s, d

    def frames(self, query_ids: np.ndarray) -> Iterator[pd.DataFrame]:
        for start in range(0, len(query_ids), QUERY_BLOCK):
            block = range(start, min(start + QUERY_BLOCK, len(query_ids)))
            sizes = [len(self.scores[i]) for i in block]
            if sum(sizes):
                yield pd.DataFrame(
                    {
                        "qid": np.repeat(query_ids[list(block)], sizes),
                        "docid": np.concatenate([self.ids[i] for i in block]),
                        "score": np.concatenate([self.scores[i] for i in block]),
                    }
                )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _score_batch(best: _Best, q_rows: np.ndarray, q_matrix: np.ndarray, batch: pd.DataFrame) -> None:
    batch = batch.sort_values("id", kind="stable")
    ids, docs = batch["id"].to_numpy(dtype=object), _matrix(batch["embedding"])
    for first in range(0, len(ids), DOC_BLOCK):
        some, names = docs[first : first + DOC_BLOCK].T, ids[first : first + DOC_BLOCK]
        for start in range(0, len(q_rows), QUERY_BLOCK):
            rows = q_rows[start : start + QUERY_BLOCK]
            best.add(rows, q_matrix[rows] @ some, names)


SCORED = "qid string, docid string, score double"
#: The numbers of the cells that each of some query vectors looks into.
Near = Callable[[np.ndarray], np.ndarray]


def dense_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 1000,
    chunk_rows: int = DENSE_QUERY_ROWS,
    chunk_kept: int = DENSE_KEPT,
    floor_rows: int = FLOOR_ROWS,
) -> DataFrame:
    """Exact inner-product search over (id, embedding).

    Queries go to the tasks in chunks of at most `chunk_rows`, and of at most `chunk_kept` results. For each chunk, tasks
    multiply Arrow batches of documents with it where they lie: no document is shuffled or copied. A first pass over about
    `floor_rows` documents, chosen by the hash of their id, gives a score that a query's k best all reach; the pass over
    all documents keeps, per task, what reaches it and the task's own k best. So of n documents a task hands on about
    k * (its documents) / floor_rows rows per query, k at most.
    """
    queries = queries.select(F.col("id").cast("string").alias("id"), "embedding")
    docs = docs.select(F.col("id").cast("string").alias("id"), "embedding")
    return _dense_chunks(queries, docs, k, min(chunk_rows, max(1, chunk_kept // k)), floor_rows)


def _dense_chunks(queries: DataFrame, docs: DataFrame, k: int, chunk_rows: int, floor_rows: int, near: Near | None = None) -> DataFrame:
    chunks = max(1, math.ceil(queries.count() / chunk_rows))
    sample = math.ceil(docs.count() / floor_rows)
    first = docs.where(F.pmod(F.xxhash64("id"), F.lit(sample)) == 0) if sample >= FLOOR_SHARE else None
    if chunks == 1:
        return _dense_chunk(queries, docs, first, k, near)
    spark, base = queries.sparkSession, fresh_path(queries.sparkSession, "found")
    for i in range(chunks):
        found = _dense_chunk(queries.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == i), docs, first, k, near)
        found.write.parquet(f"{base}/{i}")
    return spark.read.schema(found.schema).option("recursiveFileLookup", True).parquet(base)


def _dense_chunk(queries: DataFrame, docs: DataFrame, first: DataFrame | None, k: int, near: Near | None = None) -> DataFrame:
    """One chunk of queries against all documents, or those of the cells that they look into; `first` are the documents
    that give the floors."""
    sent, q_ids = _send_queries(queries)
    nearest = near(sent.value) if near is not None and len(q_ids.value) else None

    def search(rows: DataFrame, floors) -> DataFrame:
        if nearest is not None:
            return _best(_in_cells(rows, sent, q_ids, nearest, k, floors), k)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matrix = sent.value
            best = _Best(len(q_ids.value), k, None if floors is None else floors.value)
            every = np.arange(len(q_ids.value))
            for batch in batches:
                if len(batch) and len(every):
                    _score_batch(best, every, matrix, batch)
            yield from best.frames(q_ids.value)

        return _best(rows.select("id", "embedding").mapInPandas(run, SCORED), k)

    if first is None:
        return search(docs, None)
    worst = search(first, None).groupBy("qid").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    known = {r["qid"]: r["score"] for r in worst.collect()}
    floors = np.array([known.get(q, -np.inf) for q in q_ids.value])
    return search(docs, queries.sparkSession.sparkContext.broadcast(floors))


def _send_queries(queries: DataFrame):
    """Measured queries as a matrix and an id array on every executor."""
    local = queries.orderBy("id").toPandas()
    context = queries.sparkSession.sparkContext
    return context.broadcast(_matrix(local["embedding"])), context.broadcast(local["id"].to_numpy(dtype=object))


def cosine_topk(queries: DataFrame, docs: DataFrame, k: int = 1000, **limits) -> DataFrame:
    """Cosine search that leaves out a document with the query's own id and ranks what remains; limits as in dense_topk.

    A score that is not a number counts as -1.
    """
    unit_rows = lambda df: df.select("id", unit(F.col("embedding")).alias("embedding"))
    found = dense_topk(unit_rows(queries), unit_rows(docs), k + 1, **limits)
    return _best(found.where(F.col("qid") != F.col("docid")).drop("rank"), k)


def train_cells(docs: DataFrame, cells: int, seed: int = 7, iterations: int = 20):
    """k-means cells over all document vectors."""
    rows = docs.select(array_to_vector("embedding").alias("features"))
    return KMeans(k=cells, seed=seed, maxIter=iterations).fit(rows)


def assign_cells(docs: DataFrame, model) -> DataFrame:
    rows = docs.select(F.col("id").cast("string").alias("id"), "embedding", array_to_vector("embedding").alias("features"))
    return model.transform(rows).select("id", "embedding", F.col("prediction").alias("cell"))


def _nearest_cells(vectors: np.ndarray, centers: np.ndarray, probes: int) -> np.ndarray:
    distance = (centers**2).sum(axis=1)[None, :] - 2.0 * vectors @ centers.T
    return np.argsort(distance, axis=1, kind="stable")[:, :probes]


def dense_topk_cells(
    queries: DataFrame,
    celled_docs: DataFrame,
    centers: Sequence[np.ndarray],
    k: int = 1000,
    probes: int = 4,
    queries_fit: bool | None = None,
    cell_rows: int = DENSE_QUERY_ROWS,
    floor_rows: int = FLOOR_ROWS,
) -> DataFrame:
    """Approximate inner-product search: a query sees the documents of its `probes` nearest cells, scored exactly.

    Documents stay where they are, so a cell with a large share of them needs no shuffle. Of a query set that does not
    fit, chunks of at most `cell_rows` queries meet them as in dense_topk, each with floors from its own cells; the
    documents are then stored once with their cells.
    """
    queries = queries.select(F.col("id").cast("string").alias("id"), "embedding")
    docs = celled_docs.select("id", "embedding", "cell")
    centers = np.asarray(centers, dtype=np.float64)
    if queries_fit is None:
        queries_fit = fits_broadcast(queries, DENSE_QUERY_ROWS)
    near = lambda vectors: _nearest_cells(vectors, centers, probes)
    if not queries_fit:
        rows = max(1, min(cell_rows, DENSE_QUERY_ROWS, DENSE_KEPT // k))
        # Files say little of how many rows a task gets, and every task has its share of all products.
        dealt = settled(docs.repartition(docs.sparkSession.sparkContext.defaultParallelism), "celled")
        return _dense_chunks(queries, dealt, k, rows, floor_rows, near)
    sent, q_ids = _send_queries(queries)
    return _best(_in_cells(docs, sent, q_ids, near(sent.value), k), k)


def _in_cells(docs: DataFrame, sent, q_ids, nearest: np.ndarray, k: int, floors=None) -> DataFrame:
    """Scores of documents (id, embedding, cell) with the sent queries that look into their cell. Cells that the same
    queries look into are scored together."""
    visitors = {int(c): np.flatnonzero((nearest == c).any(axis=1)) for c in np.unique(nearest)}
    alike: dict[bytes, int] = {}
    together = {c: alike.setdefault(rows.tobytes(), c) for c, rows in visitors.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(len(q_ids.value), k, None if floors is None else floors.value)
        for batch in batches:
            for cell, part in batch.groupby(batch["cell"].map(together)):
                _score_batch(best, visitors[int(cell)], sent.value, part)
        yield from best.frames(q_ids.value)

    return docs.select("id", "embedding", "cell").mapInPandas(run, SCORED)


def reduce_runs(runs: Sequence[DataFrame], depth: int = 100) -> DataFrame:
    """Best `depth` per query over the runs of several shards."""
    parts = [r.select("qid", "docid", "score") for r in runs]
    return _best(reduce(DataFrame.unionByName, parts), depth)


def token_matrix(vectors: DataFrame) -> DataFrame:
    """Token vectors (id, pos, vec) to one row (id, matrix) per id; a row holds one text's tokens.

    This is the one shuffle of token vectors: written down, the rows serve every search over the texts.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pos", "vec")))
    return vectors.groupBy("id").agg(F.transform(ordered, lambda t: t["vec"]).alias("matrix"))


def maxsim(
    candidates: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, padded: bool = False, chunk_pairs: int = PAIR_ROWS
) -> DataFrame:
    """Late interaction over candidate pairs (qid, docid): best match per query token, summed.

    Vectors are rows (id, pos, vec), or (id, matrix) as token_matrix gives them: such documents are read where they lie.
    Pairs go to the tasks in chunks of whole queries, with those queries' tokens; a document meets all its queries of a chunk in one
    product. With `padded`, documents have zero vectors behind their tokens, so no match counts below zero.
    """
    as_matrix = lambda rows: rows if "matrix" in rows.columns else token_matrix(rows)
    pairs = settled(candidates.select("qid", "docid"), "pairs")
    docs = as_matrix(doc_vectors).select(F.col("id").alias("docid"), "matrix")
    asked = settled(as_matrix(query_vectors.join(pairs.select(F.col("qid").alias("id")).distinct(), "id", "left_semi")), "asked")
    chunks = max(1, math.ceil(pairs.count() / chunk_pairs))
    among = lambda rows, key: rows if chunks == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == i)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("docid"))
    base = fresh_path(pairs.sparkSession, "scored")
    for i in range(chunks):
        scored = _interaction(among(pairs, "qid"), among(asked, "id"), docs, padded)
        scored = scored.select("qid", "docid", steady(F.col("score")).alias("score"))
        found = scored.withColumn("rank", F.row_number().over(order))
        if chunks == 1:
            return found
        found.write.parquet(f"{base}/{i}")
    return pairs.sparkSession.read.schema(found.schema).option("recursiveFileLookup", True).parquet(base)


def _interaction(pairs: DataFrame, asked: DataFrame, docs: DataFrame, padded: bool) -> DataFrame:
    """(qid, docid, score) of a chunk of pairs; `asked` are the token matrices of its queries."""
    tokens = {r["id"]: np.array(r["matrix"], dtype=np.float64) for r in asked.toLocalIterator()}
    sent = pairs.sparkSession.sparkContext.broadcast(tokens)
    lists = pairs.groupBy("docid").agg(F.collect_list("qid").alias("qids"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docids, scores = [], [], []
            for docid, matrix, qids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                known = [q for q in qids if q in sent.value]
                if not known:
                    continue
                rows = matrix.values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(matrix), -1)
                stacked = [sent.value[q] for q in known]
                best = (np.concatenate(stacked) @ rows.T).max(axis=1)
                starts = np.cumsum([0, *(len(m) for m in stacked[:-1])])
                scores += np.add.reduceat(np.maximum(best, 0.0) if padded else best, starts).tolist()
                ids += known
                docids += [docid] * len(known)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(docids, pa.string()), pa.array(scores, pa.float64())], ["qid", "docid", "score"]
            )

    text = lambda c: F.col(c).cast("string").alias(c)
    met = docs.join(F.broadcast(lists), "docid").select(text("docid"), "matrix", F.transform("qids", lambda q: q.cast("string")).alias("qids"))
    return met.mapInArrow(score, SCORED)
