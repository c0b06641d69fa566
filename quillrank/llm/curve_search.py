"""Approximate nearest neighbours along shifted Hilbert curves.

Each curve projects the vectors to a few directions of its own, shifts its grid, and sorts them by their place on it.
Each curve is cut into blocks of equal size; a query meets the blocks around its own place on each curve, the
best of each block are merged, and the score is the exact distance of the original vectors.

How many curves and blocks are needed is measured: a sample of queries is searched by brute force, and of all numbers of
curves from two on and their windows the cheapest is taken that holds the wanted share of their true neighbours. Vectors are
moved only then: each once per curve used, and each query once per block of its windows, which is what the choice makes
small. There is no upper limit to a window: where directions say nothing about distance, it grows.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.common import drawn, usable
from quillrank.operators.placement import top_k
from quillrank.session import settled

LOG = logging.getLogger(__name__)
CURVES = 32
LEAST_CURVES = 2
DIRECTIONS, BITS = 8, 7
BLOCK_ROWS = 128
FIT_ROWS = 10_000
AUDIT_QUERIES = 256
RECALL = 0.94
QUERY_CHUNK = 1024
MERGE_ROWS = 500_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (n, m) with coordinates below 2**bits; m * bits is at most 63.

    Undoes, from the top bit down, the turns and flips by which the curve enters each sub-cube, then puts the bits of
    all coordinates one after another.
    """
    x = [c.astype(np.int64).copy() for c in cells.T]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for c in x:
            set_ = (c & level) != 0
            swap = np.where(set_, 0, (x[0] ^ c) & low)
            flipped = np.where(set_, low, swap)
            if c is x[0]:
                x[0] ^= np.where(set_, low, 0)
            else:
                c ^= swap
                x[0] ^= flipped
        level >>= 1
    for a, b in zip(x, x[1:]):
        b ^= a
    turn, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ turn) >> bit) & 1
    return key


class Curves:
    """Projections and shifts of each curve, fitted to a bounded sample."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centre = sample.mean(axis=0)
        _, spread, axes = np.linalg.svd(sample - self.centre, full_matrices=False)
        m = max(1, min(DIRECTIONS, sample.shape[1], len(axes)))
        spread = np.maximum(spread, 1e-9 * spread.max() if spread.max() > 0 else 1.0)
        self.maps, self.low, self.step = [], [], []
        for _ in range(curves):
            # Directions of its own, drawn where the sample varies.
            way = np.linalg.qr(((rng.normal(size=(m, len(axes))) * spread) @ axes).T)[0].T
            seen = (sample - self.centre) @ way.T
            low, high = seen.min(axis=0), seen.max(axis=0)
            width = np.maximum(high - low, 1e-12)
            # The grid is half as wide again as the sample, and each curve starts at another place of that slack.
            self.low.append(low - rng.uniform(0.1, 0.4, len(way)) * width)
            self.step.append(1.5 * width / (1 << BITS))
            self.maps.append(way)

    def keys(self, curve: int, vectors: np.ndarray) -> np.ndarray:
        seen = (vectors - self.centre) @ self.maps[curve].T
        cells = np.clip(np.floor((seen - self.low[curve]) / self.step[curve]), 0, (1 << BITS) - 1)
        return hilbert_keys(cells, BITS)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _ranked(query: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, distance) of the k nearest points, distances from the differences; ties to the smaller id."""
    exact = np.sqrt(((query - points) ** 2).sum(axis=1))
    order = np.lexsort((ids, exact))[:k]
    return ids[order], exact[order]


def _nearest(queries: np.ndarray, ids: np.ndarray, points: np.ndarray, own: np.ndarray, k: int):
    """(query place, id, distance) of each query's k nearest points but those with its own id.

    A product of matrices gives distances with an error; every point that may be among the k by that error is compared
    exactly, however many these are.
    """
    if not len(ids):
        return
    centre = points.mean(axis=0)
    q, p = queries - centre, points - centre
    q2, p2 = (q**2).sum(1), (p**2).sum(1)
    near = q2[:, None] + p2[None, :] - 2.0 * q @ p.T
    # A dot product of m terms is off by m units of rounding of |q||p| at most, whatever the order of its sum, a square
    # of a norm likewise, and centring moves each end by one unit: eight times m + 8 units of (|q|+|p|)^2 hold all of it.
    error = 4 * (queries.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(q2)[:, None] + np.sqrt(p2)[None, :]) ** 2
    low, high = np.nan_to_num(near - error, nan=-np.inf, posinf=np.inf), np.nan_to_num(near + error, nan=np.inf, posinf=np.inf)
    other = own[:, None] != ids[None, :]
    high[~other] = np.inf
    limit = np.partition(high, k - 1, axis=1)[:, k - 1] if k < len(ids) else np.full(len(queries), np.inf)
    may = other & (low <= limit[:, None])
    for i, row in enumerate(may):
        at = np.flatnonzero(row)
        if len(at):
            yield i, *_ranked(queries[i], ids[at], points[at], k)


def _nearest_by_differences(queries: np.ndarray, ids: np.ndarray, points: np.ndarray, own: np.ndarray, k: int):
    """The same from differences alone, without a product of matrices: what the audit measures by."""
    for i, query in enumerate(queries):
        at = np.flatnonzero(ids != own[i])
        if len(at):
            yield i, *_ranked(query, ids[at], points[at], k)


def _rows(found: list, own: np.ndarray) -> pa.RecordBatch:
    counts = [len(ids) for _, ids, _ in found]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(own[[i for i, _, _ in found]], counts)),
            pa.array(np.concatenate([ids for _, ids, _ in found])),
            pa.array(np.concatenate([d for _, _, d in found])),
        ],
        names=["query_id", "id", "score"],
    )


class _Merged:
    """The k nearest points of each query over all windows that a task has met."""

    def __init__(self, k: int):
        self.k, self.held, self.size = k, [], 0

    def add(self, rows: pa.RecordBatch) -> None:
        self.held.append([c.to_numpy() for c in rows.columns])
        self.size += rows.num_rows
        if self.size > MERGE_ROWS:
            self._cut()

    def _cut(self) -> None:
        query, point, score = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((point, score, query))
        query, point, score = query[order], point[order], score[order]
        # A point that several windows hold comes with one distance, or with several vectors of one id: the nearest counts.
        first = np.lexsort((np.arange(len(query)), point, query))
        again = first[1:][(query[first[1:]] == query[first[:-1]]) & (point[first[1:]] == point[first[:-1]])]
        stays = np.ones(len(query), bool)
        stays[again] = False
        query, point, score = query[stays], point[stays], score[stays]
        near = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.held = [[query[near], point[near], score[near]]]
        self.size = int(near.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._cut()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self.held[0]], names=["query_id", "id", "score"])


def choose_window(distances: np.ndarray, blocks: int, target: float) -> tuple[int, int]:
    """(curves, half width in blocks) that read the fewest blocks and hold `target` of the neighbours.

    `distances` (neighbours, curves): how many blocks a true neighbour lies from its query on each curve.
    """
    least = min(LEAST_CURVES, distances.shape[1])
    if not len(distances):
        return least, 1
    best = None
    for curves in range(least, distances.shape[1] + 1):
        reach = np.sort(distances[:, :curves].min(axis=1))
        half = max(1, int(reach[min(len(reach) - 1, int(np.ceil(target * len(reach))) - 1)]))
        cost = curves * min(2 * half + 1, blocks)
        if best is None or cost < best[0]:
            best = (cost, curves, half)
    return best[1:]


def _search(points: DataFrame, queries: DataFrame, dim: int, k: int, curves: int, target: float, block_rows: int) -> DataFrame:
    spark = points.sparkSession
    sample = drawn(points.select("id", "vec"), FIT_ROWS, "id").toPandas()["vec"]
    fitted = Curves(np.stack(sample.to_list()), curves) if len(sample) else None
    audit = drawn(queries, AUDIT_QUERIES, "id").toPandas()
    empty = "query_id long, id long, score double"
    if fitted is None or not len(audit):
        return spark.createDataFrame([], empty)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(3), dim)
                for c in range(curves):
                    columns = [pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(fitted.keys(c, vectors))]
                    yield pa.RecordBatch.from_arrays([*columns, *batch.columns[:3]], names=["curve", "key", "id", "tag", "asks"])

    # Rows of one id and vector have one tag, and are the same point.
    tagged = lambda rows, asks: rows.select("id", F.xxhash64("id", "vec").alias("tag"), F.lit(asks).alias("asks"), "vec").dropDuplicates(["id", "tag"])
    both = settled(tagged(points, False).union(tagged(queries, True)), "tagged")
    keyed = both.mapInArrow(place, "curve int, key long, id long, tag long, asks boolean")
    line = keyed.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id", "asks")
    line = settled(line.drop("key").withColumn("at", F.monotonically_increasing_id()), "curves")
    line = line.withColumn("part", F.shiftright("at", 33)).withColumn(
        "piece", F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / block_rows).cast("long")
    )
    # A row per curve and partition: where the curve's blocks of the partition start.
    spans = line.groupBy("curve", "part").agg(F.min("piece").alias("low"), (F.max("piece") - F.min("piece") + 1).alias("n"))
    along = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("curve", "part", "n", (F.coalesce(F.sum("n").over(along), F.lit(0)) - F.col("low")).alias("offset"), "low")
    spans = settled(spans, "spans")
    last = spans.agg(F.max(F.col("offset") + F.col("low") + F.col("n")) - 1).first()[0]
    line = line.join(F.broadcast(spans.select("curve", "part", "offset")), ["curve", "part"])
    line = line.select("curve", (F.col("piece") + F.col("offset")).alias("block"), "id", "tag", "asks")

    asked_ids, asked = audit["id"].to_numpy(dtype=np.int64), np.stack(audit["vec"].to_list())

    def brute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                found = list(_nearest_by_differences(asked, ids, _matrix(batch.column(1), dim), asked_ids, k))
                if found:
                    yield _rows(found, asked_ids)

    order = [F.col("score"), F.col("id")]
    truth = top_k(points.select("id", "vec").mapInArrow(brute, empty).distinct(), ["query_id"], order, k).select("query_id", "id")
    truth = settled(truth, "truth")
    asks = line.where("asks").select("curve", F.col("id").alias("query_id"), F.col("block").alias("from")).join(
        truth.select("query_id").distinct(), "query_id", "left_semi"
    )
    places = line.where(~F.col("asks")).select("curve", "id", "block").join(truth, "id").groupBy("curve", "query_id", "id").agg(F.min("block").alias("block"))
    apart = places.join(asks, ["curve", "query_id"]).groupBy("query_id", "id", "curve").agg(F.min(F.abs(F.col("block") - F.col("from"))).alias("d"))
    # At most AUDIT_QUERIES * k rows.
    seen = apart.groupBy("query_id", "id").pivot("curve", list(range(curves))).agg(F.first("d")).toPandas()
    distances = seen[[str(c) for c in range(curves)]].to_numpy(dtype=float)
    used, half = choose_window(distances, last + 1, target)
    held = float((distances[:, :used].min(axis=1) <= half).mean()) if len(distances) else 1.0
    LOG.info("%d curves of %d, %d of %d blocks on each, audited recall %.4f", used, curves, 2 * half + 1, last + 1, held)

    line = line.where(F.col("curve") < used).join(both, ["id", "tag", "asks"]).select("curve", "block", "id", "asks", "vec")
    window = F.sequence(F.greatest(F.col("block") - half, F.lit(0)), F.least(F.col("block") + half, F.lit(last)))
    around = line.where("asks").withColumn("block", F.explode(window)).select("curve", "block", "id", "asks", "vec")
    met = line.where(~F.col("asks")).union(around).repartition("curve", "block").sortWithinPartitions("curve", "block", "asks")

    def rerank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, points_, asking, vectors, merged = None, [], [], [], [], _Merged(k)

        def flush() -> None:
            if asking and ids:
                own = np.concatenate(asking)
                found = list(_nearest(np.concatenate(vectors), np.concatenate(ids), np.concatenate(points_), own, k))
                if found:
                    merged.add(_rows(found, own))
            asking.clear()
            vectors.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            curve, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            who, asks_, matrix = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), _matrix(batch.column(4), dim)
            key = np.stack([curve.astype(np.int64), block.astype(np.int64), asks_.astype(np.int64)])
            starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            for a, b in zip(starts, np.append(starts[1:], len(who))):
                here = (curve[a], block[a])
                if here != at:
                    flush()
                    at = here
                    ids.clear()
                    points_.clear()
                if not asks_[a]:
                    ids.append(who[a:b])
                    points_.append(matrix[a:b])
                    continue
                for c in range(a, b, QUERY_CHUNK):
                    asking.append(who[c : min(b, c + QUERY_CHUNK)])
                    vectors.append(matrix[c : min(b, c + QUERY_CHUNK)])
                    flush()
        flush()
        yield from merged.rows()

    found = met.mapInArrow(rerank, empty).groupBy("query_id", "id").agg(F.min("score").alias("score"))
    return found


def nearest(
    points: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    curves: int = CURVES,
    target: float = RECALL,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score): for each query its k nearest points found, by Euclidean distance in double precision.

    Points with the query's own id are left out; ties go to the smaller id; with fewer points all are returned. Rows
    whose vector is null, empty, all zero or holds a null or non-finite component, and rows with a null id, take no
    part. Vectors of different length do not meet. Rows that repeat are one; an id with several vectors appears once
    per query, with its nearest. Of vectors that are exactly equal, the k + 1 smallest ids can be results; only those are
    indexed, so a vector that very many rows hold fills no block. An empty table gives no rows. Only the two named
    columns are read.

    On the driver: a sample of FIT_ROWS vectors to fit the projection, AUDIT_QUERIES queries and their distances. Both
    are chosen by the hash of the id; every row is indexed and every query searched. Numbers of curves and blocks and
    the audited recall are logged.
    """
    def clean(rows: DataFrame) -> DataFrame:
        vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))
        held = rows.where(usable(vector_col) & F.col(id_col).isNotNull())
        return held.select(F.col(id_col).cast("long").alias("id"), vector.alias("vec"))

    copies = Window.partitionBy(F.xxhash64("vec"), "vec").orderBy("id")
    own = clean(points).withColumn("nth", F.dense_rank().over(copies)).where(F.col("nth") <= k + 1).drop("nth")
    own, asked = settled(own, "points"), settled(clean(queries).distinct(), "queries")
    out = None
    for row in sorted(asked.select(F.size("vec").alias("n")).distinct().collect()):
        same = lambda rows: rows.where(F.size("vec") == row["n"])
        found = _search(same(own), same(asked), row["n"], k, curves, target, block_rows)
        out = found if out is None else out.union(found)
    if out is None:
        out = points.sparkSession.createDataFrame([], "query_id long, id long, score double")
    best = top_k(out, ["query_id"], [F.col("score"), F.col("id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
