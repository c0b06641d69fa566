"""Sparse search over blocks of documents, a document at a time, for any number of queries.

A block is one row: some thousands of documents with their postings by term, and the largest weight of each term. Search
reads blocks as they lie; no posting is shuffled. Queries go to the tasks in chunks of bounded size. A chunk skips the
queries that the largest weights of a block cannot bring above their worst kept score. Results are (qid, docid, score,
rank), ties to the smaller docid; float scores are held to nine digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.operators.placement import top_k
from quillrank.session import fresh_path, settled

BLOCK_POSTINGS = 300_000
CHUNK_POSTINGS = 200_000
CHUNK_KEPT = 500_000
CELLS = 4_000_000
TERM_ROWS = 2_000
EXACT = float(1 << 53)


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, (T.IntegerType, T.LongType, T.ShortType))


def block_schema(weight: str) -> str:
    lists = f"weights array<{weight}>, tops array<{weight}>"
    return f"block int, ids array<string>, terms array<string>, ends array<int>, docs array<int>, {lists}"


def pack(postings: DataFrame, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Postings (id, term, weight) to blocks. This is the one shuffle, made when an index is written.

    Rows of one document and term count together, as their weights would add up in a score. Rows with a null are left out.
    Postings are counted first, so stored ones are best.
    """
    kind = "long" if _whole(postings.schema["weight"].dataType) else "double"
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = postings.select(text("id"), text("term"), F.col("weight").cast(kind).alias("weight")).dropna()
    blocks = max(1, math.ceil(postings.count() / block_postings))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    arrow = pa.int64() if kind == "long" else pa.float64()

    def build(table: pa.Table) -> pa.Table:
        ids, of_id = _codes(table.column("id"))
        terms, of_term = _codes(table.column("term"))
        order = np.argsort(of_term * len(ids) + of_id, kind="stable")
        of_id, of_term, weights = of_id[order], of_term[order], table.column("weight").to_numpy()[order]
        first = np.flatnonzero((np.diff(of_term, prepend=-1) != 0) | (np.diff(of_id, prepend=-1) != 0))
        if len(first) < len(order):
            of_id, of_term, weights = of_id[first], of_term[first], np.add.reduceat(weights, first)
        docs = of_id.astype(np.int32)
        ends = np.cumsum(np.bincount(of_term, minlength=len(terms)))
        tops = np.maximum.reduceat(weights, np.concatenate([[0], ends[:-1]]))
        one = lambda values, type_: pa.array([values], pa.list_(type_))
        return pa.table(
            {
                "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                "ids": one(ids, pa.string()),
                "terms": one(terms, pa.string()),
                "ends": one(ends.astype(np.int32), pa.int32()),
                "docs": one(docs, pa.int32()),
                "weights": one(weights, arrow),
                "tops": one(tops, arrow),
            }
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        of_row = table.column("block").to_numpy()
        for block in np.unique(of_row):
            yield from build(table.filter(pa.array(of_row == block))).to_batches()

    # A partition holds a block or a few; they are told apart there, so rows need no sort.
    return placed.repartition(blocks, "block").mapInArrow(run, block_schema(kind))


def _codes(column: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    """Different strings in byte order, and the place of each row's string among them."""
    found = column.combine_chunks().dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found.dictionary.take(pa.array(order)).to_pylist(), place[found.indices.to_numpy()]


def unpack(blocks: DataFrame) -> DataFrame:
    """Blocks back to postings (id, term, weight); documents listed in a column `dead`, if there is one, are left out."""
    kind = blocks.schema["weights"].dataType.elementType.simpleString()
    columns = ["ids", "terms", "ends", "docs", "weights", *(["dead"] if "dead" in blocks.columns else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block({c: batch.column(j)[i] for j, c in enumerate(columns)})
                row_of = np.repeat(np.arange(len(block.ends)), np.diff(np.concatenate([[0], block.ends])))
                kept = np.flatnonzero(~block.gone[block.docs])
                yield pa.RecordBatch.from_arrays(
                    [block.ids.take(pa.array(block.docs[kept])), block.terms.take(pa.array(row_of[kept])), pa.array(block.weights[kept])],
                    ["id", "term", "weight"],
                )

    return blocks.select(*columns).mapInArrow(run, f"id string, term string, weight {kind}")


class _Block:
    """One row as arrays."""

    def __init__(self, row: dict):
        self.ids, self.terms = row["ids"].values, row["terms"].values
        self.ends, self.docs, self.weights = (row[c].values.to_numpy() for c in ("ends", "docs", "weights"))
        self.tops = row["tops"].values.to_numpy() if "tops" in row else None
        self.gone = np.zeros(len(self.ids), bool)
        dead = row.get("dead")
        if dead is not None and dead.is_valid:
            self.gone[dead.values.to_numpy()] = True


@dataclass
class _Chunk:
    """Queries with their terms: entries of a query stand together, by term."""

    names: np.ndarray
    terms: pa.Array
    query: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    chosen: np.ndarray | None


def _gather(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of every posting of several posting lists."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


class _Search:
    """Best k per query of a chunk over the blocks of one task."""

    def __init__(self, chunk: _Chunk, k: int):
        self.chunk, self.k = chunk, k
        n = len(chunk.names)
        self.floor = np.full(n, -np.inf)
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0, chunk.weight.dtype)
        self.ids = np.zeros(0, "U1")
        self.skipped = 0

    def add(self, block: _Block) -> None:
        chunk = self.chunk
        row_of = np.full(len(chunk.terms), -1, np.int64)
        place = pc.index_in(block.terms, value_set=chunk.terms)
        known = place.is_valid().to_numpy(zero_copy_only=False)
        row_of[place.drop_null().to_numpy()] = np.flatnonzero(known)
        there = np.flatnonzero(row_of[chunk.term] >= 0)
        if not len(there):
            return
        query, row, weight = chunk.query[there], row_of[chunk.term[there]], chunk.weight[there]
        chosen = None if chunk.chosen is None else chunk.chosen[there]
        bound = np.bincount(query, np.maximum(weight * block.tops[row].astype(float), 0), len(self.floor))
        if (weight < 0).any():
            bound[np.unique(query[weight < 0])] = np.inf
        # A hair more than the bound, as sums of floats round.
        useful = bound * (1 + 1e-12) + 1e-9 >= self.floor
        useful &= np.bincount(query if chosen is None else query[chosen], minlength=len(self.floor)) > 0
        self.skipped += int((~useful).sum())
        if not useful.any():
            return
        starts = np.concatenate([[0], block.ends[:-1]]).astype(np.int64)
        sizes = block.ends - starts
        d = len(block.ids)
        live = np.flatnonzero(useful)
        entries = np.searchsorted(query, live, side="left"), np.searchsorted(query, live, side="right")
        volume = np.concatenate([[0], np.cumsum(sizes[row])])
        found = []
        at = 0
        while at < len(live):
            # As many queries as fit the cells and postings of a pass, and for candidates the rows of terms.
            most = volume[entries[0][at]] + CELLS
            stop = min(at + CELLS // d, int(np.searchsorted(volume[entries[1]], most, side="right")), len(live))
            stop = max(at + 1, stop)
            if chosen is not None:
                rows = int(np.searchsorted(entries[1], entries[0][at] + TERM_ROWS, side="right"))
                stop = max(at + 1, min(stop, rows))
            one = slice(int(entries[0][at]), int(entries[1][stop - 1]))
            inside = useful[query[one]]
            q = np.searchsorted(live[at:stop], query[one][inside])
            part = (q, row[one][inside], weight[one][inside])
            score = self._exhaustive if chosen is None else self._candidates
            cells, values = score(block, starts, sizes, d, *part, *(() if chosen is None else (chosen[one][inside],)))
            kept = ~block.gone[cells % d]
            cells, values = cells[kept], values[kept]
            if values.dtype.kind == "f":
                values = np.rint(values * 1e9) / 1e9
            queries, docs = live[at + cells // d], cells % d
            kept = values >= self.floor[queries]
            found.append(self._cut(queries[kept], values[kept], docs[kept]))
            at = stop
        queries, values, docs = (np.concatenate(x) for x in zip(*found))
        if len(queries):
            names = np.array(block.ids.take(pa.array(docs)).to_pylist(), dtype=str)
            self._merge(queries, values, names)

    def _exhaustive(self, block, starts, sizes, d, q, row, weight):
        """Sums over all postings of all terms."""
        n = int(q[-1]) + 1
        owner, place = _gather(starts[row], sizes[row])
        cell = q[owner] * d + block.docs[place]
        product = weight[owner] * block.weights[place]
        met = np.zeros(n * d, bool)
        met[cell] = True
        cells = np.flatnonzero(met)
        return cells, self._sums(cell, product, n * d)[cells]

    def _candidates(self, block, starts, sizes, d, q, row, weight, chosen):
        """Documents that share a chosen term; the other terms are looked up for these alone."""
        n = int(q[-1]) + 1
        owner, place = _gather(starts[row[chosen]], sizes[row[chosen]])
        met = np.zeros(n * d, bool)
        met[q[chosen][owner] * d + block.docs[place]] = True
        cells = np.flatnonzero(met)
        terms, row = np.unique(row, return_inverse=True)
        owner, place = _gather(starts[terms], sizes[terms])
        table = np.zeros((len(terms), d), block.weights.dtype)
        table[owner, block.docs[place]] = block.weights[place]
        of_query = cells // d
        first = np.searchsorted(of_query, np.arange(n))
        count = np.searchsorted(of_query, np.arange(n), side="right") - first
        total = np.zeros(len(cells), np.result_type(weight, block.weights))
        # Entry after entry of each query, over its candidates.
        owner, place = _gather(first[q], count[q])
        product = weight[owner] * table[row[owner], cells[place] % d]
        return cells, self._sums(place, product, len(total))

    @staticmethod
    def _sums(place: np.ndarray, product: np.ndarray, n: int) -> np.ndarray:
        """Sums in the order of terms; whole numbers stay exact."""
        if product.dtype.kind == "f":
            return np.bincount(place, product, n)
        if not len(product) or float(np.abs(product).max()) * len(product) < EXACT:
            return np.bincount(place, product, n).astype(np.int64)
        out = np.zeros(n, np.int64)
        np.add.at(out, place, product)
        return out

    def _cut(self, queries: np.ndarray, values: np.ndarray, docs: np.ndarray):
        """Best k per query; documents of a block stand in the order of their ids."""
        order = np.lexsort((docs, -values, queries))
        queries = queries[order]
        kept = np.arange(len(queries)) - np.searchsorted(queries, queries) < self.k
        return queries[kept], values[order][kept], docs[order][kept]

    def _merge(self, queries: np.ndarray, values: np.ndarray, names: np.ndarray) -> None:
        queries = np.concatenate([self.query, queries])
        values = np.concatenate([self.score, values])
        names = np.concatenate([self.ids, names])
        self.query, self.score, at = self._cut(queries, values, np.argsort(np.argsort(names, kind="stable"), kind="stable"))
        self.ids = np.sort(names)[at]
        size = np.bincount(self.query, minlength=len(self.floor))
        full = np.flatnonzero(size >= self.k)
        worst = self.score[np.cumsum(size)[full] - 1].astype(float)
        # Whole numbers may round up as floats.
        self.floor[full] = np.nextafter(worst, -np.inf) if self.score.dtype.kind == "i" else worst

    def batch(self) -> pa.RecordBatch:
        names = self.chunk.names[self.query]
        columns = [pa.array(names.tolist(), pa.string()), pa.array(self.ids.tolist(), pa.string()), pa.array(self.score)]
        return pa.RecordBatch.from_arrays(columns, ["qid", "docid", "score"])


def _chunk(rows: DataFrame, whole: bool) -> _Chunk:
    local = rows.toArrow()
    names, query = _codes(local.column("qid"))
    terms, term = _codes(local.column("term"))
    weight = local.column("weight").to_numpy().astype(np.int64 if whole else np.float64)
    order = np.lexsort((term, query))
    chosen = local.column("cut").to_numpy()[order].astype(bool) if "cut" in local.column_names else None
    return _Chunk(np.array(names, dtype=object), pa.array(terms, pa.string()), query[order], term[order], weight[order], chosen)


def topk(
    blocks: DataFrame,
    query_terms: DataFrame,
    k: int = 100,
    query_cut: int | None = None,
    dead: dict[tuple[str, int], np.ndarray] | None = None,
    chunk_postings: int = CHUNK_POSTINGS,
    chunk_kept: int = CHUNK_KEPT,
) -> DataFrame:
    """The best k documents per query. Query terms are (id, term, weight); a term that comes twice counts with its sum.

    With `query_cut`, only documents that share one of a query's that many heaviest terms are scored. Each chunk of
    queries is one pass over the blocks; the results of several passes are stored as they come. `dead` names, by folder
    and block, documents that do not count any more.
    """
    kind = blocks.schema["weights"].dataType.elementType
    whole = _whole(kind) and _whole(query_terms.schema["weight"].dataType)
    number = "long" if whole else "double"
    asked = query_terms.dropna().groupBy(F.col("id").cast("string").alias("qid"), F.col("term").cast("string").alias("term"))
    asked = asked.agg(F.sum(F.col("weight").cast(number)).alias("weight"))
    if query_cut is not None:
        heaviest = Window.partitionBy("qid").orderBy(F.desc("weight"), F.asc("term"))
        asked = asked.withColumn("cut", F.row_number().over(heaviest) <= query_cut)
    sizes = query_terms.agg(F.count(F.lit(1)), F.countDistinct("id")).first()
    chunks = max(1, math.ceil(sizes[0] / chunk_postings), math.ceil(sizes[1] * k / chunk_kept))
    schema = f"qid string, docid string, score {number}"
    stored = ["folder"] if "folder" in blocks.columns else []
    columns = [*stored, "block", "ids", "terms", "ends", "docs", "weights", "tops"]

    def search(rows: DataFrame) -> DataFrame:
        sent = blocks.sparkSession.sparkContext.broadcast((_chunk(rows, whole), dead))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk, gone = sent.value
            search = _Search(chunk, k)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(j)[i] for j, c in enumerate(columns)}
                    block = _Block(row)
                    if gone:
                        block.gone[gone.get((row["folder"].as_py(), row["block"].as_py()), [])] = True
                    if not whole:
                        block.weights = block.weights.astype(float)
                    search.add(block)
            if len(search.query):
                yield search.batch()

        found = blocks.select(*columns).mapInArrow(run, schema)
        return top_k(found, ["qid"], [F.desc("score"), F.asc("docid")], k, "rank", spread="docid")

    if chunks == 1:
        return search(asked)
    asked = settled(asked, "asked")
    spark, base = blocks.sparkSession, fresh_path(blocks.sparkSession, "found")
    for i in range(chunks):
        found = search(asked.where(F.pmod(F.xxhash64("qid"), F.lit(chunks)) == i))
        found.write.parquet(f"{base}/{i}")
    return spark.read.schema(found.schema).option("recursiveFileLookup", True).parquet(base)
