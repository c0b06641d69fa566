"""A stored index of vectors by cell: search reads the cells that its queries look into, and no others.

Below the index path, each folder `vectors-*` holds rows (id, embedding) in a folder per cell; `centers` holds the
cells' centres and the names of the folders that count, and is written last.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators import search
from quillrank.session import fresh_path, settled

FILE_ROWS = 1_000_000
ASSIGNED = "id string, embedding array<float>, cell int"


def nearest_cell(docs: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, embedding, cell): the cell whose centre is nearest, the lower number on ties."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = np.stack(batch.column(1).to_pylist()).astype(np.float64)
                cell = search._nearest_cells(vectors, centers, 1)[:, 0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "embedding", "cell"])

    rows = docs.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.where(F.col("embedding").isNotNull()).mapInArrow(run, ASSIGNED)


class CellIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _state(self) -> tuple[np.ndarray, list[str]]:
        rows = self.spark.read.schema("cell int, center array<double>, folders array<string>").parquet(f"{self.path}/centers").orderBy("cell").collect()
        return np.array([r["center"] for r in rows]), rows[0]["folders"]

    def centers(self) -> np.ndarray:
        return self._state()[0]

    def _store(self, docs: DataFrame, centers: np.ndarray) -> str:
        """Vectors into a folder of their own; a cell with many of them is several files, written by several tasks."""
        folder = f"vectors-{uuid.uuid4().hex}"
        placed = settled(nearest_cell(docs, centers), "celled")
        sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
        most = max(sizes.values(), default=1)
        files = F.pmod(F.xxhash64("id"), F.lit(math.ceil(most / FILE_ROWS)))
        tasks = max(1, sum(math.ceil(n / FILE_ROWS) for n in sizes.values()))
        placed.repartition(tasks, "cell", files).write.partitionBy("cell").parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, centers: np.ndarray, folders: list[str]) -> None:
        rows = [(i, [float(x) for x in c], folders) for i, c in enumerate(centers)]
        state = self.spark.createDataFrame(rows, "cell int, center array<double>, folders array<string>")
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centers")

    def write(self, docs: DataFrame, centers: np.ndarray) -> None:
        """A new index over these documents; one in place is replaced when the new one is whole."""
        centers = np.asarray(centers, dtype=np.float64)
        self._commit(centers, [self._store(docs, centers)])

    def add(self, docs: DataFrame) -> None:
        """More documents into the cells there are; ids are not compared with those inside."""
        centers, folders = self._state()
        self._commit(centers, [*folders, self._store(docs, centers)])

    def documents(self, cells: list[int] | None = None) -> DataFrame:
        """(id, embedding, cell) of the given cells; only their folders are read."""
        folders = self._state()[1]
        parts = [self.spark.read.schema(ASSIGNED).parquet(f"{self.path}/{f}") for f in folders]
        out = parts[0]
        for other in parts[1:]:
            out = out.unionByName(other)
        return out if cells is None else out.where(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int = 1000, probes: int = 4, chunk_rows: int = search.DENSE_QUERY_ROWS) -> DataFrame:
        """Inner-product search in the `probes` nearest cells of each query, scored exactly: (qid, docid, score, rank).

        Queries go to the tasks in chunks. They are dealt out by their nearest cell, so a chunk looks into few cells.
        """
        centers = self.centers()
        near = nearest_cell(queries, centers).withColumnRenamed("cell", "home")
        near = settled(near, "near")
        sizes = {r["home"]: r["count"] for r in near.groupBy("home").count().collect()}
        rows = max(1, min(chunk_rows, search.DENSE_KEPT // k))
        chunks: list[list[tuple[int, int, int]]] = [[]]
        held = 0
        for home, n in sorted(sizes.items()):
            # A cell with more queries than a chunk holds is dealt out by the hash of their id.
            pieces = math.ceil(n / rows)
            for piece in range(pieces):
                if held and held + n / pieces > rows:
                    chunks.append([])
                    held = 0
                chunks[-1].append((home, pieces, piece))
                held += n / pieces
        if len(chunks) == 1:
            return self._chunk(near, centers, k, probes)
        base = fresh_path(self.spark, "found")
        for i, own in enumerate(chunks):
            among = F.lit(False)
            for home, pieces, piece in own:
                among = among | ((F.col("home") == home) & (F.pmod(F.xxhash64("id"), F.lit(pieces)) == piece))
            found = self._chunk(near.where(among), centers, k, probes)
            found.write.parquet(f"{base}/{i}")
        return self.spark.read.schema(found.schema).option("recursiveFileLookup", True).parquet(base)

    def _chunk(self, queries: DataFrame, centers: np.ndarray, k: int, probes: int) -> DataFrame:
        sent, q_ids = search._send_queries(queries.select("id", "embedding"))
        if not len(q_ids.value):
            return search._best(self.spark.createDataFrame([], search.SCORED), k)
        nearest = search._nearest_cells(sent.value, centers, probes)
        return search._best(search._in_cells(self.documents(np.unique(nearest).tolist()), sent, q_ids, nearest, k), k)
