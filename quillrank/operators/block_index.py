"""A stored sparse index that grows: generations of blocks, documents taken out by place, and a manifest that is switched at once.

Layout below the index path: `blocks-*` folders hold blocks, `dead-*` folders the places in older blocks of documents
that were replaced or deleted, and `manifest/v*` the folders that make up a version. A version counts once its write is
complete, so a reader sees either the version before or the one after, whatever breaks off. Of two writers that start
from the same version, the second fails.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators import blocks as bl
from quillrank.operators.placement import fits_broadcast
from quillrank.session import settled

MANIFEST = "kind string, folder string, documents long, weight string"
MAX_DEAD = 4_000_000
DEAD_SHARE = 0.25


class BlockIndex:
    def __init__(self, spark: SparkSession, path: str, block_postings: int = bl.BLOCK_POSTINGS):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.spark, self.block_postings = spark, block_postings
        self._files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self._files.makeQualified(place).toString().rstrip("/")

    def version(self) -> int:
        """The number of the version in use; 0 where there is no index."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/v*/_SUCCESS")
        found = self._files.globStatus(done) or []
        return max((int(f.getPath().getParent().getName()[1:]) for f in found), default=0)

    def manifest(self) -> list:
        version = self.version()
        return self.spark.read.schema(MANIFEST).parquet(self._place(version)).collect() if version else []

    def _place(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:08d}"

    def _switch(self, version: int, rows: list[tuple]) -> None:
        """A fixed path per version and no overwriting: a writer that comes second fails here."""
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(self._place(version + 1))

    def _write_blocks(self, postings: DataFrame) -> tuple | None:
        """Blocks in a folder of their own, and their line of the manifest; None without postings."""
        folder = f"blocks-{uuid.uuid4().hex}"
        packed = bl.pack(postings, self.block_postings)
        packed.withColumn("folder", F.lit(folder)).write.parquet(f"{self.path}/{folder}")
        documents = self.spark.read.schema(packed.schema).parquet(f"{self.path}/{folder}").agg(F.sum(F.size("ids"))).first()[0]
        weight = packed.schema["weights"].dataType.elementType.simpleString()
        return ("blocks", folder, documents, weight) if documents else None

    def _folders(self, lines: list, kind: str) -> list[str]:
        return [f"{self.path}/{x['folder']}" for x in lines if x["kind"] == kind]

    def blocks(self, lines: list | None = None) -> DataFrame:
        """All blocks of the version, with the folder each is in; dead documents are still inside."""
        lines = self.manifest() if lines is None else lines
        kinds = {x["weight"] for x in lines if x["kind"] == "blocks"} or {"bigint"}
        parts = []
        for kind in sorted(kinds):
            own = [f"{self.path}/{x['folder']}" for x in lines if x["kind"] == "blocks" and x["weight"] == kind]
            schema = f"{bl.block_schema(kind)}, folder string"
            rows = self.spark.read.schema(schema).parquet(*own) if own else self.spark.createDataFrame([], schema)
            if len(kinds) > 1:
                floats = {c: F.col(c).cast("array<double>") for c in ("weights", "tops")}
                rows = rows.withColumns(floats)
            parts.append(rows)
        out = parts[0]
        for other in parts[1:]:
            out = out.unionByName(other)
        return out

    def _dead(self, lines: list) -> DataFrame:
        schema, own = "folder string, block int, place int", self._folders(lines, "dead")
        rows = self.spark.read.schema(schema).parquet(*own) if own else self.spark.createDataFrame([], schema)
        return rows.distinct()

    def _take_out(self, lines: list, ids: DataFrame) -> tuple | None:
        """The places of the documents in the blocks there are, written down; only ids are read and compared."""
        places = self.blocks(lines).select("folder", "block", F.posexplode("ids").alias("place", "id"))
        ids = settled(ids.select(F.col("id").cast("string").alias("id")).dropna().distinct(), "ids")
        found = places.join(F.broadcast(ids) if fits_broadcast(ids) else ids, "id", "left_semi").select("folder", "block", "place")
        name = f"dead-{uuid.uuid4().hex}"
        found.write.parquet(f"{self.path}/{name}")
        count = self.spark.read.schema(found.schema).parquet(f"{self.path}/{name}").count()
        return ("dead", name, count, "") if count else None

    def rebuild(self, postings: DataFrame, bad_lines: int = 0) -> None:
        """A version with these postings alone. `bad_lines` keeps the number of lines that could not be read for it."""
        version = self.version()
        line = self._write_blocks(postings)
        self._switch(version, [x for x in (line, ("bad", "", bad_lines, "")) if x])

    def bad_lines(self) -> int:
        """Lines that could not be read when the index was built."""
        return sum(x["documents"] for x in self.manifest() if x["kind"] == "bad")

    def add(self, postings: DataFrame) -> None:
        """Adds documents; those whose id is there already are replaced."""
        self._change(postings, postings.select("id"))

    def delete(self, ids: DataFrame) -> None:
        """Takes out the documents of a column `id`; unknown ones do not matter."""
        self._change(None, ids)

    def _change(self, postings: DataFrame | None, ids: DataFrame) -> None:
        version, lines = self.version(), self.manifest()
        if postings is not None:
            postings = settled(postings.select("id", "term", "weight"), "added")
            ids = postings.select("id")
        gone = self._take_out(lines, ids) if self._folders(lines, "blocks") else None
        line = self._write_blocks(postings) if postings is not None else None
        lines = [tuple(x) for x in lines] + [x for x in (gone, line) if x]
        self._switch(version, lines)
        dead = sum(x[2] for x in lines if x[0] == "dead")
        if dead > min(MAX_DEAD, DEAD_SHARE * sum(x[2] for x in lines if x[0] == "blocks")):
            self.compact()

    def compact(self) -> None:
        """All documents that count, in one generation without dead places."""
        version, lines = self.version(), self.manifest()
        rows, kept = self.blocks(lines), [tuple(x) for x in lines if x["kind"] == "bad"]
        if self._folders(lines, "dead"):
            dead = self._dead(lines).groupBy("folder", "block").agg(F.collect_list("place").alias("dead"))
            rows = rows.join(dead, ["folder", "block"], "left")
        line = self._write_blocks(settled(bl.unpack(rows), "compacted"))
        self._switch(version, [line, *kept] if line else kept)

    def postings(self) -> DataFrame:
        """What counts in the version, as (id, term, weight)."""
        lines = self.manifest()
        dead = self._dead(lines).groupBy("folder", "block").agg(F.collect_list("place").alias("dead"))
        return bl.unpack(self.blocks(lines).join(dead, ["folder", "block"], "left"))

    def search(self, query_terms: DataFrame, k: int = 100, query_cut: int | None = None, **limits) -> DataFrame:
        """Best documents of the version in use; see blocks.topk. Dead places are few, as more of them lead to compaction."""
        lines = self.manifest()
        dead: dict[tuple[str, int], list[int]] = {}
        for row in self._dead(lines).toLocalIterator() if self._folders(lines, "dead") else ():
            dead.setdefault((row["folder"], row["block"]), []).append(row["place"])
        places = {at: np.array(x, np.int64) for at, x in dead.items()}
        return bl.topk(self.blocks(lines), query_terms, k, query_cut, places, **limits)

    def recover(self) -> None:
        """Removes versions that a writer left unfinished, so that the next one can go on; no writer may be running."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for f in self._files.globStatus(path(f"{self.path}/manifest/v*")) or []:
            if not self._files.exists(path(f.getPath(), "_SUCCESS")):
                self._files.delete(f.getPath(), True)

    def drop_old(self) -> None:
        """Removes folders and versions that the version in use does not name; no search on an older one may be running."""
        lines, path = self.manifest(), self.spark._jvm.org.apache.hadoop.fs.Path
        kept = {x["folder"] for x in lines} | {"manifest"}
        for f in self._files.listStatus(path(self.path)):
            if f.getPath().getName() not in kept:
                self._files.delete(f.getPath(), True)
        current = f"v{self.version():08d}"
        for f in self._files.listStatus(path(f"{self.path}/manifest")):
            if f.getPath().getName() != current:
                self._files.delete(f.getPath(), True)
