"""Term statistics and postings that follow a stream of document versions.

The state of a document is its last version and that version's terms, as the batches before have written them down. A
newer version gives the changes that it makes to document frequencies; an older or repeated one gives none, so the order
of arrival does not matter. Each micro-batch looks up the documents that it names among those written down, and adds its
changes to the totals of the batch before: one scan of the versions that counted, and the vocabulary. No text is read
again, and no state is held in memory. Versions are written down by slices of their ids, and a large batch meets them
some slices at a time, so that what lies on disk for a shuffle does not grow with the batch. A batch that runs again after a failure writes the same folders again, from the
same totals and versions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillrank.functions.text import LEXICAL, WordTokenizer
from quillrank.operators import sparse
from quillrank.operators.placement import fits_broadcast
from quillrank.session import dropped, fresh_path, shuffles_dropped

CHANGES = "id string, version long, term string, change int, terms array<string>"
VERSIONS = "id string, version long, terms array<string>"
TOTALS = "term string, df long"
SLICES = 16
#: Terms of the versions that are shuffled at once, about, as far as there are slices for it.
SHUFFLED_TERMS = 5_000_000


class TokenLists(WordTokenizer):
    """Stands for a tokeniser where texts are token lists already."""

    def one(self, tokens: Column) -> Column:
        return tokens

    def many(self, lists: Column) -> Column:
        return lists


def _slice() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int")


def _in_turn(terms: int) -> list[Column]:
    """Conditions that part the slices so that each has about SHUFFLED_TERMS of this many terms. Rows written down without
    a slice, as they were before, have that of their id."""
    n = min(SLICES, max(1, math.ceil(terms / SHUFFLED_TERMS)))
    written = F.col("slice")
    return [written.isin(own) | (written.isNull() & _slice().isin(own)) for own in (list(range(i, SLICES, n)) for i in range(n))]


def version_terms(versions: DataFrame, tokenizer=LEXICAL) -> DataFrame:
    """(id, version, terms) of versions (id, version, text). Rows without an id or a version are left out, a null text
    has no terms."""
    terms = F.array_sort(F.array_distinct(tokenizer.one(F.coalesce(F.col("text"), F.lit("")))))
    rows = versions.select(F.col("id").cast("string").alias("id"), F.col("version").cast("long").alias("version"), terms.alias("terms"))
    return rows.where(F.col("id").isNotNull() & F.col("version").isNotNull())


def _highest(rows: DataFrame, name: str) -> DataFrame:
    """The highest version of each document; of several texts with the same one, the largest list of terms."""
    return rows.groupBy("id").agg(F.max(F.struct("version", "terms")).alias(name))


def term_changes(arrived: DataFrame, known: DataFrame) -> DataFrame:
    """What rows (id, version, terms) change against the known last versions: a row without a term for each version that
    counts, with the version's terms and 1 where the document is new, and a row per term that a known document gains or
    loses. The terms that a new one gains are those of its row. `arrived` is read twice, so stored rows are best.
    """
    ids = arrived.select("id").distinct()
    held = known.join(F.broadcast(ids), "id", "left_semi") if fits_broadcast(ids) else known
    both = _highest(arrived, "new").join(_highest(held, "old"), "id", "left")
    both = both.where(F.col("old").isNull() | (F.col("new") > F.col("old")))
    none = F.array().cast("array<string>")
    new, old = F.col("new.terms"), F.coalesce(F.col("old.terms"), none)
    change = lambda term, by, terms: F.struct(term.cast("string").alias("term"), by.cast("int").alias("change"), terms.cast("array<string>").alias("terms"))
    each = lambda found, by: F.transform(found, lambda x: change(x, F.lit(by), F.lit(None)))
    version = F.array(change(F.lit(None), F.col("old").isNull(), new))
    moved = F.concat(version, each(F.array_except(new, old), 1), each(F.array_except(old, new), -1))
    rows = F.when(F.col("old").isNull(), version).otherwise(moved)
    return both.select("id", F.col("new.version").alias("version"), F.explode(rows).alias("_c")).select("id", "version", "_c.*")


def _batches(spark: SparkSession, out: str) -> list[int]:
    """The batches whose totals are whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/totals/batch_id=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def follow_stream(versions: DataFrame, out: str, checkpoint: str, tokenizer=LEXICAL, available_now: bool = True) -> StreamingQuery:
    """Keeps changes and running totals of a stream (id, version, text) below `out`."""

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place, rows = f"{out}/changes/batch_id={batch_id}", fresh_path(spark, "arrived")
        before = [b for b in _batches(spark, out) if b < batch_id]
        known = _counted(spark, out, before)
        with shuffles_dropped(spark):
            _write(batch.withColumn("slice", _slice()), rows, "slice")
            arrived = spark.read.schema(f"{VERSIONS}, slice int").parquet(rows)
            terms = arrived.agg(F.sum(F.size("terms"))).first()[0] or 0
            for i, own in enumerate(_in_turn(terms)):
                changes = term_changes(arrived.where(own).drop("slice"), known.where(own).drop("slice"))
                _write(changes.withColumn("slice", _slice()), f"{place}/part={i}", "slice")
            dropped(spark, rows)
            changes = spark.read.schema(CHANGES).parquet(place)
            new = changes.where("term is null and change = 1").select(F.explode("terms").alias("term")).where("term is not null")
            totals = changes.select("term", F.col("change").cast("long").alias("df")).unionAll(new.select("term", F.lit(1).cast("long")))
            if before:
                totals = totals.union(spark.read.schema(TOTALS).parquet(f"{out}/totals/batch_id={before[-1]}"))
            summed = totals.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            _write(summed, f"{out}/totals/batch_id={batch_id}")

    writer = version_terms(versions, tokenizer).writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def statistics(spark: SparkSession, out: str) -> tuple[DataFrame, int]:
    """(term, df) and the number of documents, as far as the stream has come; for sparse.lexical_weights."""
    batches = _batches(spark, out)
    if not batches:
        return spark.createDataFrame([], TOTALS), 0
    totals = spark.read.schema(TOTALS).parquet(f"{out}/totals/batch_id={batches[-1]}")
    documents = totals.where("term is null").first()
    return totals.where("term is not null"), documents["df"] if documents else 0


def _counted(spark: SparkSession, out: str, batches: list[int]) -> DataFrame:
    """(id, version, terms, slice) of all versions that counted up to the last of these batches."""
    if not batches:
        return spark.createDataFrame([], f"{VERSIONS}, slice int")
    # Only batches whose totals are whole, so that postings and statistics tell of the same documents.
    rows = spark.read.option("basePath", f"{out}/changes").schema(f"{CHANGES}, batch_id long, slice int").parquet(f"{out}/changes")
    return rows.where(F.col("term").isNull() & (F.col("batch_id") <= batches[-1])).select("id", "version", "terms", "slice")


def documents(spark: SparkSession, out: str) -> DataFrame:
    """(id, version, terms) of each document's last version."""
    return _highest(_counted(spark, out, _batches(spark, out)), "last").select("id", "last.version", "last.terms")


def postings(spark: SparkSession, out: str) -> DataFrame:
    """(id, term, weight) of the last versions, weighed by the statistics that the stream has come to."""
    frequencies, n = statistics(spark, out)
    counted, path = _counted(spark, out, _batches(spark, out)), fresh_path(spark, "last")
    with shuffles_dropped(spark):
        for i, own in enumerate(_in_turn(frequencies.agg(F.sum("df")).first()[0] or 0)):
            _write(_highest(counted.where(own), "last").select("id", F.col("last.terms").alias("text")), f"{path}/part={i}")
    rows = spark.read.schema("id string, text array<string>").parquet(path)
    return sparse.lexical_weights(rows, frequencies, n, TokenLists())
