"""Encoding of texts as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving_texts(
    spark: SparkSession, path: str, schema: str, kind: str = "parquet", glob: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """File stream: every new file below the path is read once. The path may be a folder or a single file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if glob is None and system.exists(place) and system.getFileStatus(place).isFile():
        # A stream reads folders: of this one, the file alone.
        path, glob = place.getParent().toString(), place.getName()
    reader = spark.readStream.schema(schema).format(kind)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def encode_stream(
    texts: DataFrame, encode: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Encodes each micro-batch and stores it in the folder of its batch id.

    A batch that runs again after a failure writes the same folder again, so no posting appears twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        encode(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = texts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_encoded(spark: SparkSession, out: str, id_col: str = "id") -> DataFrame:
    """Postings of all batches so far. A document that arrived again has those of its latest batch only."""
    rows = spark.read.parquet(out)
    latest = rows.groupBy(id_col).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(latest, [id_col, "batch_id"], "left_semi").drop("batch_id")
