"""From documents to batches: quality, near duplicates, secrets, packing. Each stage is written and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import length_buckets, quality, secret_ledger, token_counts, token_groups
from quillrank.session import fresh_path, settled

TOKENIZER = "byte_bpe_50k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null and empty texts are judged by their form like others. Each row is judged, also those that repeat or have no id.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, labels).where("kept").select("row.*")


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row: that with the smallest id, rows without one last.

    What stays is decided by row, that is by id and text, so rows that share an id but not the text are judged apart, and
    of rows with the same id and text one stays. Texts without a word are similar to nothing: all their rows stay.
    A row is known by a 64-bit hash of its id and text.
    """
    row = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    found = token_groups.similar_documents(docs.select(row.alias("row"), "text"), "row").where("n_shingles > 0")
    ids = docs.select(row.alias("row"), "doc_id").groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    found = found.select("row", "component_id").distinct().join(ids, "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "copies")).alias("first")
    stay = settled(found.groupBy("component_id").agg(first).select("first.row", "first.copies"), "stay")
    gone = settled(found.select("row").join(stay, "row", "left_anti"), "gone")
    keyed = docs.select(row.alias("_row_hash"), *docs.columns)
    left = keyed.join(gone.withColumnRenamed("row", "_row_hash").hint("shuffle_hash"), "_row_hash", "left_anti")
    repeated = stay.where("copies > 1").select(F.col("row").alias("_row_hash"))
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = left.join(repeated, "_row_hash", "left_semi").dropDuplicates(["_row_hash"])
    return left.join(repeated, "_row_hash", "left_anti").unionByName(once).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars to match.

    A null text stays null. Rows that repeat and rows without an id are masked like others.
    """
    ledger = secret_ledger.Ledger(spark, fresh_path(spark, "ledger"))
    secret_ledger.scan(ledger, docs)
    return secret_ledger.redacted(secret_ledger.by_blob(ledger), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of every document, by its number of tokens.

    A null text has none. Rows that repeat and rows without an id get slots of their own.
    """
    counted = token_counts.token_counts(docs, public_tokenizers.path(TOKENIZER))
    return length_buckets.pack(counted.select("doc_id", "n_tokens"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", duplicates_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: Fitting, token hashing and bucket bounds are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage returns is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = fresh_path(spark, f"stage-{i}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
