"""Writers. Each gives a folder of part files, one per task; order within a query is kept by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.operators.placement import running_total
from quillrank.operators.sparse import repeated_tokens
from quillrank.session import settled


def corpus_lines(vectors: DataFrame, content_key: str = "content") -> DataFrame:
    """(id, vector) to JSON lines; `contents` is the other usual key name."""
    row = F.struct("id", F.lit("").alias(content_key), "vector")
    return vectors.select(F.to_json(row).alias("value"))


def query_lines(vectors: DataFrame, repeated: bool = False) -> DataFrame:
    """(id, vector) to `id TAB json`, or to repeated terms for whole weights."""
    if repeated:
        return repeated_tokens(vectors).select(F.concat_ws("\t", "id", "tokens").alias("value"))
    return vectors.select(F.concat_ws("\t", F.col("id"), F.to_json("vector")).alias("value"))


def write_lines(lines: DataFrame, path: str, files: int | None = None) -> None:
    (lines if files is None else lines.coalesce(files)).write.mode("overwrite").text(path)


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    """All shards as one frame; a folder of shards needs only one reader."""
    merged = shards[0]
    for shard in shards[1:]:
        merged = merged.unionByName(shard)
    return merged


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def with_rank(run: DataFrame, remove_query: bool = False) -> DataFrame:
    """Rank from 1 by score; a document that is the query itself can go first.

    Places are running totals over key ranges, so a query with very many lines is not one task.
    """
    kept = run.where(F.col("qid") != F.col("docid")) if remove_query else run
    keyed = kept.select("qid", "docid", "score", (-F.col("score")).alias("_down"))
    placed = running_total(keyed, ["qid", "_down", "docid"], group=["qid"], name="rank")
    return placed.withColumn("rank", F.col("rank") + 1).drop("_down")


def run_lines(run: DataFrame) -> DataFrame:
    """`qid TAB docid TAB score`, best first per query."""
    return _ordered(run, F.concat_ws("\t", "qid", "docid", F.col("score").cast("string")))


def rank_lines(run: DataFrame) -> DataFrame:
    """`qid TAB docid TAB rank`."""
    return _ordered(with_rank(run), F.concat_ws("\t", "qid", "docid", F.col("rank").cast("string")))


def trec_lines(run: DataFrame, tag: str = "dense", remove_query: bool = False) -> DataFrame:
    """`qid Q0 docid rank score tag`."""
    ranked = with_rank(run, remove_query)
    score, rank = F.col("score").cast("string"), F.col("rank").cast("string")
    return _ordered(ranked, F.concat_ws(" ", "qid", F.lit("Q0"), "docid", rank, score, F.lit(tag)))


def _ordered(run: DataFrame, line: Column) -> DataFrame:
    """Lines by query and score; a range sort, so a large run is written by many tasks in order."""
    return run.orderBy("qid", F.desc("score"), "docid").select(line.alias("value"))


def write_run(run: DataFrame, path: str) -> None:
    write_lines(run_lines(run), path)


def write_ranks(run: DataFrame, path: str) -> None:
    write_lines(rank_lines(run), path)


def write_trec(run: DataFrame, path: str, tag: str = "dense", remove_query: bool = False) -> None:
    write_lines(trec_lines(run, tag, remove_query), path)


def write_json_shards(rows: DataFrame, path: str, shard_rows: int = 45_000) -> None:
    """JSON files of at most `shard_rows` rows."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", shard_rows).json(path)


def write_json_splits(rows: DataFrame, path: str, n_splits: int, key: str) -> None:
    """`n_splits` JSON files in key order, whose sizes differ by one row at most; with fewer rows, a file for each.

    Rows are numbered by the unique key, so which file a row is in follows from its place alone.
    """
    placed = settled(running_total(rows, [key], name="_place"), "placed")
    total = max(placed.count(), 1)
    split = F.floor(F.col("_place") * n_splits / F.lit(total)).cast("int")
    split_rows = placed.repartitionById(n_splits, split).sortWithinPartitions("_place").drop("_place")
    split_rows.write.mode("overwrite").json(path)


