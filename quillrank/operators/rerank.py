"""Rerank input, reranking and the small lookup joins around runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.placement import attach, running_total, spread_join, top_k

MAX_LIST = 100_000


def rerank_input(run: DataFrame, queries: DataFrame, corpus: DataFrame, depth: int = 1000) -> DataFrame:
    """First `depth` documents of each known query with both texts (query_id, query, docid, title, text, score)."""
    best = top_k(run.select("qid", "docid", "score"), ["qid"], [F.desc("score"), F.asc("docid")], depth, spread="docid")
    asked = spread_join(best, queries.select(F.col("query_id").alias("qid"), "query"), "qid", "inner", ["docid"])
    told = attach(asked, corpus.select("docid", "title", "text"), "docid", ["qid"])
    return told.select(F.col("qid").alias("query_id"), "query", "docid", "title", "text", F.col("score").cast("float").alias("score"))


def missing_keys(run: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """How many run rows name an unknown query or document."""
    no_query = spread_join(run, queries.select(F.col("query_id").alias("qid")), "qid", "left_anti", ["docid"])
    no_doc = spread_join(run, corpus.select("docid"), "docid", "left_anti", ["qid"], right_fits=False)
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"))
    return count(no_query, "query").unionByName(count(no_doc, "document"))


def rerank(pairs: DataFrame, score: Column) -> DataFrame:
    """Scores each pair and ranks per query; a query holds at most the depth of its first search."""
    scored = pairs.select(F.col("query_id").alias("qid"), "docid", score.alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("docid"))
    return scored.withColumn("rank", F.row_number().over(order))


def add_titles(passages: DataFrame, titles: DataFrame) -> DataFrame:
    """Left join on docid; a passage without a title gets an empty one."""
    joined = passages.join(titles.select("docid", "title"), "docid", "left")
    return joined.withColumn("title", F.coalesce("title", F.lit("")))


def grouped_lists(rows: DataFrame, key: str, value: str, name: str, max_list: int = MAX_LIST) -> DataFrame:
    """Distinct-or-not values of a key as lists, in value order: (key, part, list).

    A list longer than `max_list` goes on in the next part, so a hot key is never one row or one task. Equal
    values are counted first and then repeated, so they cost one row each in the shuffle.
    """
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counted, [key, value], F.col("_n"), [key], "_before")
    first, last = F.col("_before"), F.col("_before") + F.col("_n") - 1
    parts = F.explode(F.sequence((first / max_list).cast("long"), (last / max_list).cast("long")))
    split = placed.withColumn("part", parts)
    low = F.greatest(first, F.col("part") * max_list)
    high = F.least(last, F.col("part") * max_list + (max_list - 1))
    entry = F.struct(F.col(value).alias("v"), (high - low + 1).cast("int").alias("n"))
    lists = split.groupBy(key, "part").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    flat = F.flatten(F.transform("_e", lambda e: F.array_repeat(e["v"], e["n"])))
    return lists.select(key, "part", flat.alias(name))


def group_negatives(triples: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """Triples (qid, positive, negative) to the comma list of each query's negatives."""
    lists = grouped_lists(triples, "qid", "negative", "items", max_list)
    return lists.select("qid", "part", F.array_join("items", ",").alias("negatives"))


def lookup_positives(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Judged documents of each query."""
    left = queries.select(F.col("query_id").alias("qid"), "query")
    return spread_join(qrels.where(F.col("rel") > 0).select("qid", "docid"), left, "qid", "inner", ["docid"])
