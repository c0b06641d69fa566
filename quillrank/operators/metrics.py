"""Ranking metrics over runs (qid, docid, rank) and judgments (qid, docid, rel)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import mining
from quillrank.operators.placement import attach, spread_join, top_k
from quillrank.session import settled

METRICS = ("ndcg", "map", "recall", "precision", "mrr")


def rank_score(rank: Column) -> Column:
    """Score of a rank for tools that read scores."""
    return F.lit(1000.0) - rank


def query_metrics(
    run: DataFrame, qrels: DataFrame, ks: Sequence[int] = (10, 100), by: Sequence[str] = (), evaluated_only: bool = False
) -> DataFrame:
    """nDCG, MAP, recall, precision and MRR at each k, per query with a relevant document.

    A document judged several times for a query counts once, with its largest judgment; one that the run lists several
    times, with its best rank. A query missing from the run counts 0, or is left out with evaluated_only. `by` names columns, such as the
    dataset, that both sides share. Only judged hits up to the largest k are ever grouped.
    """
    key = [*by, "qid"]
    deepest = max(ks)
    relevant = qrels.where(F.col("rel") > 0).groupBy(*key, "docid").agg(F.max("rel").alias("rel"))
    hits = run.where(F.col("rank") <= deepest).select(*key, "docid", "rank").join(relevant, [*key, "docid"])
    hits = hits.groupBy(*key, "docid").agg(F.first("rel").alias("rel"), F.min("rank").alias("rank"))
    seen = Window.partitionBy(*key).orderBy("rank")
    hits = hits.withColumn("found", F.row_number().over(seen))
    log2 = lambda place: F.log2(place + F.lit(1.0))
    upto = lambda k, value: F.sum(F.when(F.col("rank") <= k, value).otherwise(F.lit(0.0)))
    gained = []
    for k in ks:
        gained += [
            upto(k, F.col("rel") / log2(F.col("rank"))).alias(f"dcg_{k}"),
            upto(k, F.col("found") / F.col("rank")).alias(f"ap_{k}"),
            upto(k, F.lit(1.0)).alias(f"hits_{k}"),
            F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias(f"first_{k}"),
        ]
    per_query = hits.groupBy(*key).agg(*gained)
    counts = relevant.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rel"))
    ideal_rank = top_k(relevant, key, [F.desc("rel"), F.asc("docid")], deepest, "rank", spread="docid")
    ideal = ideal_rank.groupBy(*key).agg(*[upto(k, F.col("rel") / log2(F.col("rank"))).alias(f"ideal_{k}") for k in ks])
    base = counts.join(ideal, key).join(per_query, key, "left")
    if evaluated_only:
        base = base.join(run.select(*key).distinct(), key, "left_semi")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = []
    for k in ks:
        out += [
            zero(F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).alias(f"ndcg_at_{k}"),
            zero(F.col(f"ap_{k}") / F.col("n_rel")).alias(f"map_at_{k}"),
            zero(F.col(f"hits_{k}") / F.col("n_rel")).alias(f"recall_at_{k}"),
            zero(F.col(f"hits_{k}") / F.lit(float(k))).alias(f"precision_at_{k}"),
            zero(F.lit(1.0) / F.col(f"first_{k}")).alias(f"mrr_at_{k}"),
        ]
    return base.select(*key, *out)


def evaluate(run: DataFrame, qrels: DataFrame, ks: Sequence[int] = (10, 100), evaluated_only: bool = False) -> DataFrame:
    """Means over queries, one row."""
    per_query = query_metrics(run, qrels, ks, evaluated_only=evaluated_only)
    names = [c for c in per_query.columns if c != "qid"]
    return per_query.agg(*[F.avg(c).alias(c) for c in names], F.count(F.lit(1)).alias("queries"))


def evaluate_datasets(run: DataFrame, qrels: DataFrame, ks: Sequence[int] = (10, 100)) -> DataFrame:
    """One row per dataset, and a mean row over datasets."""
    per_query = query_metrics(run, qrels, ks, by=["dataset"])
    names = [c for c in per_query.columns if c not in ("dataset", "qid")]
    table = per_query.groupBy("dataset").agg(*[F.avg(c).alias(c) for c in names])
    return table.rollup("dataset").agg(*[F.avg(c).alias(c) for c in names]).withColumn(
        "dataset", F.coalesce("dataset", F.lit("mean"))
    )


def answer_accuracy(
    run: DataFrame, corpus: DataFrame, answers: DataFrame, ks: Sequence[int] = (5, 20, 100), regex: bool = False
) -> DataFrame:
    """Share of queries (qid, answers) with an answer in one of the first k passages."""
    near = run.where(F.col("rank") <= max(ks)).select("qid", "docid", "rank")
    if regex:
        asked = spread_join(near, answers, "qid", "inner", ["docid"])
        told = attach(asked, corpus.select("docid", "text"), "docid", ["qid"])
        hits = told.where(tx.has_answer(F.col("text"), F.col("answers"), True))
    else:
        near = settled(near, "near")
        hits = near.join(mining.pairs_in_run(near, corpus, answers), ["qid", "docid"])
    first = hits.groupBy("qid").agg(F.min("rank").alias("first"))
    every = answers.select("qid").join(first, "qid", "left")
    share = lambda k: F.avg(F.when(F.col("first") <= k, F.lit(1.0)).otherwise(F.lit(0.0)))
    return every.agg(*[share(k).alias(f"accuracy_at_{k}") for k in ks])
