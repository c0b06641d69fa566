"""Flagship: encode the corpus, search it, and measure the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators import metrics, search
from quillrank.plans import tables


def search_and_evaluate(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Texts to postings, postings to the best k per query, best k to metrics by judgments."""
    postings = tables.doc_postings(spark, sf_dir)
    asked = tables.query_postings(spark, sf_dir)
    found = search.sparse_topk(postings, asked, k)
    report = metrics.evaluate(found, tables.qrels(spark, sf_dir), ks=(k,))
    return report.select(
        F.col("queries").cast("long").alias("queries"),
        *[F.round(f"{m}_at_{k}", 6).alias(f"{m}_at_{k}") for m in ("ndcg", "recall", "mrr")],
    )
