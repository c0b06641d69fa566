"""Sparse encoding: activations, pooling, top terms and quantising."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import sparse
from quillrank.operators.placement import running_total
from quillrank.plans import tables as t
from quillrank.plans.registry import part, query, using

_WORD = regex.compile(tx.WORD_PATTERN)


def _rounded(df, digits=6):
    return df.withColumn("weight", F.round("weight", digits))


def word_length_encoder(batch: pd.DataFrame) -> pd.DataFrame:
    """A model stand-in for the batch step: the logit of a word is a tenth of its length."""
    rows = [(i, p, w, len(w) / 10.0) for i, x in zip(batch["id"], batch["text"]) for p, w in enumerate(_WORD.findall(x.lower()))]
    return pd.DataFrame(rows, columns=["id", "pos", "term", "logit"])


@query("e1_batch_encode", using("SELECT id, pos, term, round(length(term) / 10.0, 6) AS logit FROM doc_tokens", "doc_tokens"))
def _(spark, d):
    out = sparse.encode_batches(t.encoder_docs(spark, d), word_length_encoder)
    return out.withColumn("logit", F.round("logit", 6))


@query(
    "e1_pooled_batches",
    using(
        "WITH a AS (SELECT id, pos, term, length(term) / 10.0 AS logit, count(*) OVER (PARTITION BY id) AS n FROM doc_tokens) "
        "SELECT how, id, term, round(ln(1 + w), 6) AS weight FROM ("
        "SELECT 'max' AS how, id, term, max(logit) AS w FROM a GROUP BY id, term "
        "UNION ALL SELECT 'mean', id, term, sum(logit) / any_value(n) FROM a GROUP BY id, term "
        "UNION ALL SELECT 'last', id, term, logit FROM a WHERE pos = n - 1)",
        "doc_tokens",
    ).replace("\nWITH a AS", ",\na AS", 1),
)
def _(spark, d):
    rows = t.encoder_docs(spark, d)
    pooled = lambda how: sparse.encode_pooled(rows, word_length_encoder, how).select(F.lit(how).alias("how"), "id", "term", "weight")
    return _rounded(pooled("max").unionByName(pooled("mean")).unionByName(pooled("last")))


@query("e1_lexical_activations", using("SELECT id, pos, term, round(logit, 6) AS logit FROM activations", "activations"))
def _(spark, d):
    return t.activations(spark, d).withColumn("logit", F.round("logit", 6))


@query("e2_max_pooling", using("SELECT id, term, round(weight, 6) AS weight FROM doc_max", "doc_max"))
def _(spark, d):
    return _rounded(sparse.pool(t.activations(spark, d), "max"))


@query(
    "e3_mean_pooling",
    using(
        "SELECT id, term, round(ln(1 + greatest(sum(logit) / any_value(s), 0)), 6) AS weight FROM activations "
        "JOIN (SELECT id, count(*) AS s FROM doc_tokens GROUP BY id) USING (id) GROUP BY id, term",
        "activations",
    ),
)
def _(spark, d):
    sizes = t.encoder_docs(spark, d).select("id", F.size(tx.lexical_tokens(F.col("text"))).alias("n_tokens"))
    return _rounded(sparse.pool(t.activations(spark, d), "mean", sizes))


@query(
    "e4_last_pooling",
    using(
        "SELECT id, term, round(ln(1 + greatest(logit, 0)), 6) AS weight FROM activations QUALIFY pos = max(pos) OVER (PARTITION BY id)",
        "activations",
    ),
)
def _(spark, d):
    return _rounded(sparse.pool(t.activations(spark, d), "last"))


part("doc_top32", "SELECT id, term, weight FROM doc_max QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) <= 32", "doc_max")


@query("e6_top_terms", using("SELECT id, term, round(weight, 6) AS weight FROM doc_top32", "doc_top32"))
def _(spark, d):
    pooled = sparse.pool_max(t.activations(spark, d, every_position=False), by_row=True)
    return _rounded(sparse.top_terms(pooled, 32))


def _shifted(spark, d):
    """Weights less one, so that some fall to zero or below."""
    pooled = sparse.pool_max(t.activations(spark, d, every_position=False))
    return pooled.withColumn("weight", F.col("weight") - 1.0)


@query("e8_positive_weights", using("SELECT id, term, round(weight - 1.0, 6) AS weight FROM doc_max WHERE weight - 1.0 > 0", "doc_max"))
def _(spark, d):
    return _rounded(sparse.positive_weights(_shifted(spark, d)))


@query(
    "e9_quantise_round",
    using("SELECT id, term, CAST(round_even((weight - 1.0) * 100, 0) AS INT) AS weight FROM doc_max WHERE round_even((weight - 1.0) * 100, 0) > 0", "doc_max"),
)
def _(spark, d):
    return sparse.quantise(_shifted(spark, d))


@query(
    "e10_quantise_ceil",
    using("SELECT id, term, CAST(ceil((weight - 1.0) * 100) AS INT) AS weight FROM doc_max WHERE ceil((weight - 1.0) * 100) > 0", "doc_max"),
)
def _(spark, d):
    return sparse.quantise(_shifted(spark, d), "ceil")


@query(
    "e11_empty_fallback",
    using(
        "SELECT id, coalesce(term, '[PAD]') AS term, coalesce(w, 1) AS weight FROM enc_docs LEFT JOIN "
        "(SELECT id, term, CAST(round_even((weight - 1.9) * 100, 0) AS INT) AS w FROM doc_max WHERE round_even((weight - 1.9) * 100, 0) > 0) USING (id)",
        "doc_max",
    ),
)
def _(spark, d):
    heavy = _shifted(spark, d).withColumn("weight", F.col("weight") + 1.0 - 1.9)
    return sparse.fill_empty(sparse.quantise(heavy), t.encoder_docs(spark, d))


def _vocabulary(spark, d):
    """Terms with their place in sorted order as id."""
    return running_total(t.frequencies(spark, d), ["term"], name="term_id")


part("vocabulary", "SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS term_id FROM frequencies", "frequencies")


@query(
    "e12_term_names",
    using("SELECT id, term, weight FROM doc_post JOIN vocabulary USING (term) WHERE df >= 2", "doc_post", "vocabulary"),
)
def _(spark, d):
    names = _vocabulary(spark, d)
    coded = t.doc_postings(spark, d).join(names, "term").select("id", "term_id", F.col("weight").cast("long").alias("weight"))
    return sparse.name_terms(coded, names.where(F.col("df") >= 2).select("term_id", "term"))


@query(
    "e13_token_scatter",
    using(
        "SELECT id, term_id, round(max((length(term) - 4) / 10.0), 6) AS weight FROM doc_tokens JOIN vocabulary USING (term) "
        "WHERE term_id NOT IN (0, 101, 102, 103) GROUP BY id, term_id HAVING max(length(term) - 4) > 0",
        "doc_tokens",
        "vocabulary",
    ),
)
def _(spark, d):
    rows = t.encoder_docs(spark, d).select("id", F.explode(tx.lexical_tokens(F.col("text"))).alias("term"))
    coded = rows.join(_vocabulary(spark, d), "term")
    weights = coded.select("id", "term_id", ((F.length("term") - 4) / 10.0).alias("weight"))
    return _rounded(sparse.scatter_max(weights))


@query(
    "e14_l2_normalise",
    using("SELECT id, term, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)), 6) AS weight FROM doc_post", "doc_post"),
)
def _(spark, d):
    return _rounded(sparse.l2_normalise(t.doc_postings(spark, d).withColumn("weight", F.col("weight").cast("double"))))


@query(
    "e15_sparsity_report",
    using(
        "SELECT round(sum((m / n) * (m / n)), 4) AS flops, round(sum(a) / any_value(n), 6) AS active_terms, count(*) AS terms FROM "
        "(SELECT term, CAST(sum(weight) AS DOUBLE) AS m, count(*) AS a FROM doc_post GROUP BY term), n",
        "doc_post",
        "n",
    ),
)
def _(spark, d):
    report = sparse.sparsity_report(t.doc_postings(spark, d), t.doc_count(spark, d))
    return report.select(F.round("flops", 4).alias("flops"), F.round("active_terms", 6).alias("active_terms"), "terms")
