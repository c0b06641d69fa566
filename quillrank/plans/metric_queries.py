"""Ranking metrics and evaluation of vectors, classes, clusters and token labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.functions.vectors import cosine
from quillrank.operators import evaluation, metrics, search, text_rows
from quillrank.plans import tables as t
from quillrank.plans.registry import part, query, using

KS = (10, 100)


def _rounded(df, digits: int = 6):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


@query("m1_rank_score", using("SELECT qid, docid, CAST(1000 - rank AS DOUBLE) AS score FROM run", "run"))
def _(spark, d):
    return t.run(spark, d).select("qid", "docid", metrics.rank_score(F.col("rank")).alias("score"))


part("n_rel", "SELECT qid, count(*) AS n_rel FROM qrels WHERE rel > 0 GROUP BY qid", "qrels")
part(
    "hits",
    "SELECT qid, rank, rel, row_number() OVER (PARTITION BY qid ORDER BY rank) AS found FROM run JOIN qrels USING (qid, docid) WHERE rel > 0",
    "run",
    "qrels",
)
part(
    "ideal",
    "SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS rank FROM qrels WHERE rel > 0",
    "qrels",
)
_GAIN = "(SELECT sum(rel / log2(rank + 1)) FROM {0} x WHERE x.qid = n_rel.qid AND rank <= {1})"
FORMULAS = {
    "ndcg": lambda k: f"{_GAIN.format('hits', k)} / {_GAIN.format('ideal', k)}",
    "map": lambda k: f"(SELECT sum(found / rank) FROM hits x WHERE x.qid = n_rel.qid AND rank <= {k}) / n_rel",
    "recall": lambda k: f"(SELECT count(*) FROM hits x WHERE x.qid = n_rel.qid AND rank <= {k}) / n_rel",
    "precision": lambda k: f"(SELECT count(*) FROM hits x WHERE x.qid = n_rel.qid AND rank <= {k}) / {k}.0",
    "mrr": lambda k: f"1.0 / (SELECT min(rank) FROM hits x WHERE x.qid = n_rel.qid AND rank <= {k})",
}


def _metric_sql(name: str) -> str:
    columns = ", ".join(f"round(coalesce(CAST({FORMULAS[name](k)} AS DOUBLE), 0), 6) AS {name}_at_{k}" for k in KS)
    return using(f"SELECT qid, {columns} FROM n_rel", "n_rel", "hits", "ideal")


def _metric(name: str):
    def run(spark, d):
        per_query = metrics.query_metrics(t.run(spark, d), t.qrels(spark, d), KS)
        return _rounded(per_query.select("qid", *[f"{name}_at_{k}" for k in KS]))

    return run


for _name, _key in [("ndcg", "m2_ndcg"), ("map", "m3_map"), ("recall", "m4_recall"), ("precision", "m5_precision"), ("mrr", "m6_mrr")]:
    query(_key, _metric_sql(_name))(_metric(_name))


@query(
    "m7_answer_accuracy",
    using(
        "SELECT "
        + ", ".join(f"round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 6) AS accuracy_at_{k}" for k in (5, 20, 100))
        + " FROM queries LEFT JOIN (SELECT qid, min(rank) AS first FROM hits GROUP BY qid) ON qid = query_id",
        "queries",
        "hits",
    ),
)
def _(spark, d):
    return _rounded(metrics.answer_accuracy(t.run(spark, d), t.corpus(spark, d), t.answers(spark, d)))


_ALL = [f"{m}_at_{k}" for m in FORMULAS for k in KS]
_PER_QUERY = ", ".join(f"coalesce(CAST({FORMULAS[m](k)} AS DOUBLE), 0) AS {m}_at_{k}" for m in FORMULAS for k in KS)


part(
    "dataset_means",
    "SELECT dataset, " + ", ".join(f"avg({c}) AS {c}" for c in _ALL) + " FROM (SELECT "
    f"CASE WHEN length(query) < 250 THEN 'short' ELSE 'long' END AS dataset, n.* FROM (SELECT qid, {_PER_QUERY} FROM n_rel) n "
    "JOIN queries ON qid = query_id) GROUP BY dataset",
    "n_rel",
    "hits",
    "ideal",
    "queries",
)


@query(
    "m8_metric_table",
    using(
        "SELECT dataset, " + ", ".join(f"round({c}, 6) AS {c}" for c in _ALL) + " FROM dataset_means UNION ALL "
        "SELECT 'mean', " + ", ".join(f"round(avg({c}), 6)" for c in _ALL) + " FROM dataset_means",
        "dataset_means",
    ),
)
def _(spark, d):
    kind = t.queries(spark, d).select(
        F.col("query_id").alias("qid"), F.when(F.length("query") < 250, F.lit("short")).otherwise(F.lit("long")).alias("dataset")
    )
    table = metrics.evaluate_datasets(t.run(spark, d).join(kind, "qid"), t.qrels(spark, d).join(kind, "qid"), KS)
    return _rounded(table.select("dataset", *_ALL))


@query(
    "m8_run_evaluation",
    using(
        "SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _ALL) + f", count(*) AS queries FROM (SELECT qid, {_PER_QUERY} FROM n_rel)",
        "n_rel",
        "hits",
        "ideal",
    ),
)
def _(spark, d):
    return _rounded(metrics.evaluate(t.run(spark, d), t.qrels(spark, d), KS))


part(
    "vec_pairs",
    "SELECT a.id, list_cosine_similarity(a.e, b.e) AS cosine, 5.0 - abs(a.label - b.label) * 5.0 / 9.0 AS gold FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1",
    "vec",
)


def _vector_pairs(spark, d):
    """Each vector with the next one; the gold score falls with the distance of their labels."""
    rows = t.vectors(spark, d)
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    pairs = rows.join(following, "vec_id")
    gold = F.lit(5.0) - F.abs(F.col("label") - F.col("other_label")) * 5.0 / 9.0
    return evaluation.pair_cosine(pairs, "embedding", "other").withColumn("gold", gold)


@query("m9_pair_cosine", using("SELECT id, round(cosine, 6) AS cosine FROM vec_pairs", "vec_pairs"))
def _(spark, d):
    return _rounded(_vector_pairs(spark, d).select("id", "cosine"))


_AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(
    "m10_spearman",
    using(
        f"SELECT round(corr(a, b), 6) AS spearman, count(*) AS pairs FROM (SELECT {_AVG_RANK.format('cosine')} AS a, {_AVG_RANK.format('g')} AS b "
        "FROM (SELECT cosine, round(gold / 5.0, 9) AS g FROM vec_pairs))",
        "vec_pairs",
    ),
)
def _(spark, d):
    pairs = _vector_pairs(spark, d).withColumn("gold", F.round(text_rows.scale_score(F.col("gold"), 0.0, 5.0), 9))
    return _rounded(evaluation.spearman(pairs, "cosine", "gold"))


def _split_vectors(spark, d):
    rows = text_rows.split_by_percent(t.vectors(spark, d), ["vec_id"], 20)
    return rows.where("split = 'train'"), rows.where("split = 'validation'")


@query("m11_logistic_classification")
def _(spark, d):
    train, test = _split_vectors(spark, d)
    return evaluation.classify(train, test).select("id", F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("prediction"))


@query(
    "m11_fitted_classes",
    using("SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS DOUBLE) AS expected FROM vec WHERE label IS NOT NULL GROUP BY label", "vec"),
)
def _(spark, d):
    """What the fitted classifier expects of each class, to a tenth of a row: at the optimum the number of its rows."""
    fitted = evaluation.expected_classes(t.vectors(spark, d).where("label is not null"))
    return fitted.select(F.col("label").cast("long").alias("label"), F.round("expected", 1).alias("expected"))


part(
    "neighbour",
    "SELECT a.label AS label, b.label AS prediction FROM (SELECT qid, docid FROM dense WHERE qid <> docid "
    "QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) = 1) JOIN vec a ON a.id = qid JOIN vec b ON b.id = docid",
    "dense",
    "vec",
)


@query(
    "m12_classification_report",
    using(
        "SELECT round((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM neighbour), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, "
        "count(*) AS classes FROM (SELECT c, 2.0 * sum(CASE WHEN label = c AND prediction = c THEN 1 ELSE 0 END) / "
        "(sum(CASE WHEN label = c THEN 1 ELSE 0 END) + sum(CASE WHEN prediction = c THEN 1 ELSE 0 END)) AS f1 FROM neighbour, "
        "(SELECT label AS c FROM neighbour UNION SELECT prediction FROM neighbour) GROUP BY c)",
        "neighbour",
    ),
)
def _(spark, d):
    rows = t.vectors(spark, d)
    near = search.cosine_topk(rows, rows, 1)
    asked = rows.select(F.col("id").alias("qid"), "label")
    found = rows.select(F.col("id").alias("docid"), F.col("label").alias("prediction"))
    return _rounded(evaluation.classification_report(near.join(asked, "qid").join(found, "docid")))


@query("m13_kmeans")
def _(spark, d):
    return evaluation.cluster(t.vectors(spark, d)).select("id", F.col("label").cast("long").alias("label"), F.col("cluster").cast("long").alias("cluster"))


part(
    "label_cost",
    "SELECT sum(list_sum(list_transform(list_zip(e, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS cost FROM vec JOIN "
    "(SELECT label, list(v ORDER BY i) AS m FROM (SELECT label, i, avg(e[i]) AS v FROM vec, generate_series(1, 64) g(i) "
    "WHERE label IS NOT NULL GROUP BY label, i) GROUP BY label) USING (label)",
    "vec",
)


@query(
    "m13_minibatch_kmeans",
    using(
        "SELECT (SELECT count(DISTINCT label) FROM vec) AS clusters, (SELECT count(*) FROM vec WHERE label IS NOT NULL) AS rows, "
        "round(cost, 6) AS label_cost, TRUE AS no_dearer FROM label_cost",
        "vec",
        "label_cost",
    ),
)
def _(spark, d):
    """Clusters by mini-batches, and whether they cost no more than the means of the labels."""
    rows = t.vectors(spark, d).where("label is not null")
    clusters = rows.agg(F.count_distinct("label")).first()[0]
    found = evaluation.assigned(rows, evaluation.minibatch_centers(rows, clusters, batch_rows=512))
    means = evaluation.pool_vectors(rows.select(F.col("label").alias("id"), F.lit(0).alias("pos"), F.col("embedding").alias("vec")))
    apart = F.zip_with("embedding", "mean", lambda x, m: (x.cast("double") - m) * (x.cast("double") - m))
    both = found.join(means.select(F.col("id").alias("label"), F.col("embedding").alias("mean")), "label")
    told = both.agg(
        F.countDistinct("cluster").alias("clusters"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("cost").alias("cost"),
        F.sum(F.aggregate(apart, F.lit(0.0), lambda a, x: a + x)).alias("label_cost"),
    )
    return told.select("clusters", "rows", F.round("label_cost", 6).alias("label_cost"), (F.col("cost") <= F.col("label_cost")).alias("no_dearer"))


part(
    "grouped",
    "SELECT CASE WHEN e[2] >= 0 THEN 'up' ELSE 'down' END AS s, label AS c, CAST(floor((e[1] + 1) * 12) AS INT) AS k FROM vec",
    "vec",
)
part("cell", "SELECT s, c, k, CAST(count(*) AS DOUBLE) AS n FROM grouped GROUP BY s, c, k", "grouped")
part(
    "entropies",
    "SELECT s, (SELECT -sum(p * ln(p)) FROM (SELECT sum(n) / sum(sum(n)) OVER () AS p FROM cell y WHERE y.s = x.s GROUP BY c)) AS hc, "
    "(SELECT -sum(p * ln(p)) FROM (SELECT sum(n) / sum(sum(n)) OVER () AS p FROM cell y WHERE y.s = x.s GROUP BY k)) AS hk, "
    "(SELECT -sum(p * ln(p)) FROM (SELECT n / sum(n) OVER () AS p FROM cell y WHERE y.s = x.s)) AS hck FROM (SELECT DISTINCT s FROM cell) x",
    "cell",
)
_V = "2 * (1 - (hck - hk) / hc) * (1 - (hck - hc) / hk) / ((1 - (hck - hk) / hc) + (1 - (hck - hc) / hk))"


def _clusters(spark, d):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return t.vectors(spark, d).select(
        F.when(at(1) >= 0, F.lit("up")).otherwise(F.lit("down")).alias("cluster_set"), "label", F.floor((at(0) + 1) * 12).cast("int").alias("cluster")
    )


@query(
    "m14_v_measure",
    using(
        f"SELECT s AS cluster_set, round(1 - (hck - hk) / hc, 6) AS homogeneity, round(1 - (hck - hc) / hk, 6) AS completeness, round({_V}, 6) AS v_measure FROM entropies",
        "entropies",
    ),
)
def _(spark, d):
    return _rounded(evaluation.v_measures(_clusters(spark, d)))


@query(
    "m14_v_measure_summary",
    using(f"SELECT round(avg({_V}), 6) AS v_mean, round(stddev_pop({_V}), 6) AS v_std, count(*) AS sets FROM entropies", "entropies"),
)
def _(spark, d):
    return _rounded(evaluation.v_measure_summary(evaluation.v_measures(_clusters(spark, d))))


WORDS_SQL = (
    "(SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS idx FROM "
    f"(SELECT doc_id, {t.sql_words('text')} AS w FROM documents))"
)


def _words(spark, d):
    return t.documents(spark, d).select("doc_id", tx.word_tokens(F.col("text")).alias("w"))


@query(
    "m15_shifted_accuracy",
    "SELECT round(avg(CASE WHEN p = l THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS places FROM (SELECT length(tok) AS p, "
    f"lead(CASE WHEN length(tok) <= 2 THEN -100 ELSE length(tok) END) OVER (PARTITION BY doc_id ORDER BY idx) AS l FROM {WORDS_SQL}) WHERE l <> -100",
)
def _(spark, d):
    rows = _words(spark, d).select(
        F.transform("w", lambda x: F.length(x)).alias("predictions"),
        F.transform("w", lambda x: F.when(F.length(x) <= 2, F.lit(-100)).otherwise(F.length(x))).alias("labels"),
    )
    return _rounded(evaluation.shifted_accuracy(rows))


CAPITAL = r"^\p{Lu}"


@query(
    "m16_tag_precision",
    "SELECT round(avg(CASE WHEN p = l THEN 1.0 ELSE 0.0 END), 6) AS precision, count(*) AS places FROM (SELECT CASE WHEN length(tok) >= 6 THEN 1 ELSE 0 END AS p, "
    f"CASE WHEN length(tok) <= 2 THEN -100 WHEN regexp_matches(tok, '{CAPITAL}') THEN 1 ELSE 0 END AS l FROM {WORDS_SQL}) WHERE l <> -100",
)
def _(spark, d):
    label = lambda x: F.when(F.length(x) <= 2, F.lit(-100)).when(x.rlike(CAPITAL), F.lit(1)).otherwise(F.lit(0))
    rows = _words(spark, d).select(
        F.transform("w", lambda x: F.when(F.length(x) >= 6, F.lit(1)).otherwise(F.lit(0))).alias("predictions"),
        F.transform("w", label).alias("labels"),
    )
    return _rounded(evaluation.tag_precision(rows))


# Stand-in tags: long words are entities, capitals are another kind; the prediction draws the line elsewhere.
def _kinds(long: int):
    return lambda x: F.when(x.rlike(CAPITAL), F.lit("NAME")).when(F.length(x) >= long, F.lit("LONG"))


def _bio(words: str, long: int):
    return tx.let(F.transform(words, _kinds(long)), _tags)


def _tags(kinds):
    lead = lambda k, i: F.when((i > 0) & k.eqNullSafe(F.get(kinds, i - 1)), F.lit("I-")).otherwise(F.lit("B-"))
    return F.transform(kinds, lambda k, i: F.when(k.isNull(), F.lit("O")).otherwise(F.concat(lead(k, i), k)))


def _sql_spans(name: str, long: int) -> str:
    kind = f"CASE WHEN regexp_matches(tok, '{CAPITAL}') THEN 'NAME' WHEN length(tok) >= {long} THEN 'LONG' END"
    return (
        f"{name}_k AS (SELECT doc_id, idx, {kind} AS kind FROM words), "
        f"{name}_f AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY idx) THEN 0 ELSE 1 END AS fresh FROM {name}_k), "
        f"{name}_t AS (SELECT *, CASE WHEN kind IS NULL THEN 'O' WHEN fresh = 1 OR idx = 1 THEN 'B-' || kind ELSE 'I-' || kind END AS tag, "
        f"sum(fresh) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM {name}_f), "
        f"{name} AS (SELECT doc_id, kind, min(idx) AS a, max(idx) AS b FROM {name}_t WHERE kind IS NOT NULL GROUP BY doc_id, kind, island)"
    )


@query(
    "m17_entity_report",
    f"WITH words AS (SELECT * FROM {WORDS_SQL}), {_sql_spans('gold', 9)}, {_sql_spans('pred', 8)}, "
    "c AS (SELECT (SELECT count(*) FROM gold JOIN pred USING (doc_id, kind, a, b)) AS hit, (SELECT count(*) FROM gold) AS g, (SELECT count(*) FROM pred) AS p) "
    "SELECT round(hit / p, 6) AS precision, round(hit / g, 6) AS recall, round(2.0 * hit / (p + g), 6) AS f1, "
    "round((SELECT avg(CASE WHEN x.tag = y.tag THEN 1.0 ELSE 0.0 END) FROM gold_t x JOIN pred_t y USING (doc_id, idx)), 6) AS accuracy, g AS entities FROM c",
)
def _(spark, d):
    rows = _words(spark, d).select(_bio("w", 8).alias("predicted"), _bio("w", 9).alias("actual"))
    return _rounded(evaluation.entity_report(rows))


part("flat_vec", "SELECT id, pos, i, e[i] AS v FROM token_vec, generate_series(1, 64) g(i)", "token_vec")


@query(
    "m18_vector_pooling",
    using(
        "SELECT id, how, round(sqrt(sum(v * v)), 6) AS length, round(max(v) FILTER (i = 1), 6) AS first FROM ("
        "SELECT id, 'mean' AS how, i, avg(v) AS v FROM flat_vec GROUP BY id, i UNION ALL "
        "SELECT id, 'weighted_mean', i, sum(v * (pos + 1)) / sum(pos + 1) FROM flat_vec GROUP BY id, i UNION ALL "
        "SELECT id, 'last', i, arg_max(v, pos) FROM flat_vec GROUP BY id, i UNION ALL "
        "SELECT id, 'bos', i, arg_min(v, pos) FROM flat_vec GROUP BY id, i) GROUP BY id, how",
        "flat_vec",
    ),
)
def _(spark, d):
    rows = t.token_vectors(spark, d)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    out = None
    for how in ("mean", "weighted_mean", "last", "bos"):
        pooled = evaluation.pool_vectors(rows, how).select("id", F.lit(how).alias("how"), F.col("embedding").cast("array<double>").alias("embedding"))
        one = pooled.select("id", "how", F.sqrt(square).alias("length"), F.get("embedding", F.lit(0)).alias("first"))
        out = one if out is None else out.unionByName(one)
    return _rounded(out)


@query(
    "m20_size_report",
    using(
        "SELECT count(*) AS rows, round(avg(t), 6) AS terms_per_row, CAST(max(t) AS BIGINT) AS max_terms, round(avg(t * 4 + b), 6) AS bytes_per_row, "
        "CAST(sum(t * 4 + b) AS BIGINT) AS total_bytes FROM (SELECT id, count(*) AS t, sum(strlen(term)) AS b FROM doc_post GROUP BY id)",
        "doc_post",
    ),
)
def _(spark, d):
    return _rounded(evaluation.size_report(t.doc_postings(spark, d)))


_AT = lambda what, p: f"min({what}) FILTER ({what}_at >= {p})"


@query(
    "m20_size_quantiles",
    using(
        f"SELECT count(*) AS rows, {', '.join(f'CAST({_AT(w, p)} AS BIGINT) AS {w}_p{round(100 * p)}' for w in ('terms', 'bytes') for p in (0.5, 0.9, 0.99))}, "
        f"CAST(ceil(CAST(sum(bytes) AS DOUBLE) / count(*) * 1000000) AS BIGINT) AS projected_bytes, CAST({_AT('bytes', 0.99)} * 1000000 AS BIGINT) AS projected_high_bytes "
        "FROM (SELECT *, cume_dist() OVER (ORDER BY terms) AS terms_at, cume_dist() OVER (ORDER BY bytes) AS bytes_at FROM "
        "(SELECT id, count(*) AS terms, count(*) * 4 + sum(strlen(term)) AS bytes FROM doc_post GROUP BY id))",
        "doc_post",
    ),
)
def _(spark, d):
    """Sketches per language, merged; and the memory of a million documents of this kind."""
    langs = t.documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), "lang")
    sketches = evaluation.size_sketches(t.doc_postings(spark, d).join(langs, "id"), ["lang"])
    return evaluation.size_quantiles(evaluation.merged_sizes(sketches), 1_000_000)
