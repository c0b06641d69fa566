"""Negative mining and judged rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.operators import mining, rerank
from quillrank.plans import tables as t
from quillrank.plans.registry import part, query, using

IDS = lambda c: F.array_join(F.transform(c, lambda p: p["docid"]), ",")


def _lists(rows):
    return rows.select("query_id", IDS("positive_passages").alias("positives"), IDS("negative_passages").alias("negatives"))


part("positive_ids", "SELECT qid, string_agg(docid, ',' ORDER BY docid) AS positives FROM qrels GROUP BY qid", "qrels")
for depth in (10, 30):
    part(
        f"negative_ids_{depth}",
        f"SELECT qid, string_agg(docid, ',' ORDER BY rank) AS negatives FROM (SELECT * FROM run WHERE rank <= {depth}) ANTI JOIN qrels USING (qid, docid) GROUP BY qid",
        "run",
        "qrels",
    )


@query(
    "n1_basic_negatives",
    using(
        "SELECT query_id, coalesce(positives, '') AS positives, coalesce(negatives, '') AS negatives FROM queries "
        "LEFT JOIN positive_ids p ON p.qid = query_id LEFT JOIN negative_ids_30 n ON n.qid = query_id",
        "queries",
        "positive_ids",
        "negative_ids_30",
    ),
)
def _(spark, d):
    return _lists(mining.basic_negatives(t.judged(spark, d), t.run(spark, d), t.corpus(spark, d), 30))


@query(
    "n2_answer_negatives",
    using(
        "SELECT qid AS query_id, coalesce(string_agg(docid, ',' ORDER BY rank) FILTER (hit), '') AS positives, "
        "coalesce(string_agg(docid, ',' ORDER BY rank) FILTER (NOT hit), '') AS negatives FROM "
        f"(SELECT qid, docid, rank, contains({t.sql_form('text')}, {t.sql_form('query')}) AS hit FROM run JOIN queries ON qid = query_id "
        "JOIN corpus USING (docid) WHERE rank <= 50) GROUP BY qid",
        "run",
        "queries",
        "corpus",
    ),
)
def _(spark, d):
    return _lists(mining.answer_negatives(t.judged(spark, d), t.run(spark, d), t.corpus(spark, d), 50))


@query("n3_answer_containment", using("SELECT qid, docid FROM qrels", "qrels"))
def _(spark, d):
    return mining.answer_pairs(t.corpus(spark, d), t.answers(spark, d))


@query(
    "n4_original_and_mined",
    using(
        "SELECT query_id, positives, negatives FROM (SELECT qid AS query_id, negatives FROM negative_ids_10 UNION ALL "
        "SELECT qid, negatives FROM negative_ids_30) JOIN positive_ids ON qid = query_id "
        "WHERE len(string_split(negatives, ',')) >= 5",
        "positive_ids",
        "negative_ids_10",
        "negative_ids_30",
    ),
)
def _(spark, d):
    original = t.judged(spark, d)
    mined = mining.basic_negatives(original, t.run(spark, d), t.corpus(spark, d), 30)
    return _lists(mining.with_mined(original, mined, 5))


part(
    "ranked_negatives",
    "SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM run ANTI JOIN qrels USING (qid, docid) QUALIFY place <= 8",
    "run",
    "qrels",
)


def _ranked(spark, d):
    return mining.ranked_negatives(t.run(spark, d), t.qrels(spark, d), 50, 8, shuffle=False)


@query("n5_ranked_negatives", using("SELECT qid, place, docid FROM ranked_negatives", "ranked_negatives"))
def _(spark, d):
    return _ranked(spark, d).withColumn("place", F.col("place").cast("long"))


SEEDED = "CAST('0x' || substr(md5('5:' || qid || ':' || i), 1, 15) AS BIGINT)"


@query(
    "n6_sampled_negatives",
    using(
        "SELECT qid, CAST(0 AS BIGINT) AS part, array_to_string(list_transform(list_sort(list_transform(range(0, len(ids)), "
        f"lambda i: {{'k': {SEEDED}, 'i': i}})), lambda s: ids[s.i + 1])[1:30], ',') AS negatives FROM "
        "(SELECT qid, list(docid ORDER BY docid) AS ids FROM run ANTI JOIN qrels USING (qid, docid) GROUP BY qid)",
        "run",
        "qrels",
    ),
)
def _(spark, d):
    other = t.run(spark, d).join(t.qrels(spark, d), ["qid", "docid"], "left_anti")
    triples = other.select("qid", F.col("docid").alias("negative"))
    drawn = mining.sampled_negatives(rerank.group_negatives(triples), 30, seed=5)
    return drawn.select("qid", "part", F.array_join("negatives", ",").alias("negatives"))


def _sql_body(max_len: int) -> str:
    words = t.sql_words("(coalesce(title, '') || '[SEP]' || text)")
    return f"array_to_string(({words})[1:{max_len}], ' ')"


SHOW = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(x, " ")), " | ")


@query(
    "n7_train_examples",
    using(
        f"SELECT p.qid, array_to_string(({t.sql_words('query')})[1:128], ' ') AS query, positives, negatives FROM "
        f"(SELECT qid, string_agg({_sql_body(128)}, ' | ' ORDER BY docid) AS positives FROM positives GROUP BY qid) p JOIN "
        f"(SELECT qid, string_agg({_sql_body(128)}, ' | ' ORDER BY place) AS negatives FROM ranked_negatives JOIN corpus USING (docid) GROUP BY qid) n "
        "USING (qid) JOIN queries ON query_id = p.qid",
        "positives",
        "ranked_negatives",
        "queries",
    ),
)
def _(spark, d):
    rows = mining.assemble_examples(_ranked(spark, d), t.qrels(spark, d), t.queries(spark, d), t.corpus(spark, d))
    return rows.select("qid", F.array_join("query", " ").alias("query"), SHOW("positives").alias("positives"), SHOW("negatives").alias("negatives"))


@query(
    "n8_context_examples",
    using(
        f"SELECT query_id, array_to_string(({t.sql_words('query')})[1:256], ' ') AS query, p AS positives, n AS negatives FROM queries "
        f"JOIN (SELECT qid, string_agg({_sql_body(256)}, ' | ' ORDER BY docid) AS p FROM positives GROUP BY qid) a ON a.qid = query_id "
        f"JOIN (SELECT qid, string_agg({_sql_body(256)}, ' | ' ORDER BY rank) AS n, count(*) AS c FROM negatives GROUP BY qid) b ON b.qid = query_id WHERE c >= 2",
        "queries",
        "positives",
        "negatives",
    ),
)
def _(spark, d):
    rows = t.judged(spark, d).select(
        "query_id",
        F.col("query").alias("question"),
        F.col("positive_passages").alias("positive_ctxs"),
        F.col("negative_passages").alias("hard_negative_ctxs"),
    )
    out = mining.context_examples(rows, 2)
    return out.select("query_id", F.array_join("query", " ").alias("query"), SHOW("positives").alias("positives"), SHOW("negatives").alias("negatives"))
