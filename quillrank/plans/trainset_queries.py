"""Training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import trainset
from quillrank.plans import tables as t
from quillrank.plans.registry import part, query, using

SPLIT = "CASE WHEN turn <= 1 THEN 'wikipedia' WHEN turn <= 3 THEN 'quora' ELSE 'squad' END"
TASK = "CASE WHEN turn <= 1 THEN 'allnli' WHEN turn <= 3 THEN 'fever' ELSE 'quora_duplicates' END"


@query(
    "n9_pair_rows",
    using(
        "SELECT split, query_id, 'query: ' || query AS query, query_id || '_pos' AS docid, "
        "CASE WHEN split = 'quora' THEN 'query: ' ELSE 'passage: ' END || positive AS text FROM (SELECT *, split || '_' || "
        "CAST(row_number() OVER (PARTITION BY split ORDER BY conv_id, turn) - 1 AS VARCHAR) AS query_id FROM "
        f"(SELECT *, {SPLIT} AS split FROM turns))",
        "turns",
    ),
)
def _(spark, d):
    pairs = t.turns(spark, d).withColumn("split", F.expr(SPLIT)).withColumnRenamed("positive", "document")
    rows = trainset.pair_rows(pairs, ["conv_id", "turn"])
    passage = F.get("positive_passages", F.lit(0))
    return rows.select("split", "query_id", "query", passage["docid"].alias("docid"), passage["text"].alias("text"))


part(
    "choices",
    "SELECT query_id, CAST(query_id AS BIGINT) AS item, list(docid ORDER BY side DESC, ord) AS ids FROM "
    "(SELECT qid, 1 AS side, docid, docid AS ord FROM positives UNION ALL SELECT qid, 0, docid, lpad(CAST(rank AS VARCHAR), 4, '0') FROM negatives) "
    "JOIN queries ON qid = query_id GROUP BY query_id",
    "positives",
    "negatives",
    "queries",
)


def _key(*parts: str) -> str:
    """The SQL of a seeded key."""
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 15) AS BIGINT)"


def _ordered(ids: str, seed: int, item: str) -> str:
    """The SQL of a list in seeded order."""
    keys = f"list_transform(range(0, len({ids})), lambda i: {{'k': {_key(f"'{seed}'", item, 'i')}, 'i': i}})"
    return f"list_transform(list_sort({keys}), lambda s: {ids}[s.i + 1])"


def _replaced(ids: str, seed: int, item: str, epoch: int, m: int) -> str:
    """The SQL of a draw with replacement from a list that is shorter than m."""
    return f"list_transform(range(1, {m + 1}), lambda i: {ids}[1 + {_key(f"'{seed}'", item, f"'{epoch}'", 'i')} % len({ids})])"


def _choices(spark, d):
    """Documents of each judged row, positives first."""
    rows = trainset.rows_for_epoch(t.judged(spark, d), 3).withColumn("ids", F.concat("positive_passages.docid", "negative_passages.docid"))
    return rows.select("query_id", F.col("query_id").cast("long").alias("item"), "ids").where(F.size("ids") > 0)


@query(
    "n10_positive_for_epoch",
    using("SELECT query_id, ids[1] AS first, ids[1 + (item + 42 + 3) % len(ids)] AS chosen FROM choices", "choices"),
)
def _(spark, d):
    choose = lambda shuffle: trainset.positive_for_epoch(F.col("ids"), F.col("item"), 42, 3, shuffle)
    return _choices(spark, d).select("query_id", choose(False).alias("first"), choose(True).alias("chosen"))


@query(
    "n11_negatives_for_epoch",
    using(
        "SELECT query_id, array_to_string(CASE WHEN len(ids) < 4 THEN few ELSE ids[1:4] END, ',') AS first, array_to_string("
        "CASE WHEN len(ids) < 4 THEN few ELSE list_concat(ids, ids)[1 + (3 * 4) % len(ids) : (3 * 4) % len(ids) + 4] END, ',') AS turned "
        f"FROM (SELECT *, {_replaced('ids', 42, 'item', 3, 4)} AS few FROM choices)",
        "choices",
    ),
)
def _(spark, d):
    choose = lambda **o: F.array_join(trainset.negatives_for_epoch(F.col("ids"), F.col("item"), 5, 42, 3, **o), ",")
    return _choices(spark, d).select(
        "query_id", choose(shuffle=False).alias("first"), choose(order_shuffle=False).alias("turned")
    )


@query(
    "n11_seeded_negatives",
    using(
        f"SELECT query_id, array_to_string(CASE WHEN len(ids) < 15 THEN {_replaced('ids', 42, 'item', 3, 15)} "
        "ELSE list_concat(o, o)[1 + 45 % len(ids) : 45 % len(ids) + 15] END, ',') AS negatives "
        f"FROM (SELECT *, {_ordered('ids', 42, 'item')} AS o FROM choices)",
        "choices",
    ),
)
def _(spark, d):
    drawn = trainset.negatives_for_epoch(F.col("ids"), F.col("item"), 16, 42, 3)
    return _choices(spark, d).select("query_id", F.array_join(drawn, ",").alias("negatives"))


@query(
    "n12_scored_negatives",
    using(
        "SELECT query_id, array_to_string(list_transform(CASE WHEN len(ids) < 4 THEN few "
        "ELSE list_concat(ids, ids)[1 + (3 * 4) % len(ids) : (3 * 4) % len(ids) + 4] END, "
        "lambda x: x || ':' || CAST(length(x) AS VARCHAR)), ',') AS turned "
        f"FROM (SELECT *, {_replaced('ids', 42, 'item', 3, 4)} AS few FROM choices)",
        "choices",
    ),
)
def _(spark, d):
    pairs = F.transform("ids", lambda x: F.struct(x.alias("docid"), F.length(x).alias("score")))
    drawn = trainset.negatives_for_epoch(F.col("pairs"), F.col("item"), 5, 42, 3, order_shuffle=False)
    shown = F.array_join(F.transform(drawn, lambda p: F.concat_ws(":", p["docid"], p["score"].cast("string"))), ",")
    return _choices(spark, d).withColumn("pairs", pairs).select("query_id", shown.alias("turned"))


@query(
    "n13_group_sample",
    using(
        f"SELECT query_id, ({_ordered('p', 9, 'query_id')})[1] AS positive, array_to_string(CASE WHEN len(n) = 0 THEN n "
        f"WHEN len(n) < 4 THEN {_replaced('n', 10, 'query_id', 0, 4)} ELSE ({_ordered('n', 10, 'query_id')})[1:4] END, ',') AS negatives "
        "FROM (SELECT query_id, coalesce(p, []) AS p, coalesce(n, []) AS n FROM queries "
        "LEFT JOIN (SELECT qid AS query_id, list(docid ORDER BY docid) AS p FROM positives GROUP BY qid) USING (query_id) "
        "LEFT JOIN (SELECT qid AS query_id, list(docid ORDER BY rank) AS n FROM negatives GROUP BY qid) USING (query_id))",
        "queries",
        "positives",
        "negatives",
    ),
)
def _(spark, d):
    rows = t.judged(spark, d).select("query_id", F.col("positive_passages.docid").alias("positives"), F.col("negative_passages.docid").alias("negatives"))
    drawn = trainset.sample_group(rows, "query_id", 5, seed=9)
    return drawn.select("query_id", "positive", F.array_join("negatives", ",").alias("negatives"))


@query(
    "n14_soft_targets",
    using(
        "SELECT qid, docid, round(exp(score / 5000.0 - m) / sum(exp(score / 5000.0 - m)) OVER (PARTITION BY qid), 6) AS target FROM "
        "(SELECT *, max(score / 5000.0) OVER (PARTITION BY qid) AS m FROM run)",
        "run",
    ),
)
def _(spark, d):
    out = trainset.soft_targets(t.run(spark, d), 5000.0)
    return out.select("qid", "docid", F.round("target", 6).alias("target"))


PROMPTS = ", ".join(
    f"('{task}', {i}, {len(prompts)}, '{prompt}')"
    for task, prompts in trainset.TASK_PROMPTS.items()
    for i, prompt in enumerate(prompts)
)
MARK = tx.INSTRUCTION_SEPARATOR


@query(
    "n15_task_triplets",
    using(
        f"SELECT task_name, place, prompt || '; {MARK}' || query AS query, '{MARK}' || positive AS positive, '{MARK}' || negative AS negative FROM "
        "(SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY conv_id, turn) - 1 AS place FROM "
        f"(SELECT *, {TASK} AS task_name FROM turns)) JOIN (VALUES {PROMPTS}) v(task, i, n, prompt) ON task = task_name AND i = place % n",
        "turns",
    ),
)
def _(spark, d):
    rows = t.turns(spark, d).withColumn("task_name", F.expr(TASK))
    out = trainset.task_triplets(rows, trainset.prompt_table(spark), ["conv_id", "turn"])
    return out.select("task_name", "place", "query", "positive", "negative")


def _samples(spark, d):
    return t.turns(spark, d).select(F.expr(TASK).alias("task_name"), (F.col("conv_id") * 1000 + F.col("turn")).alias("sample"))


@query(
    "n16_task_batches",
    using(
        "SELECT task_name, sample, i // 8 AS batch, i % 8 AS place FROM (SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY sample) - 1 AS i, "
        f"count(*) OVER (PARTITION BY task_name) AS n FROM (SELECT conv_id * 1000 + turn AS sample, {TASK} AS task_name FROM turns)) WHERE (i // 8 + 1) * 8 <= n",
        "turns",
    ),
)
def _(spark, d):
    out = trainset.task_batches(_samples(spark, d), "sample", 8, shuffle=False)
    return out.select("task_name", "sample", "batch", "place")


@query(
    "n16_seeded_batches",
    using(
        "SELECT task_name, sample, i // 8 AS batch, i % 8 AS place FROM (SELECT *, row_number() OVER (PARTITION BY task_name "
        f"ORDER BY {_key("'3'", 'task_name', 'sample')}, sample) - 1 AS i, count(*) OVER (PARTITION BY task_name) AS n "
        f"FROM (SELECT conv_id * 1000 + turn AS sample, {TASK} AS task_name FROM turns)) WHERE (i // 8 + 1) * 8 <= n",
        "turns",
    ),
)
def _(spark, d):
    out = trainset.task_batches(_samples(spark, d), "sample", 8, seed=3)
    return out.orderBy("turn", "place").select("task_name", "sample", "batch", "place")


@query(
    "n18_token_packing",
    "WITH g AS (SELECT doc_id, w, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS batch FROM "
    f"(SELECT doc_id, {t.sql_words('text')} AS w FROM documents)), "
    "x AS (SELECT batch, doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS idx FROM g), "
    "y AS (SELECT batch, tok, row_number() OVER (PARTITION BY batch ORDER BY doc_id, idx) - 1 AS i FROM x) "
    "SELECT batch, i // 128 AS chunk, string_agg(tok, ' ' ORDER BY i) AS tokens FROM y GROUP BY batch, i // 128 HAVING count(*) = 128",
)
def _(spark, d):
    rows = t.documents(spark, d).select("doc_id", tx.word_tokens(F.col("text")).alias("tokens"))
    packed = trainset.pack_tokens(rows, ["doc_id"], 128, group_rows=300)
    return packed.withColumn("tokens", F.array_join("tokens", " "))


@query(
    "n19_line_by_line",
    f"SELECT doc_id, line, array_to_string(({t.sql_words('text')})[1:64], ' ') AS tokens FROM (SELECT doc_id, unnest(l) AS text, "
    "generate_subscripts(l, 1) - 1 AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) "
    r"WHERE NOT regexp_matches(text, '^\s*$')",
)
def _(spark, d):
    lines = t.documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    out = trainset.line_by_line(lines, 64)
    return out.select("doc_id", F.col("line").cast("long").alias("line"), F.array_join("tokens", " ").alias("tokens"))


@query(
    "n20_full_masking",
    f"SELECT doc_id, len(w) AS tokens, len(list_filter(range(0, len(w)), lambda i: ({_key("'4'", 'doc_id', 'i')} % 1099511627776) "
    "/ 1099511627776.0 < 0.3 AND length(w[i + 1]) NOT IN (1, 2))) AS masked "
    f"FROM (SELECT doc_id, {t.sql_words('text')} AS w FROM documents)",
)
def _(spark, d):
    ids = F.transform(tx.word_tokens(F.col("text")), lambda w: F.length(w))
    rows = t.documents(spark, d).select("doc_id", ids.alias("tokens"))
    out = trainset.mask_tokens(rows, "doc_id", 0.3, mask_id=0, special_ids=(1, 2), seed=4)
    kept = F.size(F.filter("labels", lambda x: x == -100))
    return out.select("doc_id", F.size("tokens").cast("long").alias("tokens"), (F.size("labels") - kept).cast("long").alias("masked"))
