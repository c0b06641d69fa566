"""Projections, filters and token-array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import text_rows
from quillrank.plans import tables as t
from quillrank.plans.registry import part, query, using

SEP = tx.INSTRUCTION_SEPARATOR


def _joined(tokens: str) -> F.Column:
    return F.array_join(tokens, " ")


def _lists(lists: str, tokens=lambda x: x) -> F.Column:
    return F.array_join(F.transform(lists, lambda x: F.array_join(tokens(x), " ")), " | ")


def _sql_tokens(text: str, max_len: int | None = None, eos: str | None = None) -> str:
    words = t.sql_words(text)
    if eos is not None:
        return f"array_to_string(list_append(({words})[1:{max_len - 1}], '{eos}'), ' ')"
    cut = "" if max_len is None else f"[1:{max_len}]"
    return f"array_to_string(({words}){cut}, ' ')"


@query(
    "p1_passage_composition",
    using(
        f"SELECT docid, 'passage: ' || lower({t.sql_passage()}) AS lowered, {t.sql_passage(sep=' / ')} AS plain FROM corpus",
        "corpus",
    ),
)
def _(spark, d):
    title, text = F.col("title"), F.col("text")
    return t.corpus(spark, d).select(
        "docid",
        tx.passage_text(title, text, prefix=tx.PASSAGE_PREFIX, lowercase=True).alias("lowered"),
        tx.passage_text(title, text, sep=" / ").alias("plain"),
    )


NAMED = "CASE lang WHEN 'en' THEN 'quora' WHEN 'fr' THEN 'cqadupstack-english' ELSE 'nq' END"


@query(
    "p2_prefix_by_corpus",
    f"SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'query: ' ELSE 'passage: ' END || text AS text FROM documents",
)
def _(spark, d):
    rows = t.documents(spark, d).withColumn("name", F.expr(NAMED))
    return rows.select("doc_id", F.concat(tx.corpus_prefix(F.col("name")), "text").alias("text"))


@query(
    "p3_tokenise_truncate",
    f"SELECT doc_id, {_sql_tokens('text', 256)} AS cut, {_sql_tokens('text', 32, '</s>')} AS ended, {_sql_tokens('text')} AS whole FROM documents",
)
def _(spark, d):
    tokens = tx.word_tokens(F.col("text"))
    return t.documents(spark, d).select(
        "doc_id",
        F.array_join(tx.truncate(tokens, 256), " ").alias("cut"),
        F.array_join(tx.truncate(tokens, 32, "</s>"), " ").alias("ended"),
        F.array_join(tokens, " ").alias("whole"),
    )


def _train_sql(q: str, p: str, n: str) -> str:
    """Token texts of query, positives by docid and negatives by rank."""
    return (
        f"SELECT query_id, {q} AS query, coalesce(p, '') AS positives, coalesce(n, '') AS negatives FROM queries "
        f"LEFT JOIN (SELECT qid, string_agg({p}, ' | ' ORDER BY docid) AS p FROM positives GROUP BY qid) a ON a.qid = query_id "
        f"LEFT JOIN (SELECT qid, string_agg({n}, ' | ' ORDER BY rank) AS n FROM negatives GROUP BY qid) b ON b.qid = query_id"
    )


TRAIN_PARTS = ("queries", "positives", "negatives")


def _train_out(rows):
    return rows.select("query_id", _joined("query").alias("query"), _lists("positives").alias("positives"), _lists("negatives").alias("negatives"))


def _passage_sql(prefix: str, max_len: int, lower: bool = False, eos: str | None = None) -> str:
    body = t.sql_passage()
    body = f"lower({body})" if lower else body
    return _sql_tokens(f"'{prefix}' || {body if lower else '(' + body + ')'}", max_len, eos)


@query(
    "p4_train_rows",
    using(
        _train_sql(_sql_tokens("'query: ' || lower(query)", 32, "</s>"), _passage_sql("passage: ", 256, True, "</s>"), _passage_sql("passage: ", 256, True, "</s>")),
        *TRAIN_PARTS,
    ),
)
def _(spark, d):
    return _train_out(text_rows.train_rows(t.judged(spark, d), lowercase=True, eos="</s>"))


part(
    "scored_lists",
    "SELECT qid, 1 AS side, docid, docid AS ord, title, text, CAST(length(text) AS DOUBLE) AS score FROM positives UNION ALL "
    "SELECT qid, 0, docid, lpad(CAST(rank AS VARCHAR), 4, '0'), title, text, CAST(length(text) AS DOUBLE) FROM negatives",
    "positives",
    "negatives",
)


@query(
    "p5_distillation_rows",
    using(
        f"SELECT query_id, {_sql_tokens(chr(39) + 'query: ' + chr(39) + ' || query', 32)} AS query, coalesce(p, '') AS positives, "
        "coalesce(n, '') AS negatives FROM queries LEFT JOIN (SELECT qid, "
        f"string_agg({_passage_sql('passage: ', 64)} || ' = ' || CAST(CAST(score AS BIGINT) AS VARCHAR), ' | ' ORDER BY ord) FILTER (side = 1) AS p, "
        f"string_agg({_passage_sql('passage: ', 64)} || ' = ' || CAST(CAST(score AS BIGINT) AS VARCHAR), ' | ' ORDER BY ord) FILTER (side = 0) AS n "
        "FROM scored_lists GROUP BY qid) ON qid = query_id",
        "queries",
        "scored_lists",
    ),
)
def _(spark, d):
    scored = lambda c: F.transform(c, lambda p: F.struct(p["docid"].alias("docid"), p["title"].alias("title"), p["text"].alias("text"), F.length(p["text"]).cast("double").alias("score")))
    rows = t.judged(spark, d)
    for c in ("positive_passages", "negative_passages"):
        rows = rows.withColumn(c, scored(c))
    out = text_rows.scored_train_rows(rows, p_max=64)
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.array_join(x["tokens"], " "), F.lit(" = "), x["score"].cast("long").cast("string"))), " | ")
    return out.select("query_id", _joined("query").alias("query"), shown("positives").alias("positives"), shown("negatives").alias("negatives"))


@query("p6_query_rows", using(f"SELECT query_id AS text_id, {_sql_tokens(chr(39) + 'query: ' + chr(39) + ' || query', 32)} AS text FROM queries", "queries"))
def _(spark, d):
    return text_rows.query_rows(t.queries(spark, d)).select("text_id", _joined("text").alias("text"))


@query("p7_corpus_rows", using(f"SELECT docid AS text_id, {_passage_sql('passage: ', 256)} AS text FROM corpus", "corpus"))
def _(spark, d):
    return text_rows.corpus_rows(t.corpus(spark, d)).select("text_id", _joined("text").alias("text"))


@query(
    "p8_contrastive_rows",
    using(
        f"SELECT query_id, {_sql_tokens('query', 32)} AS query, coalesce(p, '') AS positives, '' AS negatives FROM queries "
        f"LEFT JOIN (SELECT qid, string_agg({_passage_sql('', 256)}, ' | ' ORDER BY docid) AS p FROM positives GROUP BY qid) ON qid = query_id",
        "queries",
        "positives",
    ),
)
def _(spark, d):
    return _train_out(text_rows.contrastive_rows(t.judged(spark, d).drop("negative_passages")))


@query(
    "p9_line_rows",
    using(
        "SELECT docid AS text_id, "
        + _sql_tokens("coalesce(title, '') || ' ' || trim(regexp_replace(text, '\\s+', ' ', 'g'))", 128)
        + " AS text FROM corpus",
        "corpus",
    ),
)
def _(spark, d):
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    lines = t.corpus(spark, d).select(F.concat_ws("\t", F.col("docid"), F.coalesce("title", F.lit("")), flat).alias("value"))
    return text_rows.line_rows(lines).select("text_id", _joined("text").alias("text"))


part("pairs", "SELECT qid AS query_id, docid, query, title, text FROM run JOIN queries ON qid = query_id JOIN corpus USING (docid)", "run", "queries", "corpus")


def _pairs(spark, d):
    from quillrank.operators.rerank import rerank_input

    return rerank_input(t.run(spark, d), t.queries(spark, d), t.corpus(spark, d), t.DEPTH)


@query(
    "p10_rerank_pairs",
    using(
        "SELECT query_id, docid, array_to_string(list_concat(q[1:greatest(0, 160 - len(p))], p), ' ') AS pair FROM ("
        f"SELECT query_id, docid, ({t.sql_words('query')})[1:32] AS q, ({t.sql_words('(' + t.sql_passage() + ')')})[1:150] AS p FROM pairs)",
        "pairs",
    ),
)
def _(spark, d):
    rows = text_rows.rerank_rows(_pairs(spark, d), q_max=32, p_max=150)
    return text_rows.pair_tokens(rows, 160).select("query_id", "docid", _joined("pair").alias("pair"))


@query(
    "p11_rerank_prompts",
    using(
        f"SELECT query_id, docid, {_sql_tokens(chr(39) + 'query: ' + chr(39) + ' || query', 32)} AS query, "
        + _sql_tokens("(CASE WHEN title IS NOT NULL THEN 'document: ' || title || ' ' || text ELSE text END)", 125)
        + " AS text FROM pairs",
        "pairs",
    ),
)
def _(spark, d):
    rows = text_rows.rerank_prompt_rows(_pairs(spark, d), p_max=128)
    return rows.select("query_id", "docid", _joined("query").alias("query"), _joined("text").alias("text"))


TASK_INSTRUCTIONS = [
    ("en", " Given a claim, find documents that refute the claim: "),
    ("fr", "Retrieve semantically similar text"),
    ("de", ""),
]
SQL_INSTRUCTIONS = ", ".join(f"('{a}', '{b}')" for a, b in TASK_INSTRUCTIONS)


@query(
    "p13_instruction",
    f"SELECT doc_id, CASE WHEN i IS NULL OR i = '' THEN '{SEP}' || text ELSE trim(i) || ' {SEP}' || text END AS instructed "
    f"FROM documents LEFT JOIN (VALUES {SQL_INSTRUCTIONS}) v(l, i) ON l = lang",
)
def _(spark, d):
    known = spark.createDataFrame(TASK_INSTRUCTIONS, "task string, instruction string")
    docs = t.documents(spark, d).withColumnRenamed("lang", "task")
    return text_rows.instruct(docs, known).select("doc_id", "instructed")


@query(
    "p14_instruction_form",
    "SELECT item_id, CASE WHEN text = '' OR text LIKE '%:' THEN text ELSE trim(text, '.') || ':' END AS instruction FROM benchmark",
)
def _(spark, d):
    return t.table(spark, d, "benchmark").select("item_id", tx.normalise_instruction(F.col("text")).alias("instruction"))


@query(
    "p15_length_cap",
    "SELECT doc_id, CASE WHEN len(w) > 100 THEN array_to_string(w[1:CAST(floor(len(w) * (100.0::DOUBLE / len(w))) AS INT)], ' ') ELSE text END AS text "
    "FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 0) AS w FROM documents)",
)
def _(spark, d):
    return text_rows.cap_words(t.documents(spark, d).select("doc_id", "text"), 100)


FAMILY = "CASE lang WHEN 'en' THEN 'llama3-instruct' WHEN 'fr' THEN 'mistral-instruct' WHEN 'de' THEN 'qwen2' ELSE 'gemma2-it' END"
TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(
    "p16_chat_template",
    "SELECT doc_id, CASE lang WHEN 'en' THEN '<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || x || '<|eot_id|>' "
    "WHEN 'fr' THEN '[INST] ' || x || ' [/INST]' WHEN 'de' THEN text ELSE '<bos><start_of_turn>user' || chr(10) || x || '<end_of_turn>' END AS plain, "
    "CASE lang WHEN 'en' THEN '<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || x || '<|eot_id|>' "
    "WHEN 'fr' THEN '[INST] ' || x || ' [/INST] </s>' WHEN 'de' THEN x || '<|endoftext|>' "
    f"ELSE '<bos><start_of_turn>user' || chr(10) || x || '<end_of_turn>' END AS ended FROM (SELECT *, {TRIMMED} AS x FROM documents)",
)
def _(spark, d):
    rows = t.documents(spark, d).withColumn("family", F.expr(FAMILY))
    return rows.select(
        "doc_id",
        tx.chat_text(F.col("family"), F.col("text")).alias("plain"),
        tx.chat_text(F.col("family"), F.col("text"), eos_pooling=True).alias("ended"),
    )


@query(
    "p18_min_rows",
    using(
        "SELECT query_id, p AS positives, n AS negatives FROM queries JOIN (SELECT qid, count(*) AS p FROM positives GROUP BY qid) a ON a.qid = query_id "
        "JOIN (SELECT qid, count(*) AS n FROM negatives GROUP BY qid) b ON b.qid = query_id WHERE n >= 9",
        *TRAIN_PARTS,
    ),
)
def _(spark, d):
    kept = text_rows.min_rows(t.judged(spark, d), 9)
    count = lambda c: F.size(c).cast("long")
    return kept.select("query_id", count("positive_passages").alias("positives"), count("negative_passages").alias("negatives"))


@query(
    "p19_split_by_percent",
    "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < (SELECT round_even(count(*) * 7 / 100.0, 0) FROM documents) "
    "THEN 'validation' ELSE 'train' END AS split FROM documents",
)
def _(spark, d):
    return text_rows.split_by_percent(t.documents(spark, d).select("doc_id"), ["doc_id"], 7)


@query("p20_take_first", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 25")
def _(spark, d):
    return text_rows.take_first(t.documents(spark, d).select("doc_id", "text"), ["doc_id"], 25)


@query(
    "p21_longest_first",
    using(
        "SELECT docid, length(coalesce(title, '') || text) AS length, row_number() OVER (ORDER BY length(coalesce(title, '') || text) DESC, docid) - 1 AS place FROM corpus",
        "corpus",
    ),
)
def _(spark, d):
    from quillrank.operators.placement import running_total

    rows = text_rows.longest_first(t.corpus(spark, d)).select("docid", "length", (-F.col("length")).alias("down"))
    return running_total(rows, ["down", "docid"], name="place").drop("down")


@query("p22_score_scale", "SELECT item_id, round((length(text) - 5.0) / (400.0 - 5.0), 6) AS score FROM benchmark")
def _(spark, d):
    score = text_rows.scale_score(F.length("text").cast("double"), 5.0, 400.0)
    return t.table(spark, d, "benchmark").select("item_id", F.round(score, 6).alias("score"))


@query(
    "p23_word_labels",
    "WITH w AS (SELECT doc_id, CAST(u - 1 AS INT) AS word, length(ws[u]) AS n FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS u FROM "
    f"(SELECT doc_id, {t.sql_words('text')} AS ws FROM documents))), "
    "s AS (SELECT doc_id, word, n, unnest(generate_series(1, CAST(ceil(n / 4.0) AS INT))) AS piece FROM w), "
    "l AS (SELECT doc_id, CASE WHEN piece = 1 THEN n ELSE -100 END AS label, row_number() OVER (PARTITION BY doc_id ORDER BY word, piece) AS idx FROM s) "
    "SELECT doc_id, string_agg(CAST(label AS VARCHAR), ' ' ORDER BY idx) AS same, string_agg(CAST(coalesce(ahead, -100) AS VARCHAR), ' ' ORDER BY idx) AS next "
    "FROM (SELECT *, lead(label) OVER (PARTITION BY doc_id ORDER BY idx) AS ahead FROM l) GROUP BY doc_id",
)
def _(spark, d):
    # Words are cut into pieces of four letters, and a word's label is its length.
    rows = t.documents(spark, d).select("doc_id", F.transform(tx.word_tokens(F.col("text")), lambda w: F.length(w)).alias("labels"))
    pieces = F.flatten(F.transform("labels", lambda n, i: F.array_repeat(i.cast("int"), F.ceil(n / 4.0).cast("int"))))
    rows = rows.withColumn("word_ids", pieces)
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    align = lambda mode: text_rows.align_labels(F.col("word_ids"), F.col("labels"), mode)
    return rows.select("doc_id", shown(align("same_token")).alias("same"), shown(align("next_token")).alias("next"))


@query(
    "p24_trimmed_passage",
    using(r"SELECT docid, regexp_replace(CASE WHEN title IS NOT NULL THEN title || ' ' || text ELSE text END, '^\s+|\s+$', '', 'g') AS text FROM corpus", "corpus"),
)
def _(spark, d):
    return t.corpus(spark, d).select("docid", tx.trimmed_passage(F.col("title"), F.col("text")).alias("text"))


@query(
    "p25_margin_rows",
    using(_train_sql(_sql_tokens("'query: ' || query", 29), _passage_sql("passage: ", 61), _passage_sql("passage: ", 61)), *TRAIN_PARTS),
)
def _(spark, d):
    return _train_out(text_rows.margin_train_rows(t.judged(spark, d), p_max=64))
