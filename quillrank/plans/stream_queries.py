"""Incremental encoding and the plug-in points."""

from __future__ import annotations

import regex
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import plugins, sparse, text_rows
from quillrank.operators.placement import spread_join
from quillrank.plans import tables as t
from quillrank.plans.registry import query, using
from quillrank.session import dropped, fresh_path, settled
from quillrank.streaming import incremental, running

_WORD = regex.compile(tx.WORD_PATTERN)


@query(
    "t1_incremental_encode",
    using(
        "SELECT id, term, CAST(round_even(weight * 100, 0) AS INT) AS weight FROM doc_max WHERE round_even(weight * 100, 0) > 0",
        "doc_max",
    ),
)
def _(spark, d):
    frequencies, n = t.frequencies(spark, d), t.doc_count(spark, d)

    def encode(batch):
        title = F.when(F.col("lang") == "en", F.col("source"))
        rows = batch.select(F.col("doc_id").cast("string").alias("id"), tx.passage_text(title, F.col("text")).alias("text"))
        active = sparse.lexical_activations(rows, frequencies, n, every_position=False)
        return sparse.quantise(sparse.pool_max(active))

    schema = t.table(spark, d, "documents").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    texts = incremental.arriving_texts(spark, f"{d}/documents.parquet", schema)
    out, marks = fresh_path(spark, "encoded"), fresh_path(spark, "stream")
    incremental.encode_stream(texts, encode, out, marks).awaitTermination()
    return incremental.read_encoded(spark, out)


def _corpus_texts(spark, d):
    """(id, text, lang) of the corpus: its texts joined with the documents' languages by id.

    Both are of the same rows, so only those of an id that comes more than once are joined; rows without an id are left out.
    """
    title = F.when(F.col("lang") == "en", F.col("source"))
    text = tx.passage_text(title, F.col("text")).alias("text")
    rows = t.documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), text, "lang").where("id is not null")
    several = settled(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "several")
    if several.isEmpty():
        return rows
    again = spread_join(rows, several, "id", "left_semi")
    joined = again.drop("lang").join(again.select("id", "lang"), "id")
    return spread_join(rows, several, "id", "left_anti").unionByName(joined)


def _followed(spark, d):
    """The corpus as a stream of versions out of order: some last versions first, then drafts of all, then all last versions."""
    arriving, out, marks = (fresh_path(spark, n) for n in ("versions", "followed", "stream"))
    last = _corpus_texts(spark, d).select("id", F.lit(2).cast("long").alias("version"), "text", "lang")
    drafts = last.withColumns({"version": F.lit(1).cast("long"), "text": F.concat(F.lit("draft "), F.reverse("text"))})
    for shard in (last.where("lang in ('en', 'de')"), drafts, last):
        shard.drop("lang").write.mode("append").option("compression", "zstd").parquet(arriving)
        texts = incremental.arriving_texts(spark, arriving, "id string, version long, text string")
        running.follow_stream(texts, out, marks).awaitTermination()
        # A stream reads a file once: those that it has come to the end of take no more room.
        dropped(spark, arriving)
    return out


@query("t1_running_statistics", using("SELECT term, df FROM frequencies", "frequencies"))
def _(spark, d):
    return running.statistics(spark, _followed(spark, d))[0]


@query(
    "t1_running_postings",
    using(
        "SELECT id, term, CAST(round_even(weight * 100, 0) AS INT) AS weight FROM doc_max WHERE round_even(weight * 100, 0) > 0",
        "doc_max",
    ),
)
def _(spark, d):
    return sparse.quantise(running.postings(spark, _followed(spark, d)))


def split_words(texts):
    """A tokeniser to put in."""
    return [_WORD.findall(x) for x in texts]


@query("u1_tokenizer", f"SELECT doc_id, array_to_string({t.sql_words('text')}, ' ') AS tokens FROM documents")
def _(spark, d):
    words = plugins.tokenizer(split_words)
    return t.documents(spark, d).select("doc_id", F.array_join(words.one(F.col("text")), " ").alias("tokens"))


def count_encoder(texts):
    """An encoder to put in: letters, words and lines as a vector."""
    return [(len(x), len(_WORD.findall(x)), x.count("\n") + 1) for x in texts]


@query(
    "u2_vector_encoder",
    f"SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(text) AS BIGINT) AS letters, CAST(len({t.sql_words('text')}) AS BIGINT) AS words, "
    "CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents",
)
def _(spark, d):
    out = plugins.vector_encoder(t.documents(spark, d), count_encoder, "doc_id")
    at = lambda i: F.get("embedding", F.lit(i)).cast("long")
    return out.select("id", at(0).alias("letters"), at(1).alias("words"), at(2).alias("lines"))


def length_gap(queries, passages):
    return [float(abs(len(q) - len(p))) for q, p in zip(queries, passages)]


@query("u3_pair_scorer", using("SELECT query_id, docid, CAST(abs(length(query) - length(text)) AS DOUBLE) AS score FROM pairs", "pairs"))
def _(spark, d):
    from quillrank.operators.rerank import rerank_input

    pairs = rerank_input(t.run(spark, d), t.queries(spark, d), t.corpus(spark, d), t.DEPTH)
    score = plugins.pair_scorer(length_gap)
    return pairs.select("query_id", "docid", score(F.col("query"), F.col("text")).alias("score"))


@query(
    "u4_dataset_steps",
    using(
        "SELECT docid AS text_id, 'plain' AS steps, array_to_string(("
        + t.sql_words("('passage: ' || CASE WHEN title IS NOT NULL THEN title || ' ' || text ELSE text END)")
        + ")[1:256], ' ') AS text FROM corpus UNION ALL SELECT docid, 'own', array_to_string(("
        + t.sql_words("('query: ' || CASE WHEN title IS NOT NULL THEN title || ' ' || text ELSE text END)")
        + ")[1:40], ' ') FROM corpus",
        "corpus",
    ),
)
def _(spark, d):
    steps = plugins.DatasetSteps()
    own = lambda df: text_rows.corpus_rows(df, max_len=40, prefix=tx.QUERY_PREFIX)
    steps.register("forum", plugins.Steps(corpus=own))
    rows = t.corpus(spark, d)
    shown = lambda df, name: df.select("text_id", F.lit(name).alias("steps"), F.array_join("text", " ").alias("text"))
    return shown(steps.apply("unknown", "corpus", rows), "plain").unionByName(shown(steps.apply("forum-corpus", "corpus", rows), "own"))
