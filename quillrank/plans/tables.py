"""The given tables in the shapes the operators read, and derived tables that are written once per session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import blocks, mining, search, sparse
from quillrank.plans.registry import part
from quillrank.session import fresh_path

DEPTH = 100

_written: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out by id where the files have fewer splits than the cluster has cores.

    Large inputs have more splits than cores and are read as they lie.
    """
    rows = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, "doc_id")


def _store(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def written(
    spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], store: Callable[[DataFrame, str], None] = _store
) -> DataFrame:
    """Stores a derived table in the shared folder at first use, as a run or an index would be, and reads it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = fresh_path(spark, name)
        store(make(), path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (docid, title, text); English ones have a title."""
    docs = documents(spark, sf_dir)
    title = F.when(F.col("lang") == "en", F.col("source"))
    return docs.select(F.col("doc_id").cast("string").alias("docid"), title.alias("title"), "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")
    )


def encoder_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(
        F.col("docid").alias("id"), tx.passage_text(F.col("title"), F.col("text")).alias("text")
    )


def encoder_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(spark, sf_dir).select(F.col("query_id").alias("id"), F.col("query").alias("text"))


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "frequencies", lambda: sparse.document_frequencies(encoder_docs(spark, sf_dir)))


def doc_count(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "documents").count()


def activations(spark: SparkSession, sf_dir: str, every_position: bool = True) -> DataFrame:
    return sparse.lexical_activations(
        encoder_docs(spark, sf_dir), frequencies(spark, sf_dir), doc_count(spark, sf_dir), every_position=every_position
    )


def _encode(spark: SparkSession, sf_dir: str, rows: DataFrame, known: DataFrame) -> DataFrame:
    return sparse.quantise(sparse.lexical_weights(rows, known, doc_count(spark, sf_dir)))


def make_doc_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoder_docs(spark, sf_dir)
    return sparse.fill_empty(_encode(spark, sf_dir, rows, frequencies(spark, sf_dir)), rows)


def make_query_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoder_queries(spark, sf_dir)
    return sparse.fill_empty(_encode(spark, sf_dir, rows, sparse.frequencies_for(rows, frequencies(spark, sf_dir))), rows)


def doc_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoder_docs(spark, sf_dir)
    make = lambda: _encode(spark, sf_dir, rows, frequencies(spark, sf_dir))
    return written(spark, sf_dir, "doc_postings", make, lambda df, path: sparse.write_filled(df, rows, path))


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "doc_blocks", lambda: blocks.pack(doc_postings(spark, sf_dir)))


def query_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "query_postings", lambda: make_query_postings(spark, sf_dir))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda: blocks.topk(doc_blocks(spark, sf_dir), query_postings(spark, sf_dir), DEPTH)
    return written(spark, sf_dir, "run", make)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(spark, sf_dir).select(F.col("query_id").alias("qid"), F.array("query").alias("answers"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is relevant to a query whose text it holds."""
    pairs = lambda: mining.answer_pairs(corpus(spark, sf_dir), answers(spark, sf_dir)).withColumn("rel", F.lit(1))
    return written(spark, sf_dir, "qrels", pairs)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged rows with positives by docid and the best ten other documents of the run as negatives."""

    def make() -> DataFrame:
        asked = queries(spark, sf_dir).withColumn("answers", F.array("query"))
        rows = mining.judged_rows(asked, qrels(spark, sf_dir), corpus(spark, sf_dir))
        return mining.basic_negatives(rows, run(spark, sf_dir), corpus(spark, sf_dir), 10)

    return written(spark, sf_dir, "judged", make)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("id"), "embedding", "label", "vec_id")


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vectors in a row make one text."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.floor(F.col("vec_id") / 4).cast("string").alias("id"),
        F.pmod("vec_id", F.lit(4)).alias("pos"),
        F.col("embedding").alias("vec"),
    )


def token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "token_matrices", lambda: search.token_matrix(token_vectors(spark, sf_dir)))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows and the turn before: pairs and triplets.

    Turns meet on (conv_id, turn), which is unique, so a long conversation is no hot key.
    """
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    answered = rows.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("positive")
    )
    earlier = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("negative"))
    joined = asked.join(answered, ["conv_id", "turn"]).join(earlier, ["conv_id", "turn"], "left")
    return joined.withColumn("negative", F.coalesce("negative", F.lit("")))


WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')"
FORM = r"(' ' || array_to_string(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{Z}}\p{{C}}]'), ' ') || ' ')"


def sql_words(text: str) -> str:
    return WORDS.format(text)


def sql_form(text: str) -> str:
    return FORM.format(text)


def sql_passage(title: str = "title", text: str = "text", sep: str = " ") -> str:
    return f"CASE WHEN {title} IS NOT NULL THEN {title} || '{sep}' || {text} ELSE {text} END"


part("corpus", "SELECT CAST(doc_id AS VARCHAR) AS docid, CASE WHEN lang = 'en' THEN source END AS title, text FROM documents")
part("queries", "SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark")
part("enc_docs", f"SELECT docid AS id, {sql_passage()} AS text FROM corpus", "corpus")
part("n", "SELECT CAST(count(*) AS DOUBLE) AS n FROM documents")
part(
    "doc_tokens",
    "SELECT id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos "
    f"FROM (SELECT id, {sql_words('lower(text)')} AS w FROM enc_docs)",
    "enc_docs",
)
part("frequencies", "SELECT term, count(DISTINCT id) AS df FROM doc_tokens GROUP BY term", "doc_tokens")
part(
    "activations",
    "SELECT id, pos, term, ln((n + 1) / (df + 1.0)) AS logit FROM doc_tokens JOIN frequencies USING (term), n",
    "doc_tokens",
    "frequencies",
    "n",
)
part("doc_max", "SELECT id, term, ln(1 + greatest(max(logit), 0)) AS weight FROM activations GROUP BY id, term", "activations")
part(
    "doc_post",
    "SELECT id, term, CAST(round_even(weight * 100, 0) AS BIGINT) AS weight FROM doc_max WHERE round_even(weight * 100, 0) > 0",
    "doc_max",
)
part(
    "query_max",
    "SELECT id, term, ln(1 + greatest(ln((n + 1) / (coalesce(df, 0) + 1.0)), 0)) AS weight FROM ("
    f"SELECT DISTINCT query_id AS id, unnest({sql_words('lower(query)')}) AS term FROM queries) "
    "LEFT JOIN frequencies USING (term), n",
    "queries",
    "frequencies",
    "n",
)
part(
    "query_post",
    "SELECT id, term, CAST(round_even(weight * 100, 0) AS BIGINT) AS weight FROM query_max "
    "WHERE round_even(weight * 100, 0) > 0",
    "query_max",
)
part(
    "scores",
    "SELECT q.id AS qid, d.id AS docid, CAST(sum(q.weight * d.weight) AS BIGINT) AS score "
    "FROM query_post q JOIN doc_post d USING (term) GROUP BY q.id, d.id",
    "query_post",
    "doc_post",
)
part(
    "run",
    "SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank "
    f"FROM scores QUALIFY rank <= {DEPTH}",
    "scores",
)
part(
    "qrels",
    "SELECT q.query_id AS qid, c.docid, 1 AS rel FROM "
    f"(SELECT docid, {sql_form('text')} AS f FROM corpus) c JOIN (SELECT query_id, {sql_form('query')} AS f FROM queries) q "
    "ON contains(c.f, q.f)",
    "corpus",
    "queries",
)
part("positives", "SELECT qid, docid, title, text FROM qrels JOIN corpus USING (docid)", "qrels", "corpus")
part(
    "negatives",
    "SELECT qid, rank, docid, title, text FROM (SELECT * FROM run WHERE rank <= 10) r "
    "ANTI JOIN qrels USING (qid, docid) JOIN corpus USING (docid)",
    "run",
    "qrels",
    "corpus",
)
part(
    "turns",
    "SELECT a.conv_id, a.turn, a.text AS query, b.text AS positive, coalesce(c.text, '') AS negative FROM conversations a "
    "JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' "
    "LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1 WHERE a.role = 'user'",
)
part(
    "vec",
    "SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings",
)
