"""Readers and writers, each checked by a round trip over derived files in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators import sparse
from quillrank.plans import tables as t
from quillrank.plans.registry import query, using
from quillrank.session import fresh_path
from quillrank.sources import readers, writers

ONE_LINE = r"\s+"


def _flat(text: str):
    """Texts for one-line formats: any white space becomes one blank."""
    return F.trim(F.regexp_replace(text, ONE_LINE, " "))


def _long_postings(vectors: DataFrame) -> DataFrame:
    return sparse.to_postings(vectors).withColumn("weight", F.col("weight").cast("long"))


def _sql_flat(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return sparse.to_vectors(t.doc_postings(spark, d))


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return sparse.to_vectors(t.query_postings(spark, d))


@query("s1_sparse_corpus_reader", using("SELECT id, term, weight FROM doc_post", "doc_post"))
def _(spark, d):
    path = fresh_path(spark, "corpus")
    writers.write_lines(writers.corpus_lines(_vectors(spark, d)), path)
    good, _bad = readers.read_sparse_corpus(spark, path)
    return _long_postings(good)


@query("s2_sparse_query_json", using("SELECT id, term, weight FROM query_post", "query_post"))
def _(spark, d):
    path = fresh_path(spark, "queries")
    writers.write_lines(writers.query_lines(_query_vectors(spark, d)), path)
    good, _bad = readers.read_sparse_queries(spark, path)
    return _long_postings(good)


@query("s3_sparse_query_repeated", using("SELECT id, term, weight FROM query_post", "query_post"))
def _(spark, d):
    path = fresh_path(spark, "queries")
    writers.write_lines(writers.query_lines(_query_vectors(spark, d), repeated=True), path)
    return readers.read_repeated_queries(readers.read_lines(spark, path))


@query(
    "s4_query_format_detection",
    using("SELECT id || form AS id, term, weight FROM query_post, (VALUES ('-json'), ('-words')) v(form)", "query_post"),
)
def _(spark, d):
    path = fresh_path(spark, "queries")
    vectors = _query_vectors(spark, d)
    named = lambda form: vectors.withColumn("id", F.concat("id", F.lit(form)))
    mixed = writers.query_lines(named("-json")).unionByName(writers.query_lines(named("-words"), repeated=True))
    writers.write_lines(mixed, path)
    good, _bad = readers.read_sparse_queries(spark, path)
    return _long_postings(good)


@query(
    "s5_sparse_corpus_writer",
    using(
        "SELECT id, '' AS contents, count(*) AS terms, CAST(sum(weight) AS BIGINT) AS mass FROM doc_post GROUP BY id",
        "doc_post",
    ),
)
def _(spark, d):
    path = fresh_path(spark, "corpus")
    writers.write_lines(writers.corpus_lines(_vectors(spark, d), "contents"), path)
    rows = spark.read.schema("id string, contents string, vector map<string,long>").json(path)
    mass = F.aggregate(F.map_values("vector"), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("id", "contents", F.size("vector").cast("long").alias("terms"), mass.alias("mass"))


@query(
    "s6_sparse_query_writer",
    using(
        "SELECT id || chr(9) || string_agg(trim(repeat(term || ' ', CAST(weight AS INT))), ' ' ORDER BY weight DESC, term) "
        "AS line FROM query_post GROUP BY id",
        "query_post",
    ),
)
def _(spark, d):
    path = fresh_path(spark, "queries")
    writers.write_lines(writers.query_lines(_query_vectors(spark, d), repeated=True), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "s7_shard_merge",
    using("SELECT id, count(*) AS terms, CAST(sum(weight) AS BIGINT) AS mass FROM doc_post GROUP BY id", "doc_post"),
)
def _(spark, d):
    shards = []
    vectors = _vectors(spark, d).join(
        t.documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), "lang"), "id"
    )
    base, apart = fresh_path(spark, "shards"), fresh_path(spark, "vectors")
    named = ("en", "fr", "de", "es")
    shard = F.when(F.col("lang").isin(*named), F.col("lang")).otherwise(F.lit("rest"))
    # Vectors are made once, and each shard reads its own.
    placed = vectors.withColumn("shard", shard).drop("lang")
    placed.write.partitionBy("shard").parquet(apart)
    made = spark.read.schema(placed.schema).parquet(apart)
    for lang in (*named, "rest"):
        writers.write_lines(writers.corpus_lines(made.where(F.col("shard") == lang).drop("shard")), f"{base}/{lang}")
        shards.append(readers.read_sparse_corpus(spark, f"{base}/{lang}")[0])
    merged = writers.merge_shards(shards)
    mass = F.aggregate(F.map_values("vector"), F.lit(0.0), lambda a, x: a + x)
    return merged.select("id", F.size("vector").cast("long").alias("terms"), mass.cast("long").alias("mass"))


VECTOR_SUMS = (
    "SELECT id, CAST(len(e) AS BIGINT) AS dims, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS length, "
    "round(e[1], 6) AS first FROM vec"
)


def _vector_sums(rows: DataFrame) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select(
        "id",
        F.size("embedding").cast("long").alias("dims"),
        F.round(F.sqrt(square), 6).alias("length"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"),
    )


@query("s8_dense_vectors", using(VECTOR_SUMS, "vec"))
def _(spark, d):
    path = fresh_path(spark, "vectors")
    writers.write_vectors(t.vectors(spark, d), path)
    return _vector_sums(readers.read_vectors(spark, path))


@query("s9_glob_shards", using(VECTOR_SUMS, "vec"))
def _(spark, d):
    base = fresh_path(spark, "vectors")
    rows = t.vectors(spark, d)
    low = F.coalesce(F.col("label") < 5, F.lit(False))
    writers.write_vectors(rows.where(low), f"{base}/shard-a")
    writers.write_vectors(rows.where(~low), f"{base}/shard-b")
    return _vector_sums(readers.read_vectors(spark, f"{base}/shard-*"))


@query("s10_query_tsv", using(f"SELECT query_id, {_sql_flat('query')} AS query FROM queries", "queries"))
def _(spark, d):
    path = fresh_path(spark, "tsv")
    rows = t.queries(spark, d).select(F.concat_ws("\t", "query_id", _flat("query")).alias("value"))
    writers.write_lines(rows, path)
    return readers.read_queries(spark, path)


@query(
    "s11_collection_tsv",
    using(f"SELECT docid, title, {_sql_flat('text')} AS text FROM corpus", "corpus"),
)
def _(spark, d):
    path = fresh_path(spark, "tsv")
    rows = t.corpus(spark, d).select(
        F.concat_ws("\t", F.col("docid"), F.coalesce("title", F.lit("")), _flat("text")).alias("value")
    )
    writers.write_lines(rows, path)
    return readers.read_collection(spark, path)


@query(
    "s12_qrels_reader",
    using(
        "SELECT qid, CAST(0 AS BIGINT) AS part, string_agg(docid, ',' ORDER BY docid) AS docids FROM qrels GROUP BY qid",
        "qrels",
    ),
)
def _(spark, d):
    path = fresh_path(spark, "qrels")
    rows = t.qrels(spark, d).select(F.concat_ws("\t", F.col("qid"), F.lit("0"), F.col("docid"), F.col("rel").cast("string")).alias("value"))
    writers.write_lines(rows, path)
    lists = readers.qrel_lists(readers.read_qrels(spark, path))
    return lists.select("qid", "part", F.array_join("docids", ",").alias("docids"))


RUN_SQL = "SELECT qid, docid, CAST(score AS DOUBLE) AS score FROM run"


@query(
    "s13_run_reader",
    using(
        "SELECT qid || form AS qid, docid, CAST(score AS DOUBLE) AS score FROM run, (VALUES ('-3'), ('-4'), ('-6')) v(form)",
        "run",
    ),
)
def _(spark, d):
    path = fresh_path(spark, "run")
    rows = t.run(spark, d).withColumn("s", F.col("score").cast("string")).withColumn("r", F.col("rank").cast("string"))
    q = lambda form: F.concat("qid", F.lit(form))
    three = rows.select(F.concat_ws("\t", q("-3"), "docid", "s").alias("value"))
    four = rows.select(F.concat_ws("\t", q("-4"), "docid", "r", "s").alias("value"))
    six = rows.select(F.concat_ws(" ", q("-6"), F.lit("Q0"), "docid", "r", "s", F.lit("tag")).alias("value"))
    writers.write_lines(three.unionByName(four).unionByName(six), path)
    good, _bad = readers.read_run(spark, path)
    return good


@query("s14_run_writer", using("SELECT qid || chr(9) || docid || chr(9) || CAST(score AS VARCHAR) AS line FROM run", "run"))
def _(spark, d):
    path = fresh_path(spark, "run")
    writers.write_run(t.run(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("s15_rank_writer", using("SELECT qid, docid, CAST(rank AS INT) AS rank FROM run", "run"))
def _(spark, d):
    path = fresh_path(spark, "ranks")
    writers.write_ranks(t.run(spark, d).drop("rank"), path)
    return readers.read_ranks(spark, path)


@query("s16_rank_conversion", using("SELECT qid || chr(9) || docid || chr(9) || CAST(rank AS VARCHAR) AS line FROM run", "run"))
def _(spark, d):
    path = fresh_path(spark, "run")
    writers.write_run(t.run(spark, d), path)
    run, _bad = readers.read_run(spark, path)
    return writers.rank_lines(run).select(F.col("value").alias("line"))


@query(
    "s17_trec_conversion",
    using(
        "SELECT qid || ' Q0 ' || docid || ' ' || CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS VARCHAR) "
        "|| ' ' || CAST(score AS VARCHAR) || ' dense' AS line FROM run WHERE qid <> docid",
        "run",
    ),
)
def _(spark, d):
    return writers.trec_lines(t.run(spark, d), remove_query=True).select(F.col("value").alias("line"))


@query("s18_score_file_ranks", using("SELECT qid, docid, CAST(rank AS INT) AS rank FROM run", "run"))
def _(spark, d):
    path = fresh_path(spark, "scores")
    rows = t.run(spark, d).orderBy("docid").select(F.concat_ws(" ", "qid", "docid", F.col("score").cast("string")).alias("value"))
    blanks = rows.select(F.lit("").alias("value"))
    writers.write_lines(rows.unionByName(blanks), path)
    run, _bad = readers.read_run(spark, path)
    return writers.with_rank(run).select("qid", "docid", F.col("rank").cast("int").alias("rank"))


@query("s19_sharded_json", "SELECT count(*) AS rows, CAST(count(*) - 1 AS BIGINT) AS last, true AS within FROM documents")
def _(spark, d):
    path = fresh_path(spark, "shards")
    writers.write_json_shards(t.documents(spark, d).select("doc_id", "text"), path, 100)
    rows = spark.read.schema("doc_id long, text string").json(path).withColumn("file", F.col("_metadata.file_path"))
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    return sizes.agg(F.sum("n").alias("rows"), F.max("last").alias("last"), (F.max("n") <= 100).alias("within"))


@query(
    "s21_benchmark_bundle",
    using(
        "SELECT qid, docid, query, length(text) AS size, CAST(rel AS INT) AS rel FROM qrels "
        "JOIN queries ON qid = query_id JOIN corpus USING (docid)",
        "qrels",
        "queries",
        "corpus",
    ),
)
def _(spark, d):
    base = fresh_path(spark, "bundle")
    t.corpus(spark, d).withColumnRenamed("docid", "_id").write.json(f"{base}/set/corpus.jsonl")
    t.queries(spark, d).select(F.col("query_id").alias("_id"), F.col("query").alias("text")).write.json(f"{base}/set/queries.jsonl")
    t.qrels(spark, d).select("qid", "docid", "rel").write.csv(f"{base}/set/qrels/test.tsv", sep="\t", header=True)
    bundle = readers.read_bundle(spark, base, "set")
    asked = bundle["queries"].withColumnRenamed("query_id", "qid")
    joined = bundle["qrels"].join(asked, "qid").join(bundle["corpus"], "docid")
    return joined.select("qid", "docid", "query", F.length("text").cast("long").alias("size"), "rel")


@query(
    "s22_task_triplets_reader",
    using(
        "SELECT CASE WHEN turn <= 1 THEN 'allnli' ELSE 'fever' END AS task_name, query, positive, negative FROM turns",
        "turns",
    ),
)
def _(spark, d):
    base = fresh_path(spark, "triplets")
    rows = t.turns(spark, d).select("turn", "query", "positive", "negative")
    rows.where("turn <= 1").drop("turn").write.json(f"{base}/allnli.jsonl")
    rows.where("turn > 1").drop("turn").write.json(f"{base}/fever.jsonl")
    return readers.read_triplets(spark, base)


@query(
    "s23_sentence_reader",
    f"SELECT {_sql_flat('text')} AS query, {_sql_flat('text')} AS positive FROM documents",
)
def _(spark, d):
    path = fresh_path(spark, "sentences")
    writers.write_lines(t.documents(spark, d).select(F.concat(F.lit("  "), _flat("text"), F.lit(" ")).alias("value")), path)
    return readers.read_sentences(spark, path)


@query(
    "s19_exact_splits",
    using(
        "SELECT CAST(place * 7 // total AS BIGINT) AS split, count(*) AS rows, min(docid) AS first, max(docid) AS last FROM "
        "(SELECT docid, row_number() OVER (ORDER BY docid) - 1 AS place, count(*) OVER () AS total FROM corpus) GROUP BY 1",
        "corpus",
    ),
)
def _(spark, d):
    """Seven files of the corpus, by the number in their names."""
    path = fresh_path(spark, "splits")
    writers.write_json_splits(t.corpus(spark, d), path, 7, "docid")
    split = F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1).cast("long").alias("split")
    rows = spark.read.schema("docid string, title string, text string").json(path).select("docid", split)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("docid").alias("first"), F.max("docid").alias("last"))


@query(
    "s24_training_directory",
    using(
        "SELECT query_id, query, coalesce(n, 0) AS positives FROM queries LEFT JOIN "
        "(SELECT qid, count(*) AS n FROM qrels GROUP BY qid) ON qid = query_id",
        "queries",
        "qrels",
    ),
)
def _(spark, d):
    path = fresh_path(spark, "train")
    t.judged(spark, d).write.json(path)
    rows = readers.read_training(spark, path)
    return rows.select("query_id", "query", F.size("positive_passages").cast("long").alias("positives"))


@query(
    "s25_text_source",
    f"SELECT kind, {_sql_flat('text')} AS text FROM documents, (VALUES ('csv'), ('json'), ('txt')) v(kind)",
)
def _(spark, d):
    rows = t.documents(spark, d).select(_flat("text").alias("text"))
    base = fresh_path(spark, "texts")
    rows.write.text(f"{base}/lines.txt")
    rows.write.json(f"{base}/rows.json")
    rows.write.csv(f"{base}/table.csv", header=True, escape='"')
    read = lambda name, kind: readers.read_text_source(spark, f"{base}/{name}").select(F.lit(kind).alias("kind"), "text")
    return read("lines.txt", "txt").unionByName(read("rows.json", "json")).unionByName(read("table.csv", "csv"))


@query(
    "s26_tokenised_rows",
    f"SELECT CAST(doc_id AS VARCHAR) AS text_id, CAST(len(w) AS BIGINT) AS size, "
    f"CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS total FROM "
    f"(SELECT doc_id, {t.sql_words('text')} AS w FROM documents)",
)
def _(spark, d):
    path = fresh_path(spark, "tokenised")
    from quillrank.functions.text import word_tokens

    rows = t.corpus(spark, d).select(
        F.col("docid").alias("text_id"), F.transform(word_tokens(F.col("text")), lambda w: F.length(w)).alias("text")
    )
    rows.write.json(path)
    back = readers.read_tokenised(spark, path)
    total = F.aggregate("text", F.lit(0).cast("long"), lambda a, x: a + x)
    return back.select("text_id", F.size("text").cast("long").alias("size"), total.alias("total"))



def _damaged(spark: SparkSession, d: str, *forms: str) -> str:
    """Lines of the given forms, each made from the id of every document."""
    path = fresh_path(spark, "damaged")
    each = [F.format_string(form, F.col("doc_id").cast("string")) for form in forms]
    writers.write_lines(t.documents(spark, d).select(F.explode(F.array(*each)).alias("value")), path)
    return path


@query(
    "s10_damaged_lines",
    "SELECT reader, count(*) AS good, 2 * count(*) AS bad, CAST(sum(length(CAST(doc_id AS VARCHAR))) AS BIGINT) AS mass "
    "FROM documents, (VALUES ('s10'), ('s11'), ('s12'), ('s15'), ('s21'), ('s22'), ('s24'), ('s26')) v(reader) GROUP BY reader",
)
def _(spark, d):
    """Each document gives every reader one good line and two damaged ones."""
    split = {"on_bad": "split"}
    lines = lambda *forms: _damaged(spark, d, *forms)
    bundle = f"{fresh_path(spark, 'bundle')}/set"
    writers.write_lines(spark.read.text(lines('{"_id": "%s"}', "{%s", '["%s"]')), f"{bundle}/corpus.jsonl")
    writers.write_lines(spark.range(0).select(F.lit("").alias("value")), f"{bundle}/queries.jsonl")
    writers.write_lines(spark.range(0).select(F.lit("").alias("value")), f"{bundle}/qrels/test.tsv")
    found = readers.read_bundle(spark, bundle.rsplit("/", 1)[0], "set", **split)
    triplets = f"{fresh_path(spark, 'triplets')}/task.jsonl"
    writers.write_lines(spark.read.text(lines('{"query": "%s"}', '{"query": "%s"', "%s query")), triplets)
    read = {
        "s10": ("query_id", readers.read_queries(spark, lines("%s\tq", "%s", "%s\tq\tq"), **split)),
        "s11": ("docid", readers.read_collection(spark, lines("%s\t\tx", "%s\tx", "%s\tt\tx\tx"), **split)),
        "s12": ("docid", readers.read_qrels(spark, lines("q\t0\t%s\t1", "q\t%s\t1", "q\t0\t%s\tx"), **split)),
        "s15": ("docid", readers.read_ranks(spark, lines("q\t%s\t1", "q %s 1", "q\t%s\tx"), **split)),
        "s21": ("docid", (found["corpus"], found["bad"])),
        "s22": ("query", readers.read_triplets(spark, triplets.rsplit("/", 1)[0], **split)),
        "s24": ("query_id", readers.read_training(spark, _named(spark, lines('{"query_id": "%s"}', "{%s}", "%s")), **split)),
        "s26": ("text_id", readers.read_tokenised(spark, lines('{"text_id": "%s", "text": [1]}', '{"text_id": "%s"', "[%s"), **split)),
    }
    marked = []
    for reader, (key, (good, bad)) in read.items():
        marked.append(good.select(F.lit(reader).alias("reader"), F.length(key).alias("mass")))
        marked.append(bad.select(F.lit(reader).alias("reader"), F.lit(None).cast("int").alias("mass")))
    rows = reduce(DataFrame.unionByName, marked)
    n_bad = F.sum(F.col("mass").isNull().cast("long")).alias("bad")
    return rows.groupBy("reader").agg(F.count("mass").alias("good"), n_bad, F.sum("mass").alias("mass"))


def _named(spark: SparkSession, path: str) -> str:
    """The same lines below a name that the directory reader takes as a file."""
    place = f"{fresh_path(spark, 'train')}/rows.jsonl"
    writers.write_lines(spark.read.text(path), place)
    return place
