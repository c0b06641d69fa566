"""Readers. Lines that cannot be read go to a quarantine frame (source, line, reason) instead of vanishing.

Readers with `on_bad` give good rows only and fail on a bad line ("fail"), or give both frames ("split").
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.functions.text import let, strip
from quillrank.operators.rerank import MAX_LIST, grouped_lists
from quillrank.session import settled

Paths = str | Sequence[str]
TRIPLET = "query string, positive string, negative string"
JUDGED = (
    "query_id string, query string, answers array<string>, "
    "positive_passages array<struct<docid:string,title:string,text:string,score:double>>, "
    "negative_passages array<struct<docid:string,title:string,text:string,score:double>>"
)
TOKENISED_ROWS = "text_id string, text array<int>"
TOKENISED_EXAMPLES = "query array<int>, positives array<array<int>>, negatives array<array<int>>"


def read_lines(spark: SparkSession, paths: Paths, only: str | None = None) -> DataFrame:
    """Non-blank lines with the file they came from; `only` is a pattern of file names. A missing path is an error."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths), pathGlobFilter=only)
    return lines.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line")).where(
        ~F.col("line").rlike(r"\A\s*\z")
    )


def _split(lines: DataFrame, bad: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    marked = lines.withColumn("_reason", F.when(bad, reason))
    return marked.where(F.col("_reason").isNull()).drop("_reason"), marked.where(F.col("_reason").isNotNull()).select(
        "source", "line", F.col("_reason").alias("reason")
    )


def _kept(lines: DataFrame, bad: Column, reason: Column, on_bad: str) -> tuple[DataFrame, DataFrame]:
    """Good lines and the quarantine; with "fail" the good lines stop with an error at the first bad one."""
    if on_bad not in ("fail", "split"):
        raise ValueError(f"unknown on_bad {on_bad}")
    bad = F.coalesce(bad, F.lit(False))
    good, quarantine = _split(lines, bad, reason)
    if on_bad == "fail":
        stop = F.raise_error(F.concat(F.lit("bad line in "), "source", F.lit(": "), reason))
        good = lines.where(F.when(bad, stop.cast("boolean")).otherwise(True))
    return good, quarantine


def _given(good: DataFrame, bad: DataFrame, on_bad: str) -> DataFrame | tuple[DataFrame, DataFrame]:
    return good if on_bad == "fail" else (good, bad)


def _trimmed(line: str = "line") -> Column:
    return strip(F.col(line))


def read_sparse_corpus(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """JSON lines {"id", "vector"} to (id, vector), and the quarantine."""
    shape = "id string, vector map<string,double>, _corrupt_record string"
    parsed = F.from_json(_trimmed(), shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    lines = read_lines(spark, paths).withColumn("_doc", parsed)
    bad_json = F.col("_doc").isNull() | F.col("_doc._corrupt_record").isNotNull()
    no_key = F.col("_doc.id").isNull() | F.col("_doc.vector").isNull()
    good, bad = _split(lines, bad_json | no_key, F.when(bad_json, F.lit("not json")).otherwise(F.lit("missing key")))
    return good.select("_doc.id", "_doc.vector"), bad


def read_sparse_queries(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """`qid TAB {term: weight}` or `qid TAB term term ...`, told apart line by line, to (id, vector)."""
    fields = F.split(_trimmed(), "\t", -1)
    lines = read_lines(spark, paths).withColumn("_f", fields)
    vector = F.from_json(F.get("_f", F.lit(1)), "map<string,double>")
    lines = lines.withColumn("_json", F.coalesce(F.get("_f", F.lit(1)).startswith("{"), F.lit(False))).withColumn("_v", vector)
    two = F.size("_f") == 2
    good, bad = _split(
        lines,
        ~two | (F.col("_json") & F.col("_v").isNull()),
        F.when(~two, F.lit("not two fields")).otherwise(F.lit("not json")),
    )
    body = good.select(F.get("_f", F.lit(0)).alias("id"), F.get("_f", F.lit(1)).alias("_body"), "_json", "_v")
    counted = _count_words(F.col("_body"))
    return body.select("id", F.when(F.col("_json"), F.col("_v")).otherwise(counted).alias("vector")), bad


def _count_words(body: Column) -> Column:
    """Words of one line to a map word -> count; sorted first, so that equal words are neighbours."""
    words = F.array_sort(F.filter(F.split(body, r"\s+"), lambda w: F.length(w) > 0))
    return let(words, lambda w: let(_run_starts(w), lambda s: _run_lengths(w, s)))


def _run_starts(words: Column) -> Column:
    fresh = lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1))
    places = F.transform(words, lambda w, i: F.when(fresh(i), i))
    return F.filter(places, lambda i: i.isNotNull())


def _run_lengths(words: Column, starts: Column) -> Column:
    end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(words))
    counts = F.transform(starts, lambda i, j: F.struct(F.get(words, i), (end(j) - i).cast("double")))
    return F.map_from_entries(counts)


def read_repeated_queries(lines: DataFrame, line: str = "line") -> DataFrame:
    """`qid TAB term term ...` to postings, weight = how often a term stands there."""
    fields = lines.select(F.split(_trimmed(line), "\t", -1).alias("_f")).where(F.size("_f") == 2)
    # The id is taken before the explode: what stands beside an explode is computed once per element.
    rows = fields.select(F.get("_f", F.lit(0)).alias("id"), F.split(F.get("_f", F.lit(1)), r"\s+").alias("_w"))
    words = rows.select("id", F.explode("_w").alias("term"))
    return words.where(F.length("term") > 0).groupBy("id", "term").agg(F.count(F.lit(1)).alias("weight"))


def read_vectors(spark: SparkSession, paths: Paths) -> DataFrame:
    """Dense vectors (id, embedding) from Parquet; paths may be patterns that match many shards."""
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return rows.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))


def _tsv(spark: SparkSession, paths: Paths, names: Sequence[str], on_bad: str, whole: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines of exactly the named fields, as they stand between tabs; `whole` names a field that must be a whole number."""
    lines = read_lines(spark, paths).withColumn("_f", F.split("line", "\t", -1))
    count = F.size("_f") != len(names)
    number = F.get("_f", F.lit(list(names).index(whole))).try_cast("int") if whole else None
    bad = count if whole is None else count | number.isNull()
    reason = F.when(count, F.lit(f"not {len(names)} fields")).otherwise(F.lit(f"{whole} is no whole number"))
    good, quarantine = _kept(lines, bad, reason, on_bad)
    fields = [number.alias(n) if n == whole else F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)]
    return good.select(*fields), quarantine


def read_queries(spark: SparkSession, paths: Paths, on_bad: str = "fail") -> DataFrame | tuple[DataFrame, DataFrame]:
    """`query_id TAB query`."""
    return _given(*_tsv(spark, paths, ["query_id", "query"], on_bad), on_bad)


def read_collection(spark: SparkSession, paths: Paths, on_bad: str = "fail") -> DataFrame | tuple[DataFrame, DataFrame]:
    """`docid TAB title TAB text`. An empty title is a missing one."""
    rows, bad = _tsv(spark, paths, ["docid", "title", "text"], on_bad)
    return _given(rows.withColumn("title", F.nullif("title", F.lit(""))), bad, on_bad)


def read_qrels(
    spark: SparkSession, paths: Paths, strict: bool = True, on_bad: str = "fail"
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """`topic TAB iter TAB docid TAB rel`; strict fails on any judgment but 1."""
    rows, bad = _tsv(spark, paths, ["qid", "iter", "docid", "rel"], on_bad, "rel")
    if strict:
        rows = rows.where(F.assert_true(F.col("rel") == 1, "judgment other than 1").isNull())
    return _given(rows.select("qid", "docid", "rel"), bad, on_bad)


def qrel_lists(qrels: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """Documents of each query as lists (qid, part, docids)."""
    return grouped_lists(qrels, "qid", "docid", "docids", max_list)


def parse_run(lines: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Run lines of 3 fields (q d s), 4 (q d _ s) or 6 (q _ d _ s _), and the quarantine."""
    fields = F.split(_trimmed(line), r"\s+")
    work = lines.withColumn("_f", fields)
    at = lambda i: F.get("_f", F.lit(i))
    n = F.size("_f")
    docid = F.when(n == 6, at(2)).otherwise(at(1))
    score = F.when(n == 3, at(2)).when(n == 4, at(3)).otherwise(at(4)).try_cast("double")
    work = work.withColumn("_d", docid).withColumn("_s", score)
    known = n.isin(3, 4, 6)
    good, bad = _split(
        work, ~known | F.col("_s").isNull(), F.when(~known, F.lit("not 3, 4 or 6 fields")).otherwise(F.lit("score"))
    )
    return good.select(at(0).alias("qid"), F.col("_d").alias("docid"), F.col("_s").alias("score")), bad


def read_run(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    return parse_run(read_lines(spark, paths))


def read_ranks(spark: SparkSession, paths: Paths, on_bad: str = "fail") -> DataFrame | tuple[DataFrame, DataFrame]:
    """`qid TAB docid TAB rank`."""
    return _given(*_tsv(spark, paths, ["qid", "docid", "rank"], on_bad, "rank"), on_bad)


def _json_rows(lines: DataFrame, schema: str, on_bad: str) -> tuple[DataFrame, DataFrame]:
    """(source, columns of the schema) of JSON lines, and the lines that are not such objects. A missing key is null."""
    shape = f"{schema}, _corrupt_record string"
    parsed = F.from_json(_trimmed(), shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    lines = lines.withColumn("_doc", parsed)
    bad = F.col("_doc").isNull() | F.col("_doc._corrupt_record").isNotNull()
    good, quarantine = _kept(lines, bad, F.lit("not json of this form"), on_bad)
    return good.select("source", "_doc.*").drop("_corrupt_record"), quarantine


def read_bundle(spark: SparkSession, path: str, dataset: str, on_bad: str = "fail") -> dict[str, DataFrame]:
    """Corpus, queries and the judgments of a dataset's test split (dev for msmarco); with "split" also `bad` lines."""
    split = "dev" if dataset == "msmarco" else "test"
    base = f"{path}/{dataset}"
    corpus, bad_docs = _json_rows(read_lines(spark, f"{base}/corpus.jsonl"), "_id string, title string, text string", on_bad)
    queries, bad_queries = _json_rows(read_lines(spark, f"{base}/queries.jsonl"), "_id string, text string", on_bad)
    shape = "qid string, docid string, rel int, _corrupt_record string"
    judged = spark.read.csv(f"{base}/qrels/{split}.tsv", sep="\t", header=True, schema=shape)
    judged = judged.withColumn("source", F.col("_metadata.file_path"))
    judged = judged.withColumn("line", F.coalesce("_corrupt_record", F.concat_ws("\t", "qid", "docid")))
    no_rel = F.col("_corrupt_record").isNotNull() | F.col("rel").isNull()
    qrels, bad_qrels = _kept(judged, no_rel, F.lit("not a judgment"), on_bad)
    found = {
        "corpus": corpus.select(F.col("_id").alias("docid"), "title", "text"),
        "queries": queries.select(F.col("_id").alias("query_id"), F.col("text").alias("query")),
        "qrels": qrels.select("qid", "docid", "rel"),
    }
    return found if on_bad == "fail" else found | {"bad": bad_docs.unionByName(bad_queries).unionByName(bad_qrels)}


def read_triplets(spark: SparkSession, directory: str, on_bad: str = "fail") -> DataFrame | tuple[DataFrame, DataFrame]:
    """One JSON-lines file per task; the file name is the task."""
    rows, bad = _json_rows(read_lines(spark, f"{directory}/*.jsonl*"), TRIPLET, on_bad)
    name = F.regexp_extract(F.col("source"), r"([^/]+?)\.jsonl[^/]*(/[^/]*)?$", 1)
    return _given(rows.select(name.alias("task_name"), "query", "positive", "negative"), bad, on_bad)


def read_sentences(spark: SparkSession, paths: Paths) -> DataFrame:
    """Each line is its own positive: (query, positive)."""
    line = strip(F.col("value"))
    return spark.read.text(paths if isinstance(paths, str) else list(paths)).select(line.alias("query"), line.alias("positive"))


def read_training(
    spark: SparkSession, path: str, schema: str = JUDGED, on_bad: str = "fail"
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Judged rows from one file, or from every .json and .jsonl file of a directory."""
    only = None if path.endswith((".json", ".jsonl")) else "*.{json,jsonl}"
    rows, bad = _json_rows(read_lines(spark, path, only), schema, on_bad)
    return _given(rows.drop("source"), bad, on_bad)


def read_text_source(spark: SparkSession, path: str, extension: str | None = None, schema: str | None = None) -> DataFrame:
    """Texts by file extension: txt as lines, json or jsonl, csv with a header, parquet.

    With a `schema`, JSON is read in one pass; without, a pass before finds its fields.
    """
    kind = extension or path.rsplit(".", 1)[-1]
    if kind in ("txt", "text"):
        return spark.read.text(path).withColumnRenamed("value", "text")
    if kind in ("json", "jsonl"):
        return (spark.read if schema is None else spark.read.schema(schema)).json(path)
    if kind == "csv":
        return read_csv(spark, path)
    return spark.read.format(kind).load(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header, all columns as text, quotes doubled inside quotes; a large file is read by many tasks.

    A quoted field may hold line ends, so a split of a file can begin inside one. Each split counts its quotes; whether it begins
    inside a field is the parity of all quotes before it. Lines are then records, or parts of the record that began
    before them, and only records of several lines are brought together. Line ends inside fields become newlines.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    lines = settled(lines.withColumn("quotes", F.length(F.regexp_replace("value", '[^"]', ""))), "lines")
    before = lambda *keys: Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, *keys: F.coalesce(F.sum(c).over(before(*keys)), F.lit(0))
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    blocks = blocks.select("file", "block", sums("quotes", "file").alias("earlier"))
    within = Window.partitionBy("file", "block").orderBy("at")
    past = F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.join(F.broadcast(blocks), ["file", "block"]).withColumn("begins", (F.col("earlier") + past) % 2 == 0)
    number = F.sum(F.col("begins").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0))
    lines = settled(lines.select("file", "block", "at", "value", "quotes", "begins", number.alias("number")), "numbered")
    # Records are numbered through a file; what a block has before its first record belongs to the last one before.
    starts = lines.groupBy("file", "block").agg(F.max("number").alias("records"))
    starts = starts.select("file", "block", sums("records", "file").alias("first"))
    lines = lines.join(F.broadcast(starts), ["file", "block"]).withColumn("record", F.col("number") + F.col("first"))
    several = F.col("quotes") % 2 == 1
    whole = lines.where(F.col("begins") & ~several).select("file", "record", "value")
    parts = lines.where(~(F.col("begins") & ~several)).groupBy("file", "record")
    joined = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    long_ = parts.agg(F.array_join(F.transform(joined, lambda p: p["value"]), "\n").alias("value"))
    heads = whole.union(long_.select("file", "record", "value")).where("record = 1")
    head = heads.orderBy("file").first()
    if head is None:
        return spark.createDataFrame([], "text string")
    names = next(csv.reader(io.StringIO(head["value"], newline="")))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    records = whole.union(long_.select("file", "record", "value")).where("record > 1 and value <> ''")
    return records.select(F.from_csv("value", schema, {"escape": '"'}).alias("row")).select("row.*")


def read_tokenised(
    spark: SparkSession, path: str, schema: str = TOKENISED_ROWS, on_bad: str = "fail"
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Rows tokenised before; they skip every text step."""
    rows, bad = _json_rows(read_lines(spark, path), schema, on_bad)
    return _given(rows.drop("source"), bad, on_bad)


def read_dataset(
    spark: SparkSession, root: str, name: str | None, schema: str = JUDGED, on_bad: str = "fail"
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Judged rows of a dataset by its address, see parse_dataset_name.

    Below `root`, a dataset is a folder of its name, a language a folder in it, and a split a folder or a .json or
    .jsonl file in that. The default language may be left out, as may be the name for plain files.
    """
    base, language, split = parse_dataset_name(name)
    names = [base] if name is not None else []
    if language != "default":
        names.append(language)
    path = spark._jvm.org.apache.hadoop.fs.Path
    folders = ["/".join([root.rstrip("/"), *names])]
    if language == "default":
        folders.insert(0, f"{folders[0]}/default")
    for folder in folders:
        for place in (f"{folder}/{split}", f"{folder}/{split}.jsonl", f"{folder}/{split}.json"):
            if path(place).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(place)):
                return read_training(spark, place, schema, on_bad)
    raise FileNotFoundError(f"no {split} split of {base} ({language}) below {root}")


def parse_dataset_name(name: str | None) -> tuple[str, str, str]:
    """`name[:language][/split]` to (name, language, split); with three slash parts the last is the split."""
    if name is None:
        return "json", "default", "train"
    parts = name.split("/")
    split = parts[-1] if len(parts) == 3 else "train"
    base = "/".join(parts[:-1]) if len(parts) == 3 else name
    base, _, language = base.partition(":")
    return base, language or "default", split
