import csv
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import sparse, text_rows
from quillrank.operators.plugins import CONTRASTIVE_STEPS, DatasetSteps, Steps
from quillrank.session import fresh_path, shared_dir
from quillrank.sources import readers, writers
from quillrank.streaming import incremental


def lines(spark, values):
    path = fresh_path(spark, "lines")
    spark.createDataFrame([(v,) for v in values], "value string").coalesce(1).write.text(path)
    return path


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sparse_corpus_bad_lines_go_to_quarantine(spark):
    path = lines(spark, ['{"id": "1", "content": "", "vector": {"a": 1.5}}', "", "  ", "not json", '{"id": "2"}', '{"vector": {"a": 1}}', '{"id": 7, "vector": {}}'])
    good, bad = readers.read_sparse_corpus(spark, path)
    assert rows_of(good) == [("1", {"a": 1.5}), ("7", {})]
    assert sorted(r["reason"] for r in bad.collect()) == ["missing key", "missing key", "not json"]


def test_missing_file_is_an_error(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_sparse_corpus(spark, fresh_path(spark, "none"))


def test_sparse_queries_in_both_forms(spark):
    path = lines(spark, ['1\t{"a": 0.5, "b": 2}', "2\tx y x", "3", "4\ta\tb", "5\t{broken", "", "6\t  z  z "])
    good, bad = readers.read_sparse_queries(spark, path)
    assert {r["id"]: r["vector"] for r in good.collect()} == {"1": {"a": 0.5, "b": 2.0}, "2": {"x": 2.0, "y": 1.0}, "6": {"z": 2.0}}
    assert sorted(r["reason"] for r in bad.collect()) == ["not json", "not two fields", "not two fields"]
    repeated = readers.read_repeated_queries(readers.read_lines(spark, lines(spark, ["2\tx y x", "4\ta\tb", "6\tz"])))
    assert rows_of(repeated) == [("2", "x", 2), ("2", "y", 1), ("6", "z", 1)]


def test_run_lines_of_three_widths(spark):
    path = lines(spark, ["1 a 3.5", "1 b 2 3.25", "1 Q0 c 1 3.0 tag", "1 a", "1 a x", "", "1 a b c d"])
    good, bad = readers.read_run(spark, path)
    assert rows_of(good) == [("1", "a", 3.5), ("1", "b", 3.25), ("1", "c", 3.0)]
    assert sorted(r["reason"] for r in bad.collect()) == ["not 3, 4 or 6 fields", "not 3, 4 or 6 fields", "score"]


def test_strict_qrels(spark):
    path = lines(spark, ["1\t0\ta\t1", "1\t0\tb\t1"])
    assert rows_of(readers.qrel_lists(readers.read_qrels(spark, path))) == [("1", 0, ["a", "b"])]
    graded = lines(spark, ["1\t0\ta\t2"])
    assert rows_of(readers.read_qrels(spark, graded, strict=False)) == [("1", "a", 2)]
    with pytest.raises(Exception, match="judgment"):
        readers.read_qrels(spark, graded).collect()


def test_conversions_rank_after_the_query_is_taken_out(spark):
    run = spark.createDataFrame([("a", "a", 9.0), ("a", "b", 5.0), ("a", "c", 5.0), ("d", "x", 1.0)], "qid string, docid string, score double")
    trec = [r["value"] for r in writers.trec_lines(run, remove_query=True).collect()]
    assert trec == ["a Q0 b 1 5.0 dense", "a Q0 c 2 5.0 dense", "d Q0 x 1 1.0 dense"]
    assert [r["value"] for r in writers.trec_lines(run, "own").collect()][0] == "a Q0 a 1 9.0 own"
    assert [r["value"] for r in writers.rank_lines(run).collect()] == ["a\ta\t1", "a\tb\t2", "a\tc\t3", "d\tx\t1"]
    path = fresh_path(spark, "ranks")
    writers.write_ranks(run, path)
    assert rows_of(readers.read_ranks(spark, path)) == [("a", "a", 1), ("a", "b", 2), ("a", "c", 3), ("d", "x", 1)]
    writers.write_trec(run, fresh_path(spark, "trec"))


def test_tsv_readers_keep_quotes(spark):
    assert rows_of(readers.read_queries(spark, lines(spark, ['1\tsay "hi', "2\tb"]))) == [("1", 'say "hi'), ("2", "b")]
    assert rows_of(readers.read_collection(spark, lines(spark, ['1\t"T\tx', "2\t\ty"]))) == [("1", '"T', "x"), ("2", None, "y")]


def test_json_shards(spark):
    path = fresh_path(spark, "shards")
    rows = spark.range(95)
    writers.write_json_shards(rows.coalesce(1), path, 20)
    assert len(spark.read.json(path).inputFiles()) == 5
    writers.write_json_splits(rows, fresh_path(spark, "splits"), 3, "id")


def test_training_and_text_sources(spark):
    path = fresh_path(spark, "train")
    spark.createDataFrame([("1", "q")], "query_id string, query string").coalesce(1).write.json(path)
    row = readers.read_training(spark, path).first()
    assert (row["query_id"], row["negative_passages"]) == ("1", None)
    for kind, value in (("txt", "a b"), ("csv", "text\na b"), ("json", '{"text": "a b"}')):
        base = f"{fresh_path(spark, 'source')}.{kind}"
        spark.createDataFrame([(v,) for v in value.split("\n")], "value string").coalesce(1).write.text(base)
        assert [r["text"] for r in readers.read_text_source(spark, base).collect()] == ["a b"]


def test_tokenised_rows(spark):
    path = lines(spark, ['{"query": [1, 2], "positives": [[3], [4, 5]], "negatives": []}'])
    row = readers.read_tokenised(spark, path, readers.TOKENISED_EXAMPLES).first()
    assert (row["query"], row["positives"], row["negatives"]) == ([1, 2], [[3], [4, 5]], [])


def test_sentences(spark):
    assert rows_of(readers.read_sentences(spark, lines(spark, [" a b ", "c"]))) == [("a b", "a b"), ("c", "c")]


@pytest.mark.parametrize(
    "name, parts",
    [
        ("own/set", ("own/set", "default", "train")),
        ("own/set:fr/dev", ("own/set", "fr", "dev")),
        ("set:fr", ("set", "fr", "train")),
        (None, ("json", "default", "train")),
    ],
)
def test_dataset_name(name, parts):
    assert readers.parse_dataset_name(name) == parts


def test_dataset_steps(spark):
    steps = DatasetSteps()
    rows = spark.createDataFrame([("1", "a b")], "query_id string, query string")
    assert steps.apply("json", "query", rows) is rows
    assert steps.apply("any", "query", rows, max_len=2).first()["text"] == ["query", "a"]
    steps.register("pairs", CONTRASTIVE_STEPS)
    assert steps.steps_for("pairs-corpus", corpus=True) is CONTRASTIVE_STEPS
    assert steps.steps_for("pairs-corpus") == Steps()


def test_stream_encodes_each_file_once(spark):
    base, out, marks = (fresh_path(spark, n) for n in ("in", "out", "marks"))
    put = lambda i, text: spark.createDataFrame([(i, text)], "id string, text string").coalesce(1).write.mode("append").parquet(base)
    frequencies = spark.createDataFrame([("a", 1), ("b", 2)], "term string, df long")
    encode = lambda batch: sparse.quantise(sparse.pool_max(sparse.lexical_activations(batch, frequencies, 9)))

    def pass_over():
        texts = incremental.arriving_texts(spark, base, "id string, text string", files_per_trigger=1)
        incremental.encode_stream(texts, encode, out, marks).awaitTermination()
        return sorted((r["id"], r["term"]) for r in incremental.read_encoded(spark, out).collect())

    put("1", "a b")
    put("2", "b")
    assert pass_over() == [("1", "a"), ("1", "b"), ("2", "b")]
    put("3", "c a")
    assert pass_over() == [("1", "a"), ("1", "b"), ("2", "b"), ("3", "a"), ("3", "c")]
    assert pass_over() == [("1", "a"), ("1", "b"), ("2", "b"), ("3", "a"), ("3", "c")]


def test_shared_dir_is_the_session_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_query_writer_forms(spark):
    vectors = sparse.to_vectors(spark.createDataFrame([("1", "x", 1), ("1", "y", 2)], "id string, term string, weight int"))
    assert writers.query_lines(vectors).first()["value"] == '1\t{"y":2,"x":1}'
    assert writers.query_lines(vectors, repeated=True).first()["value"] == "1\ty y x"
    assert writers.corpus_lines(vectors).first()["value"] == '{"id":"1","content":"","vector":{"y":2,"x":1}}'
    assert text_rows.PASSAGE.names == ["docid", "title", "text"] and tx.QUERY_PREFIX == "query: "


def test_csv_of_one_file_is_read_by_many_tasks(spark):
    rng = random.Random(8)
    fields = ["plain", 'a "quoted" word', "two\nlines", "\n\nmany\n\n", 'ends with "', '"', "", "comma, inside", "\n", 'x"\n"y']
    rows = [(str(i), rng.choice(fields), rng.choice(fields)) for i in range(600)]
    path = fresh_path(spark, "table").removeprefix("file:") + ".csv"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as file:
        csv.writer(file, lineterminator="\n").writerows([("id", "text", "odd `name`"), *rows])
    want = sorted((i, a or None, b or None) for i, a, b in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", "64k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = readers.read_text_source(spark, path)
            assert found.columns == ["id", "text", "odd `name`"]
            assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
            plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
            assert sorted(map(str, plain.collect())) == sorted(map(str, found.collect()))
            if size == "700":
                assert spark.read.text(path).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_of_several_files_and_of_none(spark):
    base = fresh_path(spark, "parts")
    rows = [(str(i), f"line {i}\nnext \"{i}\"") for i in range(50)]
    spark.createDataFrame(rows, "id string, text string").repartition(4).write.csv(base, header=True, escape='"')
    assert sorted(map(tuple, readers.read_csv(spark, base).collect())) == sorted(rows)
    empty = fresh_path(spark, "empty")
    spark.createDataFrame([], "id string").write.text(empty)
    assert readers.read_csv(spark, empty).count() == 0


@pytest.mark.parametrize("rows, n", [(103, 10), (7, 3), (4, 9), (0, 3)])
def test_json_splits_are_exact(spark, rows, n):
    path = fresh_path(spark, "splits")
    frame = spark.createDataFrame([(f"{i:05d}", i) for i in range(rows)], "id string, v long").repartition(5)
    writers.write_json_splits(frame, path, n, "id")
    files = sorted(p for p in Path(path.removeprefix("file:")).glob("*.json"))
    held = [[json.loads(line)["id"] for line in p.read_text().splitlines()] for p in files]
    held = [h for h in held if h]
    assert len(held) == min(n, rows) and sum(held, []) == [f"{i:05d}" for i in range(rows)]
    assert not held or max(map(len, held)) - min(map(len, held)) <= 1


def test_datasets_by_address(spark):
    root = fresh_path(spark, "datasets")
    row = lambda i: spark.createDataFrame([(i, "ask", [], [], [])], readers.JUDGED)
    row("1").write.json(f"{root}/own/set/german/dev.jsonl")
    row("2").write.json(f"{root}/plain/train")
    row("3").write.json(f"{root}/plain/default/test.json")
    row("4").write.json(f"{root}/train.jsonl")
    ids = lambda name: [r["query_id"] for r in readers.read_dataset(spark, root, name).collect()]
    assert ids("own/set:german/dev") == ["1"] and ids("plain") == ["2"] and ids(None) == ["4"]
    with pytest.raises(FileNotFoundError, match="no train split of plain .french."):
        readers.read_dataset(spark, root, "plain:french")
