"""Cases that once lost rows or gave wrong ones."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillrank.operators import evaluation, metrics, mining, search, sparse
from quillrank.operators.placement import running_total
from quillrank.session import fresh_path
from quillrank.sources import readers
from quillrank.streaming import incremental


@pytest.mark.parametrize("several", [False, True])
def test_null_groups_are_numbered(spark, several, monkeypatch):
    from quillrank.operators import placement

    if several:
        monkeypatch.setattr(placement, "ONE_RANGE_ROWS", 0)
    rows = [(i, None if i % 4 == 0 else i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, g int")
    out = running_total(df, ["k"], group=["g"]).collect()
    assert len(out) == 40
    for g in (None, 0, 1):
        assert sorted(r["ordinal"] for r in out if r["g"] == g) == list(range(sum(x[1] == g for x in rows)))


def test_repeated_judgments_and_hits_count_once(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "a", 3)], "qid string, docid string, rank int")
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "a", 1), ("q", "a", 0)], "qid string, docid string, rel int")
    row = metrics.query_metrics(run, qrels, ks=(10,)).first()
    assert row["ndcg_at_10"] == row["map_at_10"] == row["recall_at_10"] == row["mrr_at_10"] == 1.0
    assert row["precision_at_10"] == 0.1


def test_indexes_with_like_names_stay_apart(spark):
    root = fresh_path(spark, "apart")
    rows = lambda n: spark.createDataFrame([(str(i), "t", 1) for i in range(n)], "id string, term string, weight int")
    long = "x" * 120
    for n, name in enumerate(("ix-1", "ix_1", "IX_1", f"a/{long}", f"b/{long}"), 1):
        search.write_index(rows(n), f"{root}/{name}", 2)
    for n, name in enumerate(("ix-1", "ix_1", "IX_1", f"a/{long}", f"b/{long}"), 1):
        assert search.open_index(spark, f"{root}/{name}").count() == n


def test_broken_rebuild_leaves_the_index(spark):
    path = fresh_path(spark, "index")
    rows = spark.createDataFrame([("a", "t", 1)], "id string, term string, weight int")
    search.write_index(rows, path, 2)
    broken = rows.withColumn("weight", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        search.write_index(broken, path, 2, rebuild=True)
    assert search.open_index(spark, path).collect() == rows.collect()


def test_query_without_negatives_is_written(spark):
    negatives = spark.createDataFrame([("q1", 0, "n")], "qid string, place int, docid string")
    qrels = spark.createDataFrame([("q1", "p", 1), ("q2", "p", 1)], "qid string, docid string, rel int")
    queries = spark.createDataFrame([("q1", "one"), ("q2", "two")], "query_id string, query string")
    corpus = spark.createDataFrame([("p", "t", "good"), ("n", "t", "bad")], "docid string, title string, text string")
    asked = spark.createDataFrame([("q1",), ("q2",)], "qid string")
    rows = {r["qid"]: r for r in mining.assemble_examples(negatives, qrels, queries, corpus, asked=asked).collect()}
    assert len(rows["q1"]["negatives"]) == 1 and rows["q2"]["negatives"] == [] and len(rows["q2"]["positives"]) == 1


def test_ignored_labels_do_not_count(spark):
    tags = "predicted array<string>, actual array<string>"
    full = spark.createDataFrame([(["B-X", "O", "I-X", "B-Y"], ["B-X", "-100", "I-X", "O"]), (["O"], ["-100"])], tags)
    bare = spark.createDataFrame([(["B-X", "I-X", "B-Y"], ["B-X", "I-X", "O"]), ([], [])], tags)
    assert evaluation.entity_report(full).first() == evaluation.entity_report(bare).first()


def test_document_that_arrives_again_counts_once(spark):
    out = fresh_path(spark, "stream")
    batch = lambda rows, n: spark.createDataFrame(rows, "id string, term string, weight int").write.parquet(f"{out}/batch_id={n}")
    batch([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], 0)
    batch([("a", "z", 5)], 10)
    assert sorted(map(tuple, incremental.read_encoded(spark, out).collect())) == [("a", "z", 5), ("b", "x", 3)]


def _lines(spark, values, name="lines"):
    path = f"{fresh_path(spark, 'damaged')}/{name}"
    spark.createDataFrame([(v,) for v in values], "value string").coalesce(1).write.text(path)
    return path


def test_tsv_lines_of_other_lengths_are_kept_apart(spark):
    path = _lines(spark, ["1\tt\tx", "2\tt\tsome\ttext after tab", "3\tx", "4\tt\t"])
    good, bad = readers.read_collection(spark, path, on_bad="split")
    assert sorted(map(tuple, good.collect())) == [("1", "t", "x"), ("4", "t", "")]
    assert sorted(r["line"] for r in bad.collect()) == ["2\tt\tsome\ttext after tab", "3\tx"]
    with pytest.raises(Exception, match="not 3 fields"):
        readers.read_collection(spark, path).count()


def test_bad_json_is_no_row(spark):
    path = _lines(spark, ['{"query_id": "1"}', "{broken", "[]", "null"], "rows.jsonl")
    good, bad = readers.read_training(spark, path, on_bad="split")
    assert [r["query_id"] for r in good.collect()] == ["1"] and bad.count() == 3
    with pytest.raises(Exception, match="not json"):
        readers.read_training(spark, path).collect()


def test_tokens_without_activation_count(spark):
    texts = spark.createDataFrame([("1", "a b c d"), ("2", None), ("3", "d a")], "id string, text string")

    def first_only(batch):
        rows = [(i, 0, t.split()[0], 4.0) for i, t in zip(batch["id"], batch["text"]) if t]
        return pd.DataFrame(rows, columns=["id", "pos", "term", "logit"])

    pooled = lambda how: {r["id"]: round(r["weight"], 6) for r in sparse.encode_pooled(texts, first_only, how).collect()}
    assert pooled("mean") == {"1": 0.693147, "3": 1.098612}
    assert pooled("max") == {"1": 1.609438, "3": 1.609438}
    assert pooled("last") == {}
    sizes = spark.createDataFrame([("1", 4), ("3", 2)], "id string, n_tokens int")
    assert sparse.pool(sparse.encode_batches(texts.na.fill(""), first_only), "last", sizes).count() == 0
