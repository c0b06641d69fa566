import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.operators import evaluation, metrics


@pytest.fixture(scope="module")
def judged(spark):
    run = spark.createDataFrame(
        [("1", "a", 1), ("1", "b", 2), ("1", "c", 3), ("2", "x", 1), ("3", "n", 1), ("5", "z", 1)], "qid string, docid string, rank int"
    )
    qrels = spark.createDataFrame(
        [("1", "b", 3), ("1", "c", 1), ("1", "q", 2), ("1", "a", 0), ("2", "y", 1), ("3", "n", 0), ("4", "m", 1)], "qid string, docid string, rel int"
    )
    return run, qrels


def test_query_metrics(judged):
    out = {r["qid"]: r for r in metrics.query_metrics(*judged, ks=(2, 10)).collect()}
    assert set(out) == {"1", "2", "4"}
    dcg2, ideal2 = 3 / math.log2(3), 3 + 2 / math.log2(3)
    assert out["1"]["ndcg_at_2"] == pytest.approx(dcg2 / ideal2)
    assert out["1"]["ndcg_at_10"] == pytest.approx((dcg2 + 1 / 2) / (ideal2 + 1 / 2))
    assert out["1"]["map_at_10"] == pytest.approx((1 / 2 + 2 / 3) / 3) and out["1"]["map_at_2"] == pytest.approx(1 / 6)
    assert out["1"]["recall_at_10"] == pytest.approx(2 / 3) and out["1"]["precision_at_10"] == pytest.approx(0.2)
    assert out["1"]["mrr_at_10"] == 0.5
    assert all(v == 0 for k, v in out["2"].asDict().items() if k != "qid")
    assert all(v == 0 for k, v in out["4"].asDict().items() if k != "qid")


def test_means_and_evaluated_only(judged):
    whole, seen = metrics.evaluate(*judged, ks=(10,)).first(), metrics.evaluate(*judged, ks=(10,), evaluated_only=True).first()
    assert (whole["queries"], whole["mrr_at_10"]) == (3, pytest.approx(0.5 / 3)) and (seen["queries"], seen["mrr_at_10"]) == (2, 0.25)


def test_ideal_run_scores_one(judged):
    _, qrels = judged
    from pyspark.sql import Window

    ideal = qrels.where("rel > 0").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "docid")))
    row = metrics.evaluate(ideal, qrels, ks=(5,)).first()
    assert row["ndcg_at_5"] == row["map_at_5"] == row["recall_at_5"] == row["mrr_at_5"] == 1.0


def test_metric_table_has_a_mean_row(judged):
    run, qrels = (df.withColumn("dataset", F.when(F.col("qid") == "1", F.lit("a")).otherwise(F.lit("b"))) for df in judged)
    rows = {r["dataset"]: r["mrr_at_10"] for r in metrics.evaluate_datasets(run, qrels, (10,)).collect()}
    assert rows == {"a": 0.5, "b": 0.0, "mean": 0.25}


def test_answer_accuracy(spark):
    run = spark.createDataFrame([("1", "a", 1), ("1", "b", 7), ("2", "a", 1)], "qid string, docid string, rank int")
    corpus = spark.createDataFrame([("a", "nope"), ("b", "Yes it is")], "docid string, text string")
    answers = spark.createDataFrame([("1", ["yes"]), ("2", ["yes"]), ("3", ["yes"])], "qid string, answers array<string>")
    row = metrics.answer_accuracy(run, corpus, answers).first()
    assert row["accuracy_at_5"] == 0 and row["accuracy_at_20"] == pytest.approx(1 / 3)


def test_spearman_with_ties(spark):
    rows = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (2.0, 2.0), (5.0, 9.0), (4.0, 9.0)], "a double, b double")
    ranks_a, ranks_b = [1, 2.5, 2.5, 5, 4], [3, 1, 2, 4.5, 4.5]
    mean = lambda x: sum(x) / len(x)
    cov = sum((a - 3) * (b - 3) for a, b in zip(ranks_a, ranks_b))
    wanted = cov / math.sqrt(sum((a - mean(ranks_a)) ** 2 for a in ranks_a) * sum((b - mean(ranks_b)) ** 2 for b in ranks_b))
    for range_rows in (2, 1000):
        assert evaluation.spearman(rows, "a", "b", range_rows).first()["spearman"] == pytest.approx(wanted)


def test_pair_cosine(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r["cosine"] for r in evaluation.pair_cosine(rows, "a", "b").collect()] == [pytest.approx(0.96), 0.0]


def test_classification(spark):
    rows = [([x / 10.0, 1.0], int(x > 0)) for x in range(-20, 20)]
    df = spark.createDataFrame(rows, "embedding array<float>, label int")
    report = evaluation.classification_report(evaluation.classify(df, df)).first()
    assert report["accuracy"] == 1.0 and report["macro_f1"] == 1.0
    given = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    row = evaluation.classification_report(given).first()
    assert row["accuracy"] == 0.5 and row["macro_f1"] == pytest.approx((2 / 3 + 0.5 + 0) / 3) and row["classes"] == 3


def test_clustering_and_v_measure(spark):
    rows = [([float(c * 10 + i % 3), float(c)], c) for c in range(3) for i in range(9)]
    df = spark.createDataFrame(rows, "embedding array<float>, label int")
    found = evaluation.cluster(df).withColumn("cluster_set", F.lit("s"))
    assert evaluation.v_measures(found).first()["v_measure"] == pytest.approx(1.0)
    given = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("b", 0, 0), ("b", 0, 1), ("c", 0, 0), ("c", 0, 0)], "cluster_set string, label int, cluster int")
    out = {r["cluster_set"]: (r["homogeneity"], r["completeness"], r["v_measure"]) for r in evaluation.v_measures(given).collect()}
    assert out == {"a": (0.0, 1.0, 0.0), "b": (1.0, 0.0, 0.0), "c": (1.0, 1.0, 1.0)}
    summary = evaluation.v_measure_summary(evaluation.v_measures(given)).first()
    assert summary["v_mean"] == pytest.approx(1 / 3) and summary["v_std"] == pytest.approx(math.sqrt(2) / 3)


def test_token_metrics(spark):
    rows = spark.createDataFrame([([1, 2, 3], [9, 1, -100]), ([5, 5], [5, 4])], "predictions array<int>, labels array<int>")
    shifted = evaluation.shifted_accuracy(rows).first()
    assert (shifted["accuracy"], shifted["places"]) == (0.5, 2)
    tags = evaluation.tag_precision(rows).first()
    assert (tags["precision"], tags["places"]) == (0.25, 4)


def test_entity_report(spark):
    rows = spark.createDataFrame(
        [(["B-x", "I-x", "O"], ["B-x", "I-x", "B-y"]), (["B-x", "O"], ["B-x", "I-x"])], "predicted array<string>, actual array<string>"
    )
    row = evaluation.entity_report(rows).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.5, pytest.approx(1 / 3), pytest.approx(0.4), 0.6)


def test_vector_pooling_with_instruction(spark):
    rows = spark.createDataFrame([("a", i, [float(i), 1.0], 2) for i in range(5)], "id string, pos int, vec array<float>, skip int")
    at = lambda how, skip=None: list(evaluation.pool_vectors(rows, how, skip).first()["embedding"])
    assert at("mean") == [2.0, 1.0] and at("mean", "skip") == [3.0, 1.0]
    assert at("weighted_mean", "skip")[0] == pytest.approx((2 * 1 + 3 * 2 + 4 * 3) / 6)
    assert at("last") == [4.0, 1.0] and at("bos") == [0.0, 1.0] and at("first", "skip") == [2.0, 1.0]
    with pytest.raises(ValueError):
        at("max")


def test_size_report(spark):
    rows = spark.createDataFrame([("a", "xy", 1), ("a", "z", 1), ("b", "é", 1)], "id string, term string, weight int")
    row = evaluation.size_report(rows).first()
    assert (row["rows"], row["terms_per_row"], row["max_terms"], row["total_bytes"]) == (2, 1.5, 2, 3 * 4 + 5)


def test_minibatch_centers(spark):
    rng = np.random.default_rng(12)
    middles = rng.normal(size=(5, 6)) * 10
    points = middles[np.arange(2000) % 5] + rng.normal(size=(2000, 6))
    rows = [(str(i), p.tolist()) for i, p in enumerate(points)] + [("null", None)]
    frame = lambda parts: spark.createDataFrame(rows, "id string, embedding array<double>").repartition(parts)
    found = evaluation.minibatch_centers(frame(3), 5, batch_rows=300)
    assert (found == evaluation.minibatch_centers(frame(7), 5, batch_rows=300)).all()
    apart = np.linalg.norm(found[:, None] - middles[None], axis=2)
    assert (apart.min(axis=0) < 0.3).all() and sorted(apart.argmin(axis=1)) == list(range(5))
    near = evaluation.assigned(frame(2).where("embedding is not null"), found).collect()
    distance = ((points[:, None] - found[None]) ** 2).sum(axis=2)
    assert all(r["cluster"] == distance[int(r["id"])].argmin() and abs(r["cost"] - distance[int(r["id"])].min()) < 1e-9 for r in near)
    assert len(evaluation.minibatch_centers(frame(2).limit(0), 3)) == 0
    few = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], "id string, embedding array<double>")
    assert evaluation.minibatch_centers(few, 5).tolist() == [[1.0, 2.0]] * 2


def test_size_sketches_merge_to_the_whole(spark):
    rng = np.random.default_rng(4)
    rows = [(str(i), f"t{j}", i % 3) for i in range(600) for j in range(int(rng.integers(1, 60)))]
    postings = spark.createDataFrame(rows, "id string, term string, part int")
    sizes = sorted(len(v) for v in by_id(rows).values())
    sizes_bytes = sorted(sum(4 + len(t) for t in v) for v in by_id(rows).values())
    merged = evaluation.merged_sizes(evaluation.size_sketches(postings, ["part"]))
    row = evaluation.size_quantiles(merged, 10_000).first()
    at = lambda values, p: values[int(np.ceil(p * len(values))) - 1]
    for p in (50, 90, 99):
        assert row[f"terms_p{p}"] == at(sizes, p / 100) and row[f"bytes_p{p}"] == at(sizes_bytes, p / 100)
    assert row["projected_bytes"] == int(np.ceil(sum(sizes_bytes) / 600 * 10_000)) and row["projected_high_bytes"] == at(sizes_bytes, 0.99) * 10_000
    # Small sketches stay within their stated error of rank.
    coarse = evaluation.size_quantiles(evaluation.merged_sizes(evaluation.size_sketches(postings, ["part"], k=64), 64)).first()
    rank = np.searchsorted(sizes, coarse["terms_p50"], side="right") / 600
    assert abs(rank - 0.5) < 2.3 / 64**0.9 + 0.03
    assert evaluation.size_quantiles(evaluation.merged_sizes(evaluation.size_sketches(postings.limit(0)))).count() == 0


def by_id(rows):
    out = {}
    for i, term, _ in rows:
        out.setdefault(i, []).append(term)
    return out


def test_expected_classes_at_the_optimum(spark):
    rng = np.random.default_rng(9)
    rows = [(rng.normal(size=3).tolist(), int(rng.integers(0, 3))) for _ in range(200)]
    frame = spark.createDataFrame(rows, "embedding array<double>, label int")
    found = {r["label"]: r["expected"] for r in evaluation.expected_classes(frame).collect()}
    assert all(abs(found[c] - sum(label == c for _, label in rows)) < 0.05 for c in range(3))
