import pytest
from pyspark.sql import functions as F

from quillrank.operators import trainset


def test_pair_rows(spark):
    pairs = spark.createDataFrame([(3, "quora", "a", "b"), (1, "nq", "c", "d"), (2, "quora", "e", "f")], "k int, split string, query string, document string")
    rows = {r["query"]: r for r in trainset.pair_rows(pairs, ["k"]).collect()}
    assert rows["query: e"]["query_id"] == "quora_0" and rows["query: a"]["query_id"] == "quora_1"
    assert rows["query: a"]["positive_passages"][0]["text"] == "query: b"
    assert rows["query: c"]["positive_passages"][0].asDict() == {"docid": "nq_0_pos", "title": None, "text": "passage: d"}
    assert rows["query: c"]["negative_passages"] == []
    assert sorted(r["query_id"] for r in trainset.pair_rows(pairs, ["k"], compat_ids=True).collect()) == ["split_0", "split_0", "split_1"]


def pick(spark, items, item=0, **options):
    row = spark.createDataFrame([(items, item)], "n array<string>, i long")
    return row.select(trainset.negatives_for_epoch(F.col("n"), F.col("i"), **options).alias("x")).first()["x"]


def test_positive_for_epoch(spark):
    row = spark.createDataFrame([(["a", "b", "c"], 4)], "p array<string>, i long")
    at = lambda epoch, shuffle=True: row.select(trainset.positive_for_epoch(F.col("p"), F.col("i"), 7, epoch, shuffle).alias("x")).first()["x"]
    assert [at(e) for e in range(4)] == ["c", "a", "b", "c"] and at(2, False) == "a"


def test_negatives_for_epoch(spark):
    five = ["a", "b", "c", "d", "e"]
    assert pick(spark, five, n_passages=1, seed=0, epoch=0) == []
    assert pick(spark, [], n_passages=3, seed=0, epoch=0) == []
    assert pick(spark, five, n_passages=3, seed=0, epoch=9, shuffle=False) == ["a", "b"]
    turned = [pick(spark, five, n_passages=3, seed=0, epoch=e, order_shuffle=False) for e in range(3)]
    assert turned == [["a", "b"], ["c", "d"], ["e", "a"]]
    short = pick(spark, ["a", "b"], n_passages=6, seed=0, epoch=0)
    assert len(short) == 5 and set(short) <= {"a", "b"}
    seen = sum((pick(spark, five, item=3, n_passages=2, seed=1, epoch=e) for e in range(5)), [])
    assert sorted(seen) == five


def test_scored_negatives_keep_their_pairs(spark):
    row = spark.createDataFrame([([("a", 1.0), ("b", 2.0)], 5)], "n array<struct<d:string,s:double>>, i long")
    for n in (2, 3, 9):
        drawn = row.select(trainset.negatives_for_epoch(F.col("n"), F.col("i"), n, 3, 1).alias("x")).first()["x"]
        assert len(drawn) == n - 1 and all((x["d"], x["s"]) in {("a", 1.0), ("b", 2.0)} for x in drawn)


def test_sample_group(spark):
    rows = spark.createDataFrame([("1", ["p", "q"], list("abcde"))], "query_id string, positives array<string>, negatives array<string>")
    draw = lambda n: trainset.sample_group(rows, "query_id", n, 3).first()
    assert draw(4)["positive"] in ("p", "q") and len(set(draw(4)["negatives"])) == 3 and draw(1)["negatives"] == []


def test_soft_targets_sum_to_one(spark):
    rows = spark.createDataFrame([("1", "a", 1e4), ("1", "b", 1e4 - 2), ("2", "a", -5.0)], "qid string, docid string, score double")
    out = {(r["qid"], r["docid"]): r["target"] for r in trainset.soft_targets(rows, 2.0).collect()}
    assert out[("1", "a")] == pytest.approx(1 / (1 + 2.718281828 ** -1)) and out[("1", "a")] + out[("1", "b")] == pytest.approx(1)
    assert out[("2", "a")] == 1.0


def test_task_triplets_alternate_prompts(spark):
    rows = spark.createDataFrame([(i, "allnli", "q", "p", "n") for i in range(3)] + [(9, "nq", "q", "p", "n")], "k int, task_name string, query string, positive string, negative string")
    out = trainset.task_triplets(rows, trainset.prompt_table(spark), ["k"]).orderBy("k").collect()
    prompts = trainset.TASK_PROMPTS["allnli"]
    assert [r["query"].split("; ")[0] for r in out[:3]] == [prompts[0], prompts[1], prompts[0]]
    assert out[3]["positive"] == "!@#$%^&*()p" and out[0]["query"].endswith("; !@#$%^&*()q")


@pytest.mark.parametrize("range_rows", [5, 1000])
def test_task_batches_hold_one_task_and_are_full(spark, range_rows):
    rows = spark.range(47).select(F.when(F.col("id") < 20, F.lit("a")).otherwise(F.lit("b")).alias("task_name"), F.col("id").alias("sample"))
    draw = lambda n: [tuple(r) for r in trainset.task_batches(rows.repartition(n), "sample", 6, 3, range_rows=range_rows).select("turn", "place", "task_name", "sample").collect()]
    out = sorted(draw(4))
    assert len(out) == 18 + 24 and len({r[3] for r in out}) == 42
    for i in range(0, len(out), 6):
        assert len({r[2] for r in out[i : i + 6]}) == 1 and [r[1] for r in out[i : i + 6]] == list(range(6))
    assert out == sorted(draw(1))


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_pack_tokens(spark, range_rows):
    sizes = [3, 0, 11, 1, 7, 2, 5, 4]
    rows, n = [], 0
    for i, size in enumerate(sizes):
        rows.append((i, list(range(n, n + size))))
        n += size
    df = spark.createDataFrame(rows, "k int, tokens array<int>").repartition(3)
    out = trainset.pack_tokens(df, ["k"], 4, group_rows=5, range_rows=range_rows).orderBy("batch", "chunk").collect()
    first, second = list(range(22)), list(range(22, 33))
    wanted = [first[i : i + 4] for i in range(0, 20, 4)] + [second[i : i + 4] for i in range(0, 8, 4)]
    assert [r["tokens"] for r in out] == wanted


def test_pack_tokens_moves_rows_once(spark, capsys):
    df = spark.range(10).select(F.col("id"), F.array("id").alias("tokens"))
    trainset.pack_tokens(df, ["id"], 2, range_rows=4).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(batch") == 1


def test_line_by_line(spark):
    rows = spark.createDataFrame([(1, " a b c "), (2, "  \t"), (3, ""), (4, None), (5, "d")], "k int, text string")
    assert sorted((r["k"], r["tokens"]) for r in trainset.line_by_line(rows, 2).collect()) == [(1, ["a", "b"]), (5, ["d"])]


def test_mask_tokens(spark):
    rows = spark.createDataFrame([(i, [1, 2] + list(range(10, 60))) for i in range(40)], "k int, tokens array<int>")
    draw = lambda p, n=1: trainset.mask_tokens(rows.repartition(n), "k", p, 99, (1, 2), 5).orderBy("k").collect()
    for r in draw(0.5):
        for t, i, l in zip(r["tokens"], r["input_ids"], r["labels"]):
            assert (i, l) in ((99, t), (t, -100)) and not (t in (1, 2) and i == 99)
    share = sum(x == 99 for r in draw(0.5) for x in r["input_ids"]) / 2000
    assert 0.45 < share < 0.55
    assert draw(0.5) == draw(0.5, 8)
    assert all(x != 99 for r in draw(0.0) for x in r["input_ids"])
