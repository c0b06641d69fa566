import random

import pytest
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import mining, text_rows, trainset

RUN = "qid string, docid string, score double"
TRAIN = (
    "query_id string, query string, answers array<string>, positive_passages array<struct<docid:string,title:string,text:string>>, "
    "negative_passages array<struct<docid:string,title:string,text:string>>"
)


@pytest.fixture(scope="module")
def data(spark):
    corpus = spark.createDataFrame([(f"d{i}", "T" if i % 2 else None, f"text {i} here") for i in range(8)], "docid string, title string, text string")
    run = spark.createDataFrame([("1", f"d{i}", 10.0 - i) for i in range(6)] + [("2", "d7", 1.0), ("2", "d6", 1.0)], RUN)
    old = [("old", None, "old")]
    train = spark.createDataFrame(
        [("1", "ask", ["4 HERE", "nothing"], [("d0", None, "x"), ("d2", None, "x")], old), ("2", "ask", ["text 7"], [], []), ("3", "ask", [], [("d1", "T", "x")], old)],
        TRAIN,
    )
    qrels = spark.createDataFrame([("1", "d0", 1), ("1", "d2", 1), ("1", "d3", 0)], "qid string, docid string, rel int")
    return corpus, run, train, qrels


def ids(df, column):
    return {r["query_id"]: [p["docid"] for p in r[column]] for r in df.collect()}


def test_basic_negatives_cut_before_positives_go(data):
    corpus, run, train, _ = data
    mined = mining.basic_negatives(train, run, corpus, 3)
    assert ids(mined, "negative_passages") == {"1": ["d1"], "2": ["d6", "d7"], "3": []}
    assert ids(mined, "positive_passages")["1"] == ["d0", "d2"]
    first = {r["query_id"]: r["negative_passages"] for r in mined.collect()}["1"][0]
    assert (first["title"], first["text"]) == ("T", "text 1 here")


def test_ranked_negatives_cut_after_positives_go(data):
    _, run, _, qrels = data
    rows = mining.ranked_negatives(run, qrels, 3, 30, shuffle=False).where("qid = '1'").orderBy("place").collect()
    assert [r["docid"] for r in rows] == ["d1", "d3", "d4"]


def test_ranked_negatives_are_the_same_at_any_partitioning(data):
    _, run, _, qrels = data
    draw = lambda n, seed: sorted(map(tuple, mining.ranked_negatives(run.repartition(n), qrels, 4, 2, seed).collect()))
    assert draw(1, 5) == draw(8, 5) and len(draw(1, 5)) == 4
    assert any(draw(1, 5) != draw(1, s) for s in range(6, 12))


def test_answer_negatives_replace_the_positives(data):
    corpus, run, train, _ = data
    mined = mining.answer_negatives(train, run, corpus, 6)
    assert ids(mined, "positive_passages") == {"1": ["d4"], "2": ["d7"], "3": []}
    assert ids(mined, "negative_passages") == {"1": ["d0", "d1", "d2", "d3", "d5"], "2": ["d6"], "3": []}
    matched = mining.answer_negatives(train.withColumn("answers", F.array(F.lit(r"\b[35]\b"))), run, corpus, 6, regex=True)
    assert ids(matched, "positive_passages")["1"] == ["d3", "d5"]


def test_original_and_mined_rows_both_stay(data):
    corpus, run, train, _ = data
    mined = mining.basic_negatives(train, run, corpus, 6)
    both = mining.with_mined(train, mined, 1)
    assert sorted(r["query_id"] for r in both.collect()) == ["1", "1", "3"]
    assert [r["query_id"] for r in mining.with_mined(train, mined, 2, mined_only=True).collect()] == ["1"]


def test_sampled_negatives(spark):
    lists = spark.createDataFrame([("1", "a,b,c,d"), ("2", "a")], "qid string, negatives string")
    drawn = {r["qid"]: r["negatives"] for r in mining.sampled_negatives(lists, 3, 1).collect()}
    assert len(set(drawn["1"])) == 3 and set(drawn["1"]) < set("abcd") and drawn["2"] == ["a"]


@pytest.mark.parametrize("max_list", [100, 1])
def test_assemble_examples(spark, data, max_list):
    corpus, run, _, qrels = data
    queries = spark.createDataFrame([("1", "the ask"), ("2", "b")], "query_id string, query string")
    negatives = mining.ranked_negatives(run, qrels, 3, 2, shuffle=False)
    rows = mining.assemble_examples(negatives, qrels, queries, corpus, max_len=2, max_list=max_list).orderBy("part").collect()
    assert [r["qid"] for r in rows] == ["1"] * (1 if max_list == 100 else 2)
    assert sum((r["positives"] for r in rows), []) == [["SEP", "text"], ["SEP", "text"]]
    assert all(r["query"] == ["the", "ask"] and r["negatives"] == [["T", "SEP"], ["T", "SEP"]] for r in rows)


def test_judged_rows(spark, data):
    corpus, _, _, qrels = data
    queries = spark.createDataFrame([("1", "a"), ("2", "b")], "query_id string, query string")
    rows = mining.judged_rows(queries, qrels, corpus)
    assert ids(rows, "positive_passages") == {"1": ["d0", "d2"], "2": []} and ids(rows, "negative_passages") == {"1": [], "2": []}


def test_context_examples_drop_short_rows(spark):
    ctx = "array<struct<title:string,text:string>>"
    rows = spark.createDataFrame(
        [("q", [("T", "pos")], [("U", "neg")]), ("r", [], [("U", "neg")]), ("s", [("T", "pos")], [])],
        f"question string, positive_ctxs {ctx}, hard_negative_ctxs {ctx}",
    )
    out = mining.context_examples(rows, sep=" ").collect()
    assert [(r["query"], r["positives"], r["negatives"]) for r in out] == [(["q"], [["T", "pos"]], [["U", "neg"]])]


def test_answer_pairs_equal_brute_force(spark):
    docs = ["the red fox", "red", "a fox red the", "The Red Fox!", "redfox", ""]
    asked = [("a", ["red fox"]), ("b", ["RED", "zebra"]), ("c", ["!"]), ("d", [""]), ("e", [])]
    corpus = spark.createDataFrame([(str(i), t) for i, t in enumerate(docs)], "docid string, text string")
    answers = spark.createDataFrame(asked, "qid string, answers array<string>")
    got = sorted(map(tuple, mining.answer_pairs(corpus, answers).collect()))
    assert got == [("a", "0"), ("a", "3"), ("b", "0"), ("b", "1"), ("b", "2"), ("b", "3"), ("c", "3")]


def test_judged_rows_keep_their_part(spark, data):
    corpus, _, _, _ = data
    queries = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "query_id string, query string")
    qrels = spark.createDataFrame([("1", "d0", 1), ("1", "d1", 2), ("1", "d2", 1), ("1", "d0", 1), ("2", "d3", 1), ("2", "d0", 0)], "qid string, docid string, rel int")
    rows = mining.judged_rows(queries, qrels, corpus, max_list=2)
    found = {(r["query_id"], r["part"], r["parts"]): [p["docid"] for p in r["positive_passages"]] for r in rows.collect()}
    assert found == {("1", 0, 2): ["d0", "d1"], ("1", 1, 2): ["d2"], ("2", 0, 1): ["d3"], ("3", 0, 1): []}
    run = spark.createDataFrame([("1", f"d{i}", float(9 - i)) for i in range(4)], "qid string, docid string, score double")
    mined = mining.basic_negatives(rows, run, corpus)
    assert {(r["query_id"], r["part"]): [p["docid"] for p in r["negative_passages"]] for r in mined.collect()}[("1", 1)] == ["d3"]
    both = mining.with_mined(rows, mined, 1)
    assert sorted((r["query_id"], r["part"]) for r in both.collect()) == [("1", 0), ("1", 1)]
    for epoch in range(3):
        once = [(r["query_id"], r["part"]) for r in trainset.rows_for_epoch(mined, epoch).collect()]
        assert sorted(once) == [("1", epoch % 2), ("2", 0), ("3", 0)]
    tokens = text_rows.train_rows(mined)
    assert tokens.columns == ["query_id", "part", "parts", "query", "positives", "negatives"]


@pytest.mark.parametrize("part_chars", [10**6, 12])
def test_answers_in_parts_equal_the_plain_test(spark, part_chars):
    rng = random.Random(2)
    words = ["red", "fox", "a", "über", "x1", "!"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(str(i), text(rng.randrange(12))) for i in range(60)] + [("n", None)]
    asked = [(f"q{i}", [text(rng.randrange(1, 4)) for _ in range(rng.randrange(3))]) for i in range(25)] + [("same", ["red fox"]), ("again", ["Red  FOX"])]
    corpus = spark.createDataFrame(docs, "docid string, text string")
    answers = spark.createDataFrame(asked, "qid string, answers array<string>")
    tested = corpus.crossJoin(answers).where(tx.has_answer(F.col("text"), F.col("answers"))).select("qid", "docid")
    assert sorted(mining.answer_pairs(corpus, answers, part_chars).collect()) == sorted(tested.collect())
    run = spark.createDataFrame([(q, d, 1.0) for q, _ in asked for d, _ in docs[:9]], "qid string, docid string, score double")
    pairs = mining.pairs_in_run(run, corpus, answers).collect()
    assert sorted(pairs) == sorted(r for r in tested.collect() if r["docid"] in {d for d, _ in docs[:9]})
    none = answers.limit(0)
    assert mining.answer_pairs(corpus, none).count() == 0 and mining.pairs_in_run(run, corpus, none).count() == 0


def test_texts_are_not_shuffled_for_answers(spark, capsys):
    corpus = spark.createDataFrame([("1", "red fox")], "docid string, text string")
    answers = spark.createDataFrame([("q", ["fox"])], "qid string, answers array<string>")
    mining.answer_pairs(corpus, answers).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "text" in line]
