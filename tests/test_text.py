import pytest
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import plugins, text_rows

PASSAGES = "query_id string, query string, positive_passages array<struct<docid:string,title:string,text:string>>, negative_passages array<struct<docid:string,title:string,text:string>>"


def one(spark, expression, row, schema):
    return spark.createDataFrame([row], schema).select(expression.alias("x")).first()["x"]


def test_passage_text_with_and_without_title(spark):
    text = lambda title: one(spark, tx.passage_text(F.col("t"), F.col("b"), " | ", "P: ", True), (title, "Body"), "t string, b string")
    assert text("Head") == "P: head | body"
    assert text("") == "P:  | body"
    assert text(None) == "P: body"


def test_truncate_keeps_a_slot_for_the_end(spark):
    cut = lambda n, eos=None: one(spark, tx.truncate(F.split("t", " "), n, eos), ("a b c d",), "t string")
    assert cut(2) == ["a", "b"]
    assert cut(2, "E") == ["a", "E"]
    assert cut(9, "E") == ["a", "b", "c", "d", "E"]
    assert cut(None) == ["a", "b", "c", "d"]
    assert cut(1, "E") == ["E"]


@pytest.mark.parametrize("name, prefix", [("quora", "query: "), ("cqadupstack-gis", "query: "), ("nq", "passage: "), ("quora2", "passage: ")])
def test_prefix_by_corpus(spark, name, prefix):
    assert one(spark, tx.corpus_prefix(F.col("n")), (name,), "n string") == prefix


@pytest.mark.parametrize("given, wanted", [("", ""), ("Do it:", "Do it:"), ("Do it.", "Do it:"), ("..Do. it..", "Do. it:"), ("Do", "Do:")])
def test_normalise_instruction(spark, given, wanted):
    assert one(spark, tx.normalise_instruction(F.col("i")), (given,), "i string") == wanted


def test_with_instruction(spark):
    made = lambda i: one(spark, tx.with_instruction(F.col("i"), F.col("t")), (i, "text"), "i string, t string")
    assert made(" Find ") == "Find !@#$%^&*()text"
    assert made("") == made(None) == "!@#$%^&*()text"


def test_chat_text(spark):
    made = lambda f, eos: one(spark, tx.chat_text(F.col("f"), F.col("t"), eos), (f, " hi "), "f string, t string")
    assert made("mistral-instruct", False) == "[INST] hi [/INST]"
    assert made("mistral-instruct", True) == "[INST] hi [/INST] </s>"
    assert made("llama3-instruct", True) == "<|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|>"
    assert made("llama3", True) == "hi<|end_of_text|>"
    assert made("other", True) == made("other", False) == " hi "


def test_has_answer_needs_whole_tokens(spark):
    found = lambda text, answers, regex=False: one(
        spark, tx.has_answer(F.col("t"), F.col("a"), regex), (text, answers), "t string, a array<string>"
    )
    assert found("The Cat sat.", ["cat SAT"])
    assert not found("concatenate", ["cat"])
    assert not found("cat", ["", "  "])
    assert not found("cat", [])
    assert found("a, b", ["a, b"]) and not found("a b", ["a, b"])
    assert found("born 1984", [r"\d{4}"], True) and not found("born", [r"\d{4}"], True)


def spans(spark, tags):
    return [tuple(s) for s in one(spark, tx.bio_spans(F.col("t")), (tags,), "t array<string>")]


def test_bio_spans(spark):
    assert spans(spark, []) == []
    assert spans(spark, ["O", "O"]) == []
    assert spans(spark, ["B-x", "I-x", "O", "B-x"]) == [(1, 2, "x"), (4, 4, "x")]
    assert spans(spark, ["I-x", "I-y", "I-y"]) == [(1, 1, "x"), (2, 3, "y")]
    assert spans(spark, ["B-x", "B-x", "I-x"]) == [(1, 1, "x"), (2, 3, "x")]
    assert spans(spark, ["O", "I-a-b", "I-a-b"]) == [(2, 3, "a-b")]


def judged(spark, negatives):
    return spark.createDataFrame(
        [("1", "Who Is", [("a", "Head", "one two"), ("b", None, "three")], negatives)], PASSAGES
    )


def test_train_and_contrastive_rows(spark):
    row = text_rows.train_rows(judged(spark, [("c", "", "four")]), lowercase=True).first()
    assert row["query"] == ["query", "who", "is"]
    assert row["positives"] == [["passage", "head", "one", "two"], ["passage", "three"]]
    assert row["negatives"] == [["passage", "four"]]
    for rows in (judged(spark, None), judged(spark, []), judged(spark, []).drop("negative_passages")):
        row = text_rows.contrastive_rows(rows).first()
        assert row["query"] == ["Who", "Is"] and row["negatives"] == []


def test_margin_rows_and_query_rows(spark):
    row = text_rows.margin_train_rows(judged(spark, []), q_max=5, p_max=6).first()
    assert row["query"] == ["query", "Who"] and row["positives"][0] == ["passage", "Head", "one"]


def test_plugin_tokenizer_equals_builtin(spark):
    split = plugins.tokenizer(lambda texts: [t.split(" ") for t in texts])
    row = text_rows.train_rows(judged(spark, []), tokenizer=split).first()
    assert row["query"] == ["query:", "Who", "Is"] and row["positives"][1] == ["passage:", "three"]


def test_line_rows(spark):
    lines = spark.createDataFrame([("7\thead\tbody text",), ("8\tonly",), ("9",)], "value string")
    assert {r["text_id"]: r["text"] for r in text_rows.line_rows(lines).collect()} == {"7": ["head", "body", "text"], "8": ["only"], "9": []}


def test_pair_tokens_cuts_the_query_only(spark):
    rows = spark.createDataFrame([(["q1", "q2", "q3"], ["p1", "p2"])], "query array<string>, text array<string>")
    pair = lambda n: text_rows.pair_tokens(rows, n).first()["pair"]
    assert pair(9) == ["q1", "q2", "q3", "p1", "p2"]
    assert pair(4) == ["q1", "q2", "p1", "p2"]
    assert pair(1) == ["p1", "p2"]


def test_cap_words(spark):
    rows = spark.createDataFrame([(1, "a b  c\nd e"), (2, " a b "), (3, "")], "i int, text string")
    capped = {r["i"]: r["text"] for r in text_rows.cap_words(rows, 3).collect()}
    assert capped == {1: "a b c", 2: " a b ", 3: ""}
    doubled = {r["i"]: r["text"] for r in text_rows.cap_words(rows, 4, count_tokens=lambda xs: [2 * len(x.split()) for x in xs]).collect()}
    assert doubled == {1: "a b", 2: " a b ", 3: ""}


def test_split_and_take(spark):
    rows = spark.range(25).select((F.col("id") * 3).alias("k"))
    for range_rows in (4, 1000):
        split = text_rows.split_by_percent(rows, ["k"], 10, range_rows)
        assert sorted(r["k"] for r in split.where("split = 'validation'").collect()) == [0, 3]
    assert [r["k"] for r in text_rows.take_first(rows, ["k"], 3).collect()] == [0, 3, 6]
    assert text_rows.take_first(rows, ["k"], 99).count() == 25


def test_longest_first(spark):
    rows = spark.createDataFrame([("a", None, "xx"), ("b", "t", "xxxx"), ("c", None, "yy")], "docid string, title string, text string")
    assert [r["docid"] for r in text_rows.longest_first(rows).collect()] == ["b", "a", "c"]
    assert text_rows.longest_first(rows, within_tasks=True).count() == 3


def test_align_labels(spark):
    rows = spark.createDataFrame([([None, 0, 0, 1, 2, 2, None], [5, 6, 7])], "w array<int>, l array<int>")
    label = lambda mode: rows.select(text_rows.align_labels(F.col("w"), F.col("l"), mode).alias("x")).first()["x"]
    assert label("same_token") == [-100, 5, -100, 6, 7, -100, -100]
    assert label("next_token") == [5, -100, 6, 7, -100, -100, -100]
    assert rows.select(text_rows.shift_word_ids(F.col("w")).alias("x")).first()["x"] == [0, 0, 1, 2, 2, -1, -1]
    with pytest.raises(ValueError):
        label("other")


def test_instruct_without_instruction(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "task string, text string")
    told = text_rows.instruct(docs, spark.createDataFrame([("a", "Do:")], "task string, instruction string"))
    assert sorted(r["instructed"] for r in told.collect()) == ["!@#$%^&*()y", "Do: !@#$%^&*()x"]


def test_take_first_of_many_rows(spark, monkeypatch):
    rows = spark.range(0, 30_000, 1, 7).withColumn("k", F.expr("id * 7919 % 30011"))
    want = sorted(range(30_000), key=lambda i: i * 7919 % 30011)[:12_000]
    assert sorted(r["id"] for r in text_rows.take_first(rows, ["k"], 12_000).collect()) == sorted(want)
    assert text_rows.take_first(rows, ["k"], 12_000).columns == rows.columns
    assert text_rows.take_first(rows, ["k"], 40_000).count() == 30_000
