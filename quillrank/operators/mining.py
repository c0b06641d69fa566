"""Negatives from runs, and the judged rows built from them.

Lists in one row are bounded by the depth of the run or by `max_list`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.functions.seeded import seeded_key, seeded_shuffle
from quillrank.operators import answer_search
from quillrank.operators.placement import attach, fits_broadcast, spread_join, top_k
from quillrank.operators.rerank import MAX_LIST, grouped_lists
from quillrank.session import settled

PASSAGES = "array<struct<docid:string,title:string,text:string>>"


def _cut(run: DataFrame, depth: int) -> DataFrame:
    return top_k(run.select("qid", "docid", "score"), ["qid"], [F.desc("score"), F.asc("docid")], depth, spread="docid")


def _with_texts(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    return attach(ranked, corpus.select("docid", "title", "text"), "docid", ["qid"])


def _passages(condition: Column | None = None) -> Column:
    """Passages of a group in rank order."""
    entry = F.struct("rank", "docid", "title", "text")
    listed = F.collect_list(entry if condition is None else F.when(condition, entry))
    return F.transform(F.sort_array(listed), lambda p: F.struct(p["docid"].alias("docid"), p["title"].alias("title"), p["text"].alias("text")))


def _put(train: DataFrame, lists: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces list columns of the train rows; a query without a run gets empty lists."""
    joined = train.drop(*columns).join(lists.withColumnRenamed("qid", "query_id"), "query_id", "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(F.col(c), F.array().cast(PASSAGES)))
    return joined.select(*train.columns)


def judged_rows(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """Rows (query_id, query, part, parts, positive_passages, negative_passages), positives by docid, no negatives yet.

    Positives beyond `max_list` go on in a further part: (query_id, part) names a row, `parts` is how many the query has.
    Of a query with several, trainset.rows_for_epoch takes one per epoch.
    """
    parts = grouped_lists(qrels.where(F.col("rel") > 0).select("qid", "docid").distinct(), "qid", "docid", "docids", max_list)
    placed = parts.select("qid", "part", F.posexplode("docids").alias("rank", "docid"))
    told = _with_texts(placed, corpus)
    lists = told.groupBy("qid", "part").agg(_passages().alias("positive_passages"))
    counts = parts.groupBy("qid").agg(F.count(F.lit(1)).alias("parts"))
    lists = lists.join(counts, "qid").withColumnRenamed("qid", "query_id")
    joined = queries.join(lists, "query_id", "left")
    return joined.select(
        *queries.columns,
        F.coalesce("part", F.lit(0).cast("long")).alias("part"),
        F.coalesce("parts", F.lit(1).cast("long")).alias("parts"),
        F.coalesce("positive_passages", F.array().cast(PASSAGES)).alias("positive_passages"),
        F.array().cast(PASSAGES).alias("negative_passages"),
    )


def answer_pairs(corpus: DataFrame, answers: DataFrame, part_chars: int = answer_search.PART_CHARS) -> DataFrame:
    """All (qid, docid) whose passage holds an answer (qid, answers) as a token run."""
    one = answers.select("qid", F.explode("answers").alias("answer"))
    forms = one.select("qid", tx.answer_form(F.col("answer")).alias("form")).where(F.length("form") > 2).distinct()
    forms = settled(forms, "forms")
    texts = corpus.select("docid", tx.answer_form(F.col("text")).alias("form"))
    found = answer_search.holding(texts, forms.select("form").distinct(), part_chars)
    return spread_join(found, forms, "form", "inner", ["docid"]).select("qid", "docid").distinct()


def pairs_in_run(run: DataFrame, corpus: DataFrame, answers: DataFrame) -> DataFrame:
    """Of the run's (qid, docid), those whose passage holds an answer of the query."""
    pairs = run.select("qid", "docid").distinct()
    wanted = pairs.select("docid").distinct()
    named = corpus.select("docid", "text")
    named = named.join(F.broadcast(wanted), "docid", "left_semi") if fits_broadcast(wanted) else named.join(wanted, "docid", "left_semi")
    return answer_pairs(named, answers).join(pairs, ["qid", "docid"], "left_semi")


def basic_negatives(train: DataFrame, run: DataFrame, corpus: DataFrame, depth: int = 100) -> DataFrame:
    """The run cut to `depth`, then without known positives, becomes the negatives."""
    known = train.select(F.col("query_id").alias("qid"), F.explode("positive_passages.docid").alias("docid")).distinct()
    kept = _cut(run, depth).join(known, ["qid", "docid"], "left_anti")
    lists = _with_texts(kept, corpus).groupBy("qid").agg(_passages().alias("negative_passages"))
    return _put(train, lists, ["negative_passages"])


def answer_negatives(
    train: DataFrame, run: DataFrame, corpus: DataFrame, depth: int = 100, regex: bool = False
) -> DataFrame:
    """Of the first `depth` documents, those with an answer become the positives and the others the negatives."""
    answers = train.select(F.col("query_id").alias("qid"), "answers")
    cut = settled(_cut(run, depth), "cut")
    if regex:
        told = spread_join(_with_texts(cut, corpus), answers, "qid", "inner", ["docid"])
        judged = told.withColumn("hit", tx.has_answer(F.col("text"), F.col("answers"), True))
    else:
        # Each document is searched once for all answers, whatever the number of runs that it is in.
        asked = spread_join(cut, answers.select("qid").distinct(), "qid", "left_semi", ["docid"])
        hits = pairs_in_run(cut, corpus, answers).withColumn("hit", F.lit(True))
        marked = asked.join(hits, ["qid", "docid"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        judged = _with_texts(marked, corpus)
    lists = judged.groupBy("qid").agg(
        _passages(F.col("hit")).alias("positive_passages"), _passages(~F.col("hit")).alias("negative_passages")
    )
    return _put(train, lists, ["positive_passages", "negative_passages"])


def with_mined(original: DataFrame, mined: DataFrame, min_negatives: int = 1, mined_only: bool = False) -> DataFrame:
    """Original and mined rows together, each with a positive and enough negatives; a query can come twice."""
    rows = mined if mined_only else original.unionByName(mined)
    return rows.where((F.size("positive_passages") >= 1) & (F.size("negative_passages") >= min_negatives))


def ranked_negatives(
    run: DataFrame, qrels: DataFrame, depth: int = 200, n_sample: int = 30, seed: int = 0, shuffle: bool = True
) -> DataFrame:
    """The run without positives, cut to `depth`, then `n_sample` of it in seeded order: (qid, place, docid)."""
    known = qrels.where(F.col("rel") > 0).select("qid", "docid").distinct()
    cut = _cut(run.join(known, ["qid", "docid"], "left_anti"), depth)
    order = [seeded_key(seed, F.col("qid"), F.col("docid")), F.col("rank")] if shuffle else [F.col("rank")]
    return top_k(cut, ["qid"], [o.asc() for o in order], n_sample, "place").select("qid", "place", "docid")


def sampled_negatives(lists: DataFrame, n_sample: int = 30, seed: int = 0, negatives: str = "negatives") -> DataFrame:
    """`n_sample` of each given comma list, in seeded order."""
    items = F.split(F.col(negatives), ",", -1)
    return lists.withColumn(negatives, F.slice(seeded_shuffle(items, seed, F.col("qid")), 1, n_sample))


def assemble_examples(
    negatives: DataFrame,
    qrels: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    max_len: int = 128,
    sep: str = "[SEP]",
    tokenizer=tx.WORDS,
    max_list: int = MAX_LIST,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Token arrays of query, positives and negatives per query of `negatives` (qid, place, docid).

    `asked` (qid) names the queries where some have no negatives: those come out with an empty list.

    Positives beyond `max_list` go on in a further
    part, each with the same query and negatives.
    """
    asked = (negatives if asked is None else asked).select("qid").distinct()
    positives = spread_join(qrels.where(F.col("rel") > 0), asked, "qid", "left_semi").select("qid", "docid").distinct()
    parts = grouped_lists(positives, "qid", "docid", "docids", max_list)
    pos = parts.select("qid", "part", F.posexplode("docids").alias("place", "docid"), F.lit(True).alias("positive"))
    neg = negatives.select(
        "qid", F.lit(0).cast("long").alias("part"), F.col("place").cast("int").alias("place"), "docid", F.lit(False).alias("positive")
    )
    wanted = pos.unionByName(neg)
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(sep), "text")
    tokens = tx.truncate(tokenizer.one(body), max_len)
    told = attach(wanted, corpus.select("docid", "title", "text"), "docid", ["qid"]).withColumn("tokens", tokens)
    entry = F.struct("place", "tokens")
    listed = lambda flag: F.transform(F.sort_array(F.collect_list(F.when(F.col("positive") == flag, entry))), lambda e: e["tokens"])
    pos_lists = told.where("positive").groupBy("qid", "part").agg(listed(True).alias("positives"))
    neg_lists = told.where("not positive").groupBy("qid").agg(listed(False).alias("negatives"))
    both = pos_lists.join(neg_lists, "qid", "left")
    none = F.array().cast(neg_lists.schema["negatives"].dataType)
    both = both.withColumn("negatives", F.coalesce("negatives", none))
    asked_tokens = tx.truncate(tokenizer.one(F.col("query")), max_len)
    texts = queries.select(F.col("query_id").alias("qid"), asked_tokens.alias("query"))
    return spread_join(both, texts, "qid", "inner").select("qid", "part", "query", "positives", "negatives")


def context_examples(
    df: DataFrame, min_negatives: int = 1, max_len: int = 256, sep: str = "[SEP]", tokenizer=tx.WORDS
) -> DataFrame:
    """Rows (question, positive_ctxs, hard_negative_ctxs) to token arrays; short rows are dropped."""
    kept = df.where((F.size("hard_negative_ctxs") >= min_negatives) & (F.size("positive_ctxs") >= 1))
    text = lambda p: F.concat(F.coalesce(p["title"], F.lit("")), F.lit(sep), p["text"])
    lists = lambda c: F.transform(tokenizer.many(F.transform(c, text)), lambda t: tx.truncate(t, max_len))
    rest = [c for c in df.columns if c not in ("question", "positive_ctxs", "hard_negative_ctxs")]
    return kept.select(
        *rest,
        tx.truncate(tokenizer.one(F.col("question")), max_len).alias("query"),
        lists(F.col("positive_ctxs")).alias("positives"),
        lists(F.col("hard_negative_ctxs")).alias("negatives"),
    )
