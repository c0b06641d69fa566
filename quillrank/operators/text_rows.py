"""Row preparation: composing, tokenising and trimming queries and passages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.functions import text as tx
from quillrank.operators.placement import running_total, spread_join

PASSAGE = T.StructType(
    [T.StructField("docid", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]
)
IGNORED = -100
SCORED_PASSAGE = T.StructType(PASSAGE.fields + [T.StructField("score", T.DoubleType())])


ONE_TASK_ROWS = 10_000


def _texts(passages: Column, sep: str, prefix: str, lowercase: bool) -> Column:
    return F.transform(passages, lambda p: tx.passage_text(p["title"], p["text"], sep, prefix, lowercase))


def _token_lists(passages: Column, max_len, sep, prefix, lowercase, eos, tokenizer) -> Column:
    lists = tokenizer.many(_texts(passages, sep, prefix, lowercase))
    return F.transform(lists, lambda t: tx.truncate(t, max_len, eos))


def _query_tokens(query: Column, max_len, prefix, lowercase, eos, tokenizer) -> Column:
    body = F.lower(query) if lowercase else query
    return tx.truncate(tokenizer.one(F.concat(F.lit(prefix), body)), max_len, eos)


def train_rows(
    df: DataFrame,
    q_max: int = 32,
    p_max: int = 256,
    sep: str = " ",
    q_prefix: str = tx.QUERY_PREFIX,
    p_prefix: str = tx.PASSAGE_PREFIX,
    lowercase: bool = False,
    eos: str | None = None,
    tokenizer=tx.WORDS,
) -> DataFrame:
    """Judged rows to token arrays: query, positives, negatives; part and parts of a query stay."""
    return df.select(
        "query_id",
        *[c for c in ("part", "parts") if c in df.columns],
        _query_tokens(F.col("query"), q_max, q_prefix, lowercase, eos, tokenizer).alias("query"),
        _token_lists(F.col("positive_passages"), p_max, sep, p_prefix, lowercase, eos, tokenizer).alias("positives"),
        _token_lists(F.col("negative_passages"), p_max, sep, p_prefix, lowercase, eos, tokenizer).alias("negatives"),
    )


def contrastive_rows(df: DataFrame, q_prefix: str = "", p_prefix: str = "", **options) -> DataFrame:
    """As train_rows, with no prefixes, and an empty list where negatives are missing."""
    missing = F.array().cast(df.schema["positive_passages"].dataType)
    negatives = F.coalesce(F.col("negative_passages"), missing) if "negative_passages" in df.columns else missing
    return train_rows(df.withColumn("negative_passages", negatives), q_prefix=q_prefix, p_prefix=p_prefix, **options)


def margin_train_rows(df: DataFrame, q_max: int = 32, p_max: int = 256, margin: int = 3, **options) -> DataFrame:
    """As train_rows, keeping `margin` slots free for special tokens."""
    return train_rows(df, q_max=q_max - margin, p_max=p_max - margin, **options)


def scored_train_rows(
    df: DataFrame,
    q_max: int = 32,
    p_max: int = 256,
    sep: str = " ",
    q_prefix: str = tx.QUERY_PREFIX,
    p_prefix: str = tx.PASSAGE_PREFIX,
    lowercase: bool = False,
    eos: str | None = None,
    tokenizer=tx.WORDS,
) -> DataFrame:
    """Distillation rows: each passage keeps its tokens and its score in one struct."""

    def scored(name: str) -> Column:
        lists = _token_lists(F.col(name), p_max, sep, p_prefix, lowercase, eos, tokenizer)
        return F.zip_with(lists, F.col(name), lambda t, p: F.struct(t.alias("tokens"), p["score"].alias("score")))

    return df.select(
        "query_id",
        _query_tokens(F.col("query"), q_max, q_prefix, lowercase, eos, tokenizer).alias("query"),
        scored("positive_passages").alias("positives"),
        scored("negative_passages").alias("negatives"),
    )


def query_rows(
    df: DataFrame, max_len: int | None = 32, prefix: str = tx.QUERY_PREFIX, lowercase=False, eos=None, tokenizer=tx.WORDS
) -> DataFrame:
    """Queries to (text_id, text), text being tokens."""
    tokens = _query_tokens(F.col("query"), max_len, prefix, lowercase, eos, tokenizer)
    return df.select(F.col("query_id").alias("text_id"), tokens.alias("text"))


def corpus_rows(
    df: DataFrame,
    max_len: int | None = 256,
    sep: str = " ",
    prefix: str | Column = tx.PASSAGE_PREFIX,
    lowercase: bool = False,
    eos: str | None = None,
    tokenizer=tx.WORDS,
) -> DataFrame:
    """Passages to (text_id, text), text being tokens."""
    title = F.col("title") if "title" in df.columns else None
    body = tx.passage_text(title, F.col("text"), sep, prefix, lowercase)
    return df.select(F.col("docid").alias("text_id"), tx.truncate(tokenizer.one(body), max_len, eos).alias("text"))


def line_rows(df: DataFrame, line: str = "value", delimiter: str = "\t", sep: str = " ", max_len: int | None = 128, tokenizer=tx.WORDS) -> DataFrame:
    """Delimited lines: field one is the id, the others are joined and tokenised."""
    fields = F.split(tx.strip(F.col(line)), delimiter, -1)
    body = F.array_join(F.slice(fields, F.lit(2), F.size(fields)), sep)
    return df.select(F.element_at(fields, 1).alias("text_id"), tx.truncate(tokenizer.one(body), max_len).alias("text"))


def rerank_rows(df: DataFrame, q_max: int = 32, p_max: int = 256, sep: str = " ", tokenizer=tx.WORDS) -> DataFrame:
    """Rerank input to query and passage tokens, without prefixes."""
    body = tx.passage_text(F.col("title"), F.col("text"), sep)
    return df.select(
        "query_id",
        "docid",
        tx.truncate(tokenizer.one(F.col("query")), q_max).alias("query"),
        tx.truncate(tokenizer.one(body), p_max).alias("text"),
    )


def rerank_prompt_rows(
    df: DataFrame, q_max: int = 32, p_max: int = 256, sep: str = " ", margin: int = 3, tokenizer=tx.WORDS
) -> DataFrame:
    """Rerank input with prompt prefixes; the passage leaves `margin` slots free. The document prefix stands
    before a title only."""
    titled = F.concat(F.lit(tx.DOCUMENT_PREFIX), F.col("title"), F.lit(sep), F.col("text"))
    body = F.when(F.col("title").isNotNull(), titled).otherwise(F.col("text"))
    return df.select(
        "query_id",
        "docid",
        tx.truncate(tokenizer.one(F.concat(F.lit(tx.QUERY_PREFIX), F.col("query"))), q_max).alias("query"),
        tx.truncate(tokenizer.one(body), p_max - margin).alias("text"),
    )


def pair_tokens(df: DataFrame, max_len: int, bos: str | None = None) -> DataFrame:
    """One token array per pair; when it is too long the query side is cut, never the passage."""
    query, text = F.col("query"), F.col("text")
    if bos is not None:
        query, text = F.concat(F.array(F.lit(bos)), query), F.concat(F.array(F.lit(bos)), text)
    room = F.greatest(F.lit(max_len) - F.size(text), F.lit(0))
    return df.withColumn("pair", F.concat(F.slice(query, F.lit(1), room), text))


def instruct(df: DataFrame, instructions: DataFrame, task: str = "task", text: str = "text") -> DataFrame:
    """Adds `instructed`: each text behind the instruction of its task; tasks without one get none."""
    joined = spread_join(df, instructions.select(task, "instruction"), task, "left")
    return joined.withColumn("instructed", tx.with_instruction(F.col("instruction"), F.col(text)))


def cap_words(df: DataFrame, cap: int, text: str = "text", count_tokens=None) -> DataFrame:
    """Shrinks a text to int(words * cap / tokens) words until it has at most `cap` tokens.

    Words by blanks are the default tokens, and then one cut is enough. `count_tokens` maps a list of texts to
    their token counts and runs on Arrow batches.
    """
    if count_tokens is None:
        words = F.filter(F.split(F.col(text), r"\s+", -1), lambda w: F.length(w) > 0)
        kept = lambda w: F.floor(F.size(w) * (F.lit(float(cap)) / F.size(w))).cast("int")
        short = lambda w: F.array_join(F.slice(w, F.lit(1), kept(w)), " ")
        return df.withColumn(text, tx.let(words, lambda w: F.when(F.size(w) > cap, short(w)).otherwise(F.col(text))))

    @F.pandas_udf(T.StringType())
    def shrink(texts: pd.Series) -> pd.Series:
        out = texts.fillna("").tolist()
        open_rows = list(range(len(out)))
        while open_rows:
            sizes = count_tokens([out[i] for i in open_rows])
            long_rows = [(i, n) for i, n in zip(open_rows, sizes) if n > cap]
            for i, n in long_rows:
                parts = out[i].split()
                out[i] = " ".join(parts[: int(len(parts) * (cap / n))])
            open_rows = [i for i, _ in long_rows]
        return pd.Series(out)

    return df.withColumn(text, shrink(F.col(text)))


def min_rows(df: DataFrame, min_negatives: int = 1, positives="positive_passages", negatives="negative_passages") -> DataFrame:
    """Keeps rows with a positive and at least `min_negatives` negatives."""
    return df.where((F.size(positives) >= 1) & (F.size(negatives) >= min_negatives))


def split_by_percent(df: DataFrame, order: list[str], percent: int, range_rows: int | None = None) -> DataFrame:
    """Adds `split`: the first `percent` of the rows are validation, the others train."""
    options = {} if range_rows is None else {"range_rows": range_rows}
    cut = round(df.count() * percent / 100.0)
    placed = running_total(df, order, name="_place", **options)
    split = F.when(F.col("_place") < cut, F.lit("validation")).otherwise(F.lit("train"))
    return placed.withColumn("split", split).drop("_place")


def take_first(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows by the unique key, or all where there are fewer.

    Many rows are cut by their place, so that they never meet in one task.
    """
    if n <= ONE_TASK_ROWS:
        return df.orderBy(*order).limit(n)
    return running_total(df, order, name="_place").where(F.col("_place") < n).drop("_place")


def longest_first(df: DataFrame, key: str = "docid", within_tasks: bool = False) -> DataFrame:
    """Rows by length of title and text, longest first; for inference each task sorts its own rows."""
    length = F.length(F.concat(F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))
    sized = df.withColumn("length", length.cast("long"))
    order = [F.desc("length"), F.asc(key)]
    return sized.sortWithinPartitions(*order) if within_tasks else sized.orderBy(*order)


def scale_score(score: Column, low: float, high: float) -> Column:
    return (score - F.lit(low)) / F.lit(high - low)


def align_labels(word_ids: Column, labels: Column, mode: str = "same_token") -> Column:
    """Word labels to subtokens: the first subtoken of a word has its label, the others -100.

    `word_ids` counts words from 0 and is null for special tokens. In next_token mode labels move left by one.
    """
    if mode not in ("same_token", "next_token"):
        raise ValueError(f"unknown mode {mode}")
    same = tx.let(F.struct(word_ids.alias("w"), labels.alias("l")), lambda p: _first_pieces(p["w"], p["l"]))
    if mode == "same_token":
        return same
    return tx.let(same, lambda ids: F.slice(F.concat(ids, F.array(F.lit(IGNORED))), F.lit(2), F.size(ids)))


def _first_pieces(word_ids: Column, labels: Column) -> Column:
    fresh = lambda w, i: w.isNotNull() & ((i == 0) | ~w.eqNullSafe(F.get(word_ids, i - 1)))
    return F.transform(word_ids, lambda w, i: F.when(fresh(w, i), F.get(labels, w.cast("int"))).otherwise(F.lit(IGNORED)))


def shift_word_ids(word_ids: Column) -> Column:
    """Word ids that go with next_token labels; -1 marks special tokens."""
    marked = F.transform(word_ids, lambda w: F.coalesce(w, F.lit(-1)))
    return F.slice(F.concat(marked, F.array(F.lit(-1))), F.lit(2), F.size(word_ids))
