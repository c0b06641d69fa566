"""Training sets: pair corpora, per-epoch choices, task batches, packing and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.functions.seeded import seeded_key, seeded_shuffle, seeded_unit
from quillrank.operators.placement import RANGE_ROWS, running_total, spread_join
from quillrank.session import settled

# Pair splits whose documents are queries too.
SYMMETRIC_SPLITS = ("quora", "simplewiki", "stackexchange_duplicate_questions")

# Instruction prompts per task; tasks with two use them in turn.
TASK_PROMPTS = {
    "allnli": [
        "Given a premise, retrieve a hypothesis that is entailed by the premise",
        "Retrieve semantically similar text",
    ],
    "dureader": ["Given a Chinese search query, retrieve web passages that answer the question"],
    "eli5_question_answer": ["Provided a user question, retrieve the highest voted answers on Reddit ELI5 forum"],
    "fever": ["Given a claim, retrieve documents that support or refute the claim"],
    "hotpot_qa": ["Given a multi-hop question, retrieve documents that can help answer the question"],
    "miracl": ["Given a question, retrieve Wikipedia passages that answer the question"],
    "mrtydi": ["Given a question, retrieve Wikipedia passages that answer the question"],
    "msmarco_passage": ["Given a web search query, retrieve relevant passages that answer the query"],
    "msmarco_document": ["Given a web search query, retrieve relevant documents that answer the query"],
    "nq": ["Given a question, retrieve Wikipedia passages that answer the question"],
    "quora_duplicates": [
        "Given a question, retrieve questions that are semantically equivalent to the given question",
        "Find questions that have the same meaning as the input question",
    ],
    "squad": ["Retrieve Wikipedia passages that answer the question"],
    "t2ranking": ["Given a Chinese search query, retrieve web passages that answer the question"],
    "trivia_qa": ["Retrieve Wikipedia passages that answer the question"],
}


def pair_rows(pairs: DataFrame, order: list[str], compat_ids: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Pairs (split, query, document) to judged rows with prefixes and no negatives.

    Ids are the split name and the place within the split; compat_ids gives the plain `split_<n>` ids, which
    repeat from split to split.
    """
    placed = running_total(pairs, order, group=["split"], name="_i", range_rows=range_rows)
    lead = F.lit("split") if compat_ids else F.col("split")
    query_id = F.concat_ws("_", lead, F.col("_i"))
    doc_prefix = F.when(F.col("split").isin(*SYMMETRIC_SPLITS), F.lit(tx.QUERY_PREFIX)).otherwise(F.lit(tx.PASSAGE_PREFIX))
    passage = F.struct(
        F.concat(query_id, F.lit("_pos")).alias("docid"),
        F.lit(None).cast("string").alias("title"),
        F.concat(doc_prefix, F.col("document")).alias("text"),
    )
    return placed.select(
        "split",
        query_id.alias("query_id"),
        F.concat(F.lit(tx.QUERY_PREFIX), F.col("query")).alias("query"),
        F.array(passage).alias("positive_passages"),
        F.array().cast("array<struct<docid:string,title:string,text:string>>").alias("negative_passages"),
    )


def rows_for_epoch(rows: DataFrame, epoch: int) -> DataFrame:
    """Of a query that goes over several rows (part, parts) the one of this epoch, so that it counts once."""
    return rows.where(F.col("part") == F.pmod(F.lit(epoch).cast("long"), F.col("parts")))


def positive_for_epoch(positives: Column, item: Column, seed: int, epoch: int, shuffle: bool = True) -> Column:
    """The first positive, or another one each epoch."""
    if not shuffle:
        return F.get(positives, F.lit(0))
    at = F.pmod(item + F.lit(seed) + F.lit(epoch), F.size(positives).cast("long"))
    return F.get(positives, at.cast("int"))


def negatives_for_epoch(
    negatives: Column, item: Column, n_passages: int, seed: int, epoch: int, shuffle: bool = True, order_shuffle: bool = True
) -> Column:
    """`n_passages - 1` negatives for an epoch.

    Too few are drawn with replacement; without shuffle the first ones are taken; else a window moves over the
    seeded order and starts again at its end. No negatives give an empty list. Elements may be passages or
    (passage, score) structs, which stay together. order_shuffle=False moves the window over the given order.
    """
    m = n_passages - 1
    size = F.size(negatives)
    empty = F.slice(negatives, 1, 0)
    if m <= 0:
        return empty
    replaced = F.transform(
        F.sequence(F.lit(1), F.lit(m)),
        lambda i: F.get(negatives, F.pmod(seeded_key(seed, item, F.lit(epoch), i), F.greatest(size, F.lit(1)).cast("long")).cast("int")),
    )
    if not shuffle:
        enough = F.slice(negatives, 1, m)
    else:
        ordered = seeded_shuffle(negatives, seed, item) if order_shuffle else negatives
        start = F.pmod(F.lit(epoch * m).cast("long"), F.greatest(size, F.lit(1)).cast("long")).cast("int")
        enough = F.slice(F.concat(ordered, ordered), start + 1, F.lit(m))
    return F.when(size == 0, empty).when(size < m, replaced).otherwise(enough)


def sample_group(
    df: DataFrame, key: str, n_passages: int, seed: int, positives: str = "positives", negatives: str = "negatives", shuffle_positive=True, shuffle_negative=True
) -> DataFrame:
    """One positive and `n_passages - 1` negatives per row, drawn without replacement by seed."""
    m = n_passages - 1
    pos = seeded_shuffle(F.col(positives), seed, F.col(key)) if shuffle_positive else F.col(positives)
    drawn = negatives_for_epoch(F.col(negatives), F.col(key), n_passages, seed + 1, 0, shuffle=shuffle_negative)
    return df.withColumn("positive", F.get(pos, F.lit(0))).withColumn("negatives", drawn if m > 0 else F.slice(negatives, 1, 0))


def soft_targets(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Softmax of score / temperature within a query, over (qid, docid, score).

    Sums are combined before the shuffle and joined back, so a query with very many rows is never one task.
    """
    scaled = settled(scores.withColumn("_s", F.col("score") / F.lit(temperature)), "scores")
    top = scaled.groupBy("qid").agg(F.max("_s").alias("_max"))
    top = settled(top, "top")
    shifted = spread_join(scaled, top, "qid", "inner", ["docid"]).withColumn("_e", F.exp(F.col("_s") - F.col("_max")))
    total = settled(shifted.groupBy("qid").agg(F.sum("_e").alias("_total")), "totals")
    out = spread_join(shifted, total, "qid", "inner", ["docid"])
    return out.withColumn("target", F.col("_e") / F.col("_total")).drop("_s", "_max", "_e", "_total")


def prompt_table(spark, prompts: dict[str, list[str]] | None = None) -> DataFrame:
    rows = list((TASK_PROMPTS if prompts is None else prompts).items())
    return spark.createDataFrame(rows, "task_name string, prompts array<string>")


def task_triplets(
    triplets: DataFrame, prompts: DataFrame, order: list[str], range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Triplets (task_name, query, positive, negative) with the prompt of their task, in turn by place.

    The prompt table has one row per task and is measured like any other side.
    """
    placed = running_total(triplets, order, group=["task_name"], name="place", range_rows=range_rows)
    known = spread_join(placed, prompts, "task_name", "inner", order)
    turn = F.pmod(F.col("place"), F.size("prompts").cast("long")).cast("int")
    prompt = F.get(F.col("prompts"), turn)
    marked = lambda c: F.concat(F.lit(tx.INSTRUCTION_SEPARATOR), F.col(c))
    return (
        known.withColumn("query", F.concat(prompt, F.lit("; "), marked("query")))
        .withColumn("positive", marked("positive"))
        .withColumn("negative", marked("negative"))
        .drop("prompts")
    )


def task_batches(
    samples: DataFrame, key: str, batch_size: int, seed: int = 0, shuffle: bool = True, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Batches of one task each: rows in seeded order per task, full batches only, batches in seeded order.

    Adds batch, place (within the batch) and turn (order of batches, to sort by together with place).
    """
    if shuffle:
        keyed, order = samples.withColumn("_order", seeded_key(seed, F.col("task_name"), F.col(key))), ["_order", key]
    else:
        keyed, order = samples, [key]
    placed = running_total(keyed, order, group=["task_name"], name="_i", range_rows=range_rows)
    sizes = samples.groupBy("task_name").agg(F.count(F.lit(1)).alias("_n"))
    sized = spread_join(placed, sizes, "task_name", "inner", [key])
    batch = F.floor(F.col("_i") / F.lit(batch_size)).cast("long")
    full = (batch + 1) * F.lit(batch_size) <= F.col("_n")
    turn = seeded_key(seed + 1, F.col("task_name"), F.col("batch")) if shuffle else F.col("batch")
    cut = sized.where(full).withColumn("batch", batch).withColumn("place", F.pmod(F.col("_i"), F.lit(batch_size)))
    return cut.withColumn("turn", turn).drop("_i", "_n", "_order")


def pack_tokens(
    rows: DataFrame, order: list[str], length: int, group_rows: int = 1000, tokens: str = "tokens", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Token arrays joined per `group_rows` rows and cut into chunks of `length`; a group's remainder is dropped.

    A row is cut at chunk borders in place, and only its pieces move. Pieces meet by (group, chunk), which the
    shuffle by group already serves.
    """
    placed = running_total(rows, order, name="_i", range_rows=range_rows)
    grouped = placed.select(F.floor(F.col("_i") / group_rows).cast("long").alias("batch"), "_i", F.col(tokens).alias("_t"))
    before = Window.partitionBy("batch").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.size("_t")).over(before), F.lit(0)).cast("long")
    sized = grouped.withColumn("_from", start).where(F.size("_t") > 0)
    first = F.floor(F.col("_from") / length).cast("long")
    last = F.floor((F.col("_from") + F.size("_t") - 1) / length).cast("long")
    low = lambda c: F.greatest(c * length - F.col("_from"), F.lit(0))
    high = lambda c: F.least((c + 1) * length - F.col("_from"), F.size("_t").cast("long"))
    piece = lambda c: F.slice("_t", (low(c) + 1).cast("int"), (high(c) - low(c)).cast("int"))
    cut = F.transform(F.sequence(first, last), lambda c: F.struct(c.alias("chunk"), piece(c).alias("p")))
    exploded = sized.select("batch", "_i", F.explode(cut).alias("_c"))
    pieces = exploded.select("batch", "_c.chunk", F.struct(F.col("_i").alias("i"), F.col("_c.p").alias("p")).alias("_p"))
    packed = pieces.groupBy("batch", "chunk").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    joined = packed.select("batch", "chunk", F.flatten(F.transform("_p", lambda p: p["p"])).alias(tokens))
    return joined.where(F.size(tokens) == length)


def line_by_line(lines: DataFrame, length: int, text: str = "text", tokenizer=tx.WORDS) -> DataFrame:
    """One row per non-blank line, cut to `length` tokens."""
    kept = lines.where(~F.coalesce(F.col(text), F.lit("")).rlike(r"\A\s*\z"))
    return kept.withColumn("tokens", tx.truncate(tokenizer.one(F.col(text)), length)).drop(text)


def mask_tokens(
    df: DataFrame, key: str, probability: float, mask_id: int, special_ids: tuple[int, ...] = (), seed: int = 0, tokens: str = "tokens"
) -> DataFrame:
    """Masks each non-special token id with the probability: input_ids, and labels with -100 elsewhere."""
    chosen = lambda t, i: (seeded_unit(seed, F.col(key), i) < F.lit(probability)) & (
        ~t.isin(*special_ids) if special_ids else F.lit(True)
    )
    inputs = F.transform(tokens, lambda t, i: F.when(chosen(t, i), F.lit(mask_id)).otherwise(t))
    labels = F.transform(tokens, lambda t, i: F.when(chosen(t, i), t).otherwise(F.lit(-100)))
    return df.withColumn("input_ids", inputs).withColumn("labels", labels)
