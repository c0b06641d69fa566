"""From activations (id, pos, term, logit) to postings (id, term, weight)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.text import LEXICAL, WordTokenizer
from quillrank.operators import placement
from quillrank.operators.placement import HOT_KEYS, HOT_ROWS, fits_broadcast, spread_join, top_k
from quillrank.session import settled

ACTIVATIONS = "id string, pos long, term string, logit double"
#: Rows and characters of texts that an encoder gets at once: its activations are many times as large.
ENCODED_ROWS, ENCODED_CHARS = 1_000, 500_000


def pieces(sizes: np.ndarray, rows: int = ENCODED_ROWS, chars: int = ENCODED_CHARS) -> Iterator[slice]:
    """Consecutive slices of at most so many rows, and of at most so many characters unless a single row has more."""
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        most = chars + (ends[start - 1] if start else 0)
        stop = min(max(start + 1, int(np.searchsorted(ends, most, side="right"))), start + rows, len(ends))
        yield slice(start, stop)
        start = stop


def _chars(batch: pd.DataFrame) -> np.ndarray:
    """Characters of each row."""
    sizes = np.zeros(len(batch), np.int64)
    for name in batch.columns[batch.dtypes == object]:
        sizes += np.array([len(x) if isinstance(x, str) else 0 for x in batch[name]], np.int64)
    return sizes


def encode_batches(df: DataFrame, encoder: Callable[[pd.DataFrame], pd.DataFrame], schema: str = ACTIVATIONS) -> DataFrame:
    """Runs a model over pieces of Arrow batches, of bounded size; Spark partitions take the place of shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in pieces(_chars(batch)):
                yield encoder(batch.iloc[part].reset_index(drop=True))

    return df.mapInPandas(run, schema)


POOLINGS = ("max", "mean", "last")


def _pooled(active: pd.DataFrame, sizes: pd.Series, pooling: str, max_terms: int | None) -> pd.DataFrame:
    """Weights (id, term, weight) of the activations of one batch; sizes: tokens by id."""
    active = active.assign(n=active["id"].map(sizes))
    if pooling == "last":
        active = active[active["pos"] == active["n"] - 1]
    groups = active.groupby(["id", "term"], sort=False)
    logit = groups["logit"].sum() / groups["n"].first() if pooling == "mean" else groups["logit"].max()
    out = np.log1p(logit.clip(lower=0)).rename("weight").reset_index()
    if max_terms is not None:
        out = out.sort_values(["weight", "term"], ascending=[False, True], kind="stable").groupby("id").head(max_terms)
    return out[["id", "term", "weight"]]


def encode_pooled(
    texts: DataFrame,
    encoder: Callable[[pd.DataFrame], pd.DataFrame],
    pooling: str = "max",
    max_terms: int | None = None,
    tokenizer=LEXICAL,
) -> DataFrame:
    """Runs a model over batches of (id, text) and pools and cuts its activations there: only (id, term, weight) leaves.

    `tokenizer` counts tokens, which need not all have an activation. Ids are unique; null texts count as empty. A
    row without activations gives no row (see fill_empty).
    """
    if pooling not in POOLINGS:
        raise ValueError(f"unknown pooling {pooling}")
    rows = texts.select(F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_tokens", F.size(tokenizer.one(F.col("text"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in pieces(_chars(batch)):
                own = batch.iloc[part].reset_index(drop=True)
                yield _pooled(encoder(own[["id", "text"]]), own.set_index("id")["n_tokens"], pooling, max_terms)

    return rows.mapInPandas(run, "id string, term string, weight double")


def document_frequencies(docs: DataFrame, tokenizer=LEXICAL) -> DataFrame:
    """Documents per term. Terms are made unique within the row, so one combined shuffle is enough."""
    terms = F.explode(F.array_distinct(tokenizer.one(F.col("text"))))
    return docs.select(terms.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _saturate(logit: Column) -> Column:
    return F.log1p(F.greatest(logit, F.lit(0.0)))


def frequencies_for(rows: DataFrame, frequencies: DataFrame, tokenizer=LEXICAL) -> DataFrame:
    """The frequencies of the terms in some rows, such as a query set, which need little of a vocabulary."""
    terms = rows.select(F.explode(F.array_distinct(tokenizer.one(F.col("text")))).alias("term"))
    return spread_join(frequencies, terms.distinct(), "term", "left_semi")


def lexical_weights(rows: DataFrame, frequencies: DataFrame, n_docs: int, tokenizer=LEXICAL) -> DataFrame:
    """Max-pooled lexical activations in one step: a term has one logit, so one row per term needs no grouping."""
    first = lexical_activations(rows, frequencies, n_docs, tokenizer, every_position=False)
    return first.select("id", "term", _saturate(F.col("logit")).alias("weight"))


def lexical_activations(
    rows: DataFrame,
    frequencies: DataFrame,
    n_docs: int,
    tokenizer=LEXICAL,
    every_position: bool = True,
    frequencies_fit: bool | None = None,
) -> DataFrame:
    """The built-in stand-in for a model: logit = ln((N+1)/(df+1)) wherever a term occurs.

    `rows` has id and text. With every_position=False only the first place of a term is listed, which gives the
    same maximum with far fewer rows.

    Of a vocabulary too large to broadcast, the terms of most documents are, so only the places of rare ones are shuffled.
    """
    tokens = tokenizer.one(F.col("text"))
    listed = rows.select("id", (tokens if every_position else F.array_distinct(tokens)).alias("_t"))
    place = F.posexplode("_t").alias("pos", "term")
    if fits_broadcast(frequencies) if frequencies_fit is None else frequencies_fit:
        joined = listed.select("id", place).join(F.broadcast(frequencies), "term", "left")
    else:
        # Both ways read the tokens. Those of a plugged tokeniser are stored; to cut a text at its words again costs less than that.
        again = listed if isinstance(tokenizer, WordTokenizer) else settled(listed, "tokens")
        joined = _looked_up(again.select("id", place), frequencies)
    logit = F.log(F.lit(float(n_docs + 1)) / (F.coalesce(F.col("df"), F.lit(0)) + 1.0))
    return joined.select("id", F.col("pos").cast("long").alias("pos"), "term", logit.alias("logit"))


def _looked_up(placed: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Places (id, pos, term) with the df of their terms, if they have one; the terms are unique in `frequencies`."""
    width = F.coalesce(F.length("term"), F.lit(0)) + 24
    by_df = frequencies.groupBy("df").agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).where("df is not null")
    least, n, b = None, 0, 0
    for row in by_df.orderBy(F.desc("df")).toLocalIterator():
        n, b = n + row["n"], b + row["b"]
        if n > placement.BROADCAST_ROWS or b > placement.BROADCAST_BYTES:
            break
        least = row["df"]
    hot = frequencies.where(F.col("df") >= HOT_ROWS).orderBy(F.desc("df"), "term").limit(HOT_KEYS)
    if least is None:
        return spread_join(placed, frequencies, "term", "left", ["id"], right_fits=False, hot=hot)
    is_common = F.coalesce(F.col("df") >= least, F.lit(False))
    common, rare = frequencies.where(is_common), frequencies.where(~is_common)
    known = placed.join(F.broadcast(common), "term")
    rest = placed.join(F.broadcast(common), "term", "left").where("df is null").drop("df")
    return known.unionByName(spread_join(rest, rare, "term", "left", ["id"], right_fits=False, hot=hot))


def pool_max(activations: DataFrame, by_row: bool = False) -> DataFrame:
    """The maximum of each row's term. With `by_row` a row's activations go to one task first, as suits those that are one per
    term already: what is done with the row's terms afterwards, such as to take the heaviest, needs no second shuffle."""
    if by_row:
        activations = activations.repartition("id")
    return activations.groupBy("id", "term").agg(_saturate(F.max("logit")).alias("weight"))


def pool_mean(activations: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean over all tokens of a row. `sizes` (id, n_tokens) counts every token, also those without a term."""
    sums = activations.groupBy("id", "term").agg(F.sum("logit").alias("total"))
    mean = F.col("total") / F.greatest(F.col("n_tokens"), F.lit(1))
    return sums.join(sizes.select("id", "n_tokens"), "id").select("id", "term", _saturate(mean).alias("weight"))


def pool_last(activations: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Activations at the last token of each row, by `sizes` (id, n_tokens); without, at the last place that has any."""
    if sizes is None:
        last = activations.join(activations.groupBy("id").agg(F.max("pos").alias("pos")), ["id", "pos"])
    else:
        last = activations.join(sizes.select("id", (F.col("n_tokens") - 1).cast("long").alias("pos")), ["id", "pos"])
    return last.groupBy("id", "term").agg(_saturate(F.max("logit")).alias("weight"))


def pool(activations: DataFrame, how: str = "max", sizes: DataFrame | None = None) -> DataFrame:
    if how == "max":
        return pool_max(activations)
    if how == "last":
        return pool_last(activations, sizes)
    if how == "mean":
        return pool_mean(activations, sizes)
    raise ValueError(f"unknown pooling {how}")


def top_terms(postings: DataFrame, k: int) -> DataFrame:
    """The k heaviest terms of each row; equal weights go by term."""
    return top_k(postings, ["id"], [F.desc("weight"), F.asc("term")], k, "_rank", spread="term").drop("_rank")


def positive_weights(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("weight") > 0)


def quantise(postings: DataFrame, how: str = "rint", scale: int = 100) -> DataFrame:
    """Integer weights, rounded half to even or up; rows at or below zero go."""
    scaled = F.col("weight") * F.lit(float(scale))
    whole = F.rint(scaled) if how == "rint" else F.ceil(scaled)
    return postings.withColumn("weight", whole.cast("int")).where(F.col("weight") > 0)


def fill_empty(postings: DataFrame, ids: DataFrame, pad: str = "[PAD]") -> DataFrame:
    """Every id keeps a vector: one pad term of weight one where no term is left."""
    kind = postings.schema["weight"].dataType
    filled = ids.select("id").join(postings, "id", "left")
    return filled.select(
        "id",
        F.coalesce("term", F.lit(pad)).alias("term"),
        F.when(F.col("term").isNull(), F.lit(1)).otherwise(F.col("weight")).cast(kind).alias("weight"),
    )


def write_filled(postings: DataFrame, ids: DataFrame, path: str, pad: str = "[PAD]") -> None:
    """Stores what fill_empty gives for postings that are made of the rows of `ids`, without a shuffle of postings.

    They are written as they are made; then the ids that have none are found and their pad terms added to the folder. As
    in a join, an id that comes n times has each of its postings n times.
    """
    spark, kind = postings.sparkSession, postings.schema["weight"].dataType
    named = postings.where("id is not null").select("id", "term", "weight")
    counted = ids.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    copies = settled(counted.where("_n > 1"), "copies")
    if not copies.isEmpty():
        times = F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1).cast("long")))
        named = spread_join(named, copies, "id", "left", ["term"]).withColumn("_n", F.explode(times)).drop("_n")
    named.write.parquet(path)
    seen = spark.read.schema(named.schema).parquet(path).select("id").distinct()
    empty = ids.select("id").join(seen, "id", "left_anti")
    empty.select("id", F.lit(pad).alias("term"), F.lit(1).cast(kind).alias("weight")).write.mode("append").parquet(path)


def name_terms(postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Term ids to strings; ids outside the vocabulary (term_id, term) are dropped."""
    return spread_join(postings, vocabulary, "term_id", "inner", ["id"]).select("id", "term", "weight")


# Special token ids that never get a weight.
SPECIAL_TERM_IDS = (0, 101, 102, 103)


def scatter_max(token_weights: DataFrame, special: tuple[int, ...] = SPECIAL_TERM_IDS) -> DataFrame:
    """Per-token weights (id, term_id, weight) to one weight per term, special ids left out."""
    kept = token_weights.where(~F.col("term_id").isin(*special))
    best = kept.groupBy("id", "term_id").agg(F.max(F.greatest("weight", F.lit(0.0))).alias("weight"))
    return best.where(F.col("weight") > 0)


def l2_normalise(postings: DataFrame) -> DataFrame:
    """Unit length per row. A row's terms are distinct, so its window holds at most the vocabulary."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
    return postings.withColumn("weight", F.when(length > 0, F.col("weight") / length).otherwise(F.lit(0.0)))


def sparsity_report(postings: DataFrame, n_rows: int) -> DataFrame:
    """FLOPS: squared mean absolute weight summed over terms; and active terms per row."""
    per_term = postings.groupBy("term").agg(
        F.sum(F.abs("weight")).alias("mass"), F.sum((F.col("weight") > 0).cast("long")).alias("active")
    )
    mean = F.col("mass") / F.lit(float(n_rows))
    return per_term.agg(
        F.sum(mean * mean).alias("flops"),
        (F.sum("active") / F.lit(float(n_rows))).alias("active_terms"),
        F.count(F.lit(1)).alias("terms"),
    )


def to_vectors(postings: DataFrame) -> DataFrame:
    """Postings to (id, vector map), heaviest term first."""
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("o"), "term", "weight")))
    rows = postings.groupBy("id").agg(pairs.alias("pairs"))
    entries = F.transform("pairs", lambda p: F.struct(p["term"], p["weight"]))
    return rows.select("id", F.map_from_entries(entries).alias("vector"))


def to_postings(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", F.explode("vector").alias("term", "weight"))


def repeated_tokens(vectors: DataFrame) -> DataFrame:
    """Integer vectors as text: each term as often as its weight."""
    entries = F.map_entries("vector")
    words = F.flatten(F.transform(entries, lambda e: F.array_repeat(e["key"], e["value"].cast("int"))))
    return vectors.select("id", F.array_join(words, " ").alias("tokens"))
