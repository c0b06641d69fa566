"""Quality by hierarchical empirical Bayes: what a text looks like, weighed with what its path and host are known for.

A classifier reads the text and gives the odds that it is good. The share of good texts of each path is estimated
from all its texts and drawn towards the share of its host, as that is towards the share of all: the fewer texts, and
the more alike the sites, the stronger. What a text itself has
added to its path, its host and the share of all, which is its label where it has one, is taken out of all three before the
two are put together, so no text is judged by its own label there:

    odds(good | text, path) = odds(text) / odds(training) * odds(path without this text)
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import drawn
from quillrank.operators.placement import fits_broadcast
from quillrank.session import settled

MAX_LABELLED = 20_000
ROUNDS = 30
RIDGE = 1.0
WEAKEST, STRONGEST = 2.0, 1_000.0


def features(text: str) -> list[Column]:
    """Numbers that describe a text's form, each from one pass and the same for any language."""
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.split(t, r"[ \t\n\r]+")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / size
    lines = F.split(t, "\n")
    return [
        F.log1p(F.length(t).cast("double")),
        share(r"\p{Lu}"),
        share(r"[!?]"),
        share(r"[^\p{L}\p{N}\s!?.,]"),
        share(r"\p{N}"),
        F.log1p(size / n_words),
        F.size(F.array_distinct(words)) / n_words,
        F.size(F.array_distinct(lines)) / F.size(lines),
    ]


@dataclass(frozen=True)
class Weights:
    """Logistic weights on standardised features. `base` is the share of good texts among those trained on."""

    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    base: float

    def log_odds(self, values: Sequence[Column]) -> Column:
        out = F.lit(self.bias)
        for value, mean, scale, weight in zip(values, self.means, self.scales, self.weights):
            out = out + F.lit(weight / scale) * (value - F.lit(mean))
        return out


def fit(rows: np.ndarray, labels: np.ndarray) -> Weights:
    """Newton steps on the logistic loss with a small ridge. With one class or no rows the text says nothing."""
    wide = rows.shape[1] if rows.ndim == 2 else 0
    base = float((labels.sum() + 1) / (len(labels) + 2))
    if len(set(labels.tolist())) < 2:
        return Weights((0.0,) * wide, (1.0,) * wide, (0.0,) * wide, float(np.log(base / (1 - base))), base)
    means, scales = rows.mean(axis=0), rows.std(axis=0)
    scales[scales < 1e-9] = 1.0
    x = np.column_stack([(rows - means) / scales, np.ones(len(rows))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([RIDGE] * wide + [1e-6])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Weights(tuple(means.tolist()), tuple(scales.tolist()), tuple(w[:-1].tolist()), float(w[-1]), base)


def _strength(rates: Column, sizes: Column, centre: float) -> list[Column]:
    """Sums from which the strength of a prior is found by moments: how far rates lie from the centre, beyond chance."""
    far = (rates - F.lit(centre)) ** 2
    return [F.sum(sizes * far).alias("spread"), F.sum(sizes).alias("weight"), F.count(F.lit(1)).alias("groups"), F.sum(sizes * sizes).alias("squares")]


def _moments(row, centre: float) -> float:
    """The number of texts that the prior is worth: large where groups are alike, small where they differ."""
    if not row["groups"] or row["groups"] < 2:
        return STRONGEST
    chance = centre * (1 - centre)
    even = row["weight"] - row["squares"] / row["weight"]
    between = (row["spread"] - (row["groups"] - 1) * chance) / even if even > 0 else 0.0
    if between <= 0:
        return STRONGEST
    return round(float(min(STRONGEST, max(WEAKEST, chance / between - 1))), 6)


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_cols: Sequence[str] = ("source", "lang"),
    label_col: str = "quality",
    threshold: float = 0.5,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """Every row of `docs` as `row`, with p_text, p_host, p_path, p_good and kept.

    The classifier is fitted on the driver to at most `max_labelled` labelled texts, chosen by the hash of their id;
    a label other than 0 and 1 or null is none, and of several labels of a document the smallest counts. Shares of hosts and paths
    are sums over all texts, labelled or not: a known label counts as it is, else the classifier's probability.
    A null host is one that nothing is known of: its texts get the share of all, a null path column is a path like any
    other. Null and empty texts are scored by their features. Each row is scored, also those that repeat; without
    labels, or with one class, texts differ by nothing and all have the same score. Extra columns stay inside `row`.
    """
    values = features("row." + text_col)
    names = [f"f{i}" for i in range(len(values))]
    held = docs.select(F.struct("*").alias("row"))
    site = [F.col(f"row.{host_col}").alias("host"), F.struct(*[F.col(f"row.{c}").alias(f"p{i}") for i, c in enumerate(path_cols)]).alias("path")]
    seen = held.select(F.col(f"row.{id_col}").alias("id"), *site, *[v.alias(n) for v, n in zip(values, names)])
    seen = settled(seen, "features")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    marked = seen.join(known, "id")
    taken = drawn(marked.select("label", "id", *names), max_labelled, "id", *names).toPandas()
    weights = fit(taken[names].to_numpy(dtype=float), taken["label"].to_numpy(dtype=float))
    logistic = lambda x: 1 / (1 + F.exp(-x))
    text_odds = weights.log_odds([F.col(n) for n in names])
    told = seen.join(known, "id", "left").select("host", "path", F.coalesce(F.col("label").cast("double"), logistic(text_odds)).alias("p"))
    paths = told.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum("p"), 6).alias("s"))
    paths = settled(paths, "paths")
    hosts = paths.where("host is not null").groupBy("host").agg(F.sum("n").alias("hn"), F.round(F.sum("s"), 6).alias("hs"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    # Sums are held to six digits: their last ones depend on the order in which tasks end.
    centre = round((total["s"] + 1) / (total["n"] + 2), 6) if total["n"] else 0.5
    k_host = _moments(hosts.agg(*_strength(F.col("hs") / F.col("hn"), F.col("hn"), centre)).first(), centre)
    k_path = _moments(paths.where("host is not null").join(hosts, "host").agg(
        *_strength(F.col("s") / F.col("n") - F.col("hs") / F.col("hn") + F.lit(centre), F.col("n"), centre)
    ).first(), centre)
    sites = paths.join(hosts, "host", "left").select("host", "path", "n", "s", "hn", "hs")
    sites = settled(sites, "sites")
    if fits_broadcast(sites):
        sites = F.broadcast(sites)
    own = F.broadcast(known) if fits_broadcast(known) else known
    scored = held.join(own, F.col(f"row.{id_col}") == F.col("id"), "left")
    scored = scored.withColumns({n: v for n, v in zip(names, values)}).select("row", "label", *site, text_odds.alias("x"))
    same = F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path"))
    met = scored.alias("d").join(sites.alias("s"), same, "left").select("row", "x", "label", F.col("d.host").alias("host"), "n", "s", "hn", "hs")
    met = met.withColumn("p_text", logistic(F.col("x"))).withColumn("own", F.coalesce(F.col("label").cast("double"), F.col("p_text")))
    others = lambda n: F.greatest(F.col(n) - 1, F.lit(0.0))
    rest = lambda s, n: F.least(F.greatest(F.col(s) - F.col("own"), F.lit(0.0)), others(n))
    rounded = lambda sums: F.round(sums, 6)
    met = met.withColumn("centre", rounded((F.lit(total["s"] or 0.0) - F.col("own") + 1) / F.lit((total["n"] or 1.0) + 1)))
    p_host = F.when(F.col("host").isNull(), F.col("centre")).otherwise((rounded(rest("hs", "hn")) + k_host * F.col("centre")) / (others("hn") + k_host))
    met = met.withColumn("p_host", p_host)
    p_path = (rounded(rest("s", "n")) + k_path * F.col("p_host")) / (others("n") + k_path)
    p_path = F.when(F.col("host").isNull(), F.col("centre")).otherwise(p_path)
    logit = lambda p: F.log(p / (1 - p))
    met = met.withColumn("p_path", F.least(F.greatest(p_path, F.lit(1e-6)), F.lit(1 - 1e-6)))
    training = float(np.log(weights.base / (1 - weights.base)))
    p_good = logistic(F.col("x") - F.lit(training) + logit(F.col("p_path")))
    met = met.withColumn("p_good", p_good)
    return met.select("row", "p_text", "p_host", "p_path", "p_good", (F.col("p_good") >= threshold).alias("kept"))
