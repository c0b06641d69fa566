"""Evaluation of embeddings, classifiers, clusterings and token labels."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.functions.vectors import cosine
from quillrank.operators.placement import RANGE_ROWS, running_total, spread_join
from quillrank.session import fresh_path, settled

IGNORED = -100


def pair_cosine(df: DataFrame, a: str, b: str, name: str = "cosine") -> DataFrame:
    return df.withColumn(name, cosine(F.col(a), F.col(b)))


def average_ranks(df: DataFrame, value: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Average rank of each distinct value: rows before it plus half its own rows.

    Values are counted first, so a value that a third of the rows share is one row.
    """
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counted, [value], F.col("_n"), name="_before", range_rows=range_rows)
    return placed.select(value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))


def spearman(df: DataFrame, a: str, b: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Correlation of average ranks, one row. The two columns are settled, as both rankings read them."""
    pairs = settled(df.select(F.col(a).alias("a"), F.col(b).alias("b")), "pairs")
    with_a = spread_join(pairs, average_ranks(pairs, "a", "rank_a", range_rows), "a", "inner", ["b"])
    both = spread_join(with_a, average_ranks(pairs, "b", "rank_b", range_rows), "b", "inner", ["a"])
    return both.agg(F.corr("rank_a", "rank_b").alias("spearman"), F.count(F.lit(1)).alias("pairs"))


def classify(train: DataFrame, test: DataFrame, max_iter: int = 100, regularisation: float = 0.0) -> DataFrame:
    """Logistic regression on (embedding, label), applied to test rows: adds prediction."""
    vectors = lambda df: df.withColumn("_features", array_to_vector("embedding"))
    out = _fitted(train, max_iter, regularisation).transform(vectors(test)).drop("_features", "rawPrediction", "probability")
    return out.withColumn("prediction", F.col("prediction").cast("int"))


def _fitted(train: DataFrame, max_iter: int, regularisation: float, tolerance: float = 1e-6):
    learner = LogisticRegression(
        featuresCol="_features", labelCol="label", predictionCol="prediction", maxIter=max_iter, regParam=regularisation, tol=tolerance
    )
    vectors = train.withColumn("_features", array_to_vector("embedding"))
    return learner.fit(vectors.select("_features", F.col("label").cast("double").alias("label")))


def expected_classes(train: DataFrame, max_iter: int = 500, regularisation: float = 0.01) -> DataFrame:
    """(label, expected): the sum of each class's probability over the rows that a classifier was fitted to.

    Where the fit has come to its optimum, it is the number of rows of the class: the derivative by its intercept, which is
    not regularised, is the difference of the two.
    """
    model = _fitted(train, max_iter, regularisation, 1e-10)
    rows = model.transform(train.withColumn("_features", array_to_vector("embedding")))
    each = rows.select(F.posexplode(vector_to_array("probability")).alias("label", "p"))
    return each.groupBy("label").agg(F.sum("p").alias("expected"))


def classification_report(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and macro F1 from the confusion counts."""
    cells = predicted.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("l").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("right")),
                F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("right")),
            )
        ).alias("s")
    ).select("s.*")
    per_class = sides.groupBy("c").agg(F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), F.sum("right").alias("right"))
    f1 = 2.0 * F.col("right") / (F.col("actual") + F.col("guessed"))
    return per_class.agg(
        (F.sum("right") / F.sum("actual")).alias("accuracy"), F.avg(f1).alias("macro_f1"), F.count(F.lit(1)).alias("classes")
    )


def cluster(df: DataFrame, clusters: int | None = None, seed: int = 7, iterations: int = 50) -> DataFrame:
    """k-means over (embedding, label): as many clusters as labels unless told; adds cluster."""
    if clusters is None:
        clusters = df.agg(F.count_distinct("label").alias("n")).first()["n"]
    vectors = df.withColumn("_features", array_to_vector("embedding"))
    model = KMeans(featuresCol="_features", predictionCol="cluster", k=clusters, seed=seed, maxIter=iterations).fit(vectors)
    return model.transform(vectors).drop("_features")


def v_measures(assigned: DataFrame, by: str = "cluster_set") -> DataFrame:
    """Homogeneity, completeness and V-measure per cluster set, from the contingency counts."""
    cells = assigned.groupBy(by, "label", "cluster").agg(F.count(F.lit(1)).alias("n"))
    plogp = lambda n, total: -(n / total) * F.log(n / total)
    totals = cells.groupBy(by).agg(F.sum("n").alias("total"))
    classes = cells.groupBy(by, "label").agg(F.sum("n").alias("n_class"))
    groups = cells.groupBy(by, "cluster").agg(F.sum("n").alias("n_cluster"))
    h_class = classes.join(totals, by).groupBy(by).agg(F.sum(plogp(F.col("n_class"), F.col("total"))).alias("h_c"))
    h_group = groups.join(totals, by).groupBy(by).agg(F.sum(plogp(F.col("n_cluster"), F.col("total"))).alias("h_k"))
    inside = cells.join(totals, by).join(classes, [by, "label"]).join(groups, [by, "cluster"])
    share = F.col("n") / F.col("total")
    mixed = inside.groupBy(by).agg(
        F.sum(-share * F.log(F.col("n") / F.col("n_cluster"))).alias("h_c_given_k"),
        F.sum(-share * F.log(F.col("n") / F.col("n_class"))).alias("h_k_given_c"),
    )
    all_h = h_class.join(h_group, by).join(mixed, by)
    ratio = lambda given, whole: F.when(F.col(whole) == 0, F.lit(1.0)).otherwise(1.0 - F.col(given) / F.col(whole))
    scored = all_h.select(by, ratio("h_c_given_k", "h_c").alias("homogeneity"), ratio("h_k_given_c", "h_k").alias("completeness"))
    both = F.col("homogeneity") + F.col("completeness")
    value = F.when(both == 0, F.lit(0.0)).otherwise(2.0 * F.col("homogeneity") * F.col("completeness") / both)
    return scored.withColumn("v_measure", value)


def v_measure_summary(per_set: DataFrame) -> DataFrame:
    return per_set.agg(F.avg("v_measure").alias("v_mean"), F.stddev_pop("v_measure").alias("v_std"), F.count(F.lit(1)).alias("sets"))


def _agreement(predictions: Column, labels: Column) -> tuple[Column, Column]:
    """Equal and counted places of two arrays, leaving out ignored labels; per row, without a shuffle."""
    pairs = F.filter(F.arrays_zip(predictions.alias("p"), labels.alias("l")), lambda z: z["l"] != IGNORED)
    return F.size(F.filter(pairs, lambda z: z["p"] == z["l"])), F.size(pairs)


def _ratio_of(df: DataFrame, predictions: Column, labels: Column, name: str) -> DataFrame:
    work = df.select(predictions.alias("p"), labels.alias("l"))
    equal, counted = _agreement(F.col("p"), F.col("l"))
    sums = work.select(equal.alias("e"), counted.alias("c")).agg(F.sum("e").alias("e"), F.sum("c").alias("c"))
    return sums.select((F.col("e") / F.col("c")).alias(name), F.col("c").alias("places"))


def shifted_accuracy(df: DataFrame, predictions: str = "predictions", labels: str = "labels") -> DataFrame:
    """Share of places where the prediction of a token equals the label of the next one."""
    ahead = F.slice(F.col(predictions), F.lit(1), F.greatest(F.size(predictions) - 1, F.lit(0)))
    later = F.slice(F.col(labels), F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    return _ratio_of(df, ahead, later, "accuracy")


def tag_precision(df: DataFrame, predictions: str = "predictions", labels: str = "labels") -> DataFrame:
    """Micro precision over places with a label."""
    return _ratio_of(df, F.col(predictions), F.col(labels), "precision")


def entity_report(
    df: DataFrame, predicted: str = "predicted", actual: str = "actual", ignored: str | None = "-100"
) -> DataFrame:
    """Precision, recall and F1 of exact entity spans, and token accuracy; spans are found per row.

    Places whose actual label is `ignored` are taken out first, with what is predicted there.

    Spans are compared as strings: arrays of structs are intersected pair by pair, arrays of strings by hash.
    """
    if ignored is not None:
        pairs = F.arrays_zip(F.col(predicted).alias("p"), F.col(actual).alias("a"))
        left = F.filter(pairs, lambda z: ~z["a"].eqNullSafe(F.lit(ignored)))
        only = lambda name, side: F.when(F.array_contains(actual, ignored), F.transform(left, lambda z: z[side])).otherwise(F.col(name))
        df = df.select(only(predicted, "p").alias(predicted), only(actual, "a").alias(actual))
    keys = lambda tags: F.transform(tx.bio_spans(F.col(tags)), lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["kind"]))
    spans = df.select(
        keys(predicted).alias("ps"),
        keys(actual).alias("as"),
        F.size(F.filter(F.arrays_zip(F.col(predicted).alias("p"), F.col(actual).alias("a")), lambda z: z["p"] == z["a"])).alias("same"),
        F.size(actual).alias("n"),
    )
    sums = spans.agg(
        F.sum(F.size(F.array_intersect("ps", "as"))).alias("hit"),
        F.sum(F.size("ps")).alias("found"),
        F.sum(F.size("as")).alias("true"),
        F.sum("same").alias("same"),
        F.sum("n").alias("n"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    rates = sums.select("*", share("hit", "found").alias("precision"), share("hit", "true").alias("recall"))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2.0 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))
    return rates.select("precision", "recall", f1.alias("f1"), share("same", "n").alias("accuracy"), F.col("true").alias("entities"))


def pool_vectors(vectors: DataFrame, how: str = "mean", skip: str | None = None) -> DataFrame:
    """Token vectors (id, pos, vec) to one vector per id: mean, weighted_mean, last or first (bos).

    `skip` names a column with the number of leading instruction tokens to leave out. Means are summed before
    the shuffle, so a very long text is not one task.
    """
    kept = vectors if skip is None else vectors.where(F.col("pos") >= F.col(skip))
    if how in ("last", "eos", "first", "bos"):
        pick = F.max_by if how in ("last", "eos") else F.min_by
        return kept.groupBy("id").agg(pick("vec", "pos").alias("embedding"))
    if how == "mean":
        weight = F.lit(1.0)
    elif how == "weighted_mean":
        weight = (F.col("pos") - (F.col(skip) if skip else F.lit(0)) + 1).cast("double")
    else:
        raise ValueError(f"unknown pooling {how}")
    rows = kept.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("_v"), weight.alias("_w"))
    means = rows.groupBy("id").agg(Summarizer.mean(F.col("_v"), F.col("_w")).alias("_m"))
    return means.select("id", vector_to_array("_m").alias("embedding"))


def size_report(postings: DataFrame, bytes_per_weight: int = 4) -> DataFrame:
    """Rows, terms per row, and bytes of an encoded corpus."""
    per_row = postings.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.octet_length("term")).alias("term_bytes"))
    size = F.col("terms") * bytes_per_weight + F.col("term_bytes")
    return per_row.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("terms").alias("terms_per_row"),
        F.max("terms").alias("max_terms"),
        F.avg(size).alias("bytes_per_row"),
        F.sum(size).alias("total_bytes"),
    )


SKETCH_K = 4096


def size_sketches(postings: DataFrame, by: list[str] | None = None, bytes_per_weight: int = 4, k: int = SKETCH_K) -> DataFrame:
    """Per group of `by` columns (per corpus without): rows, sums and mergeable quantile sketches of terms and bytes per row.

    A sketch of `k` values holds up to that many rows exactly; beyond, a quantile's rank is off by about 2.3 / k^0.9, which
    is 0.13 % for 4096, with 99 % certainty. Its size does not grow with the rows.
    """
    keys = by or []
    per_row = postings.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.octet_length("term")).alias("term_bytes"))
    sized = per_row.withColumn("bytes", F.col("terms") * bytes_per_weight + F.col("term_bytes"))
    return sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("terms").alias("terms"),
        F.sum("bytes").alias("bytes"),
        F.kll_sketch_agg_bigint("terms", k).alias("terms_sketch"),
        F.kll_sketch_agg_bigint("bytes", k).alias("bytes_sketch"),
    )


def merged_sizes(sketches: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """The rows of several groups, shards or earlier runs as one; no posting is read again."""
    sums = [F.sum(c).alias(c) for c in ("rows", "terms", "bytes")]
    merged = [F.kll_merge_agg_bigint(c, k).alias(c) for c in ("terms_sketch", "bytes_sketch")]
    return sketches.agg(*sums, *merged)


def size_quantiles(merged: DataFrame, documents: int | None = None, points: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """rows, terms and bytes per row at each point (terms_p50, ...), and the memory of `documents` rows of this kind.

    `projected_bytes` takes the mean row for each; `projected_high_bytes` the row at the last point, which a corpus of
    long documents may come to. Without a number of documents they tell of the rows there are.
    """
    name = lambda what, p: f"{what}_p{p * 100:g}".replace(".", "_")
    at = lambda what, p: F.kll_sketch_get_quantile_bigint(f"{what}_sketch", F.lit(float(p))).alias(name(what, p))
    rows = F.col("rows") if documents is None else F.lit(documents).cast("long")
    high = F.kll_sketch_get_quantile_bigint("bytes_sketch", F.lit(float(points[-1])))
    return merged.where("rows > 0").select(
        "rows",
        *[at(what, p) for what in ("terms", "bytes") for p in points],
        F.ceil(F.col("bytes") / F.col("rows") * rows).cast("long").alias("projected_bytes"),
        (high * rows).cast("long").alias("projected_high_bytes"),
    )


MINI_BATCH = 100_000
BATCH_FILE_ROWS = 12_500


def minibatch_centers(
    vectors: DataFrame, clusters: int, batch_rows: int = MINI_BATCH, epochs: int = 3, seed: int = 7, first_rows: int = 10_000
) -> np.ndarray:
    """Centres by mini-batch k-means over (id, embedding), in the order of their batches by the hash of the id.

    The first centres are drawn from at most `first_rows` vectors, each by its squared distance from those before it. A
    batch assigns its vectors to their nearest centres, and moves each centre to them by one over the vectors that it
    has had so far. Batches are folders of one table, so each job reads its batch alone; what comes back from a job is
    sums per centre. A centre that stays without vectors keeps its place. The result does not depend on partitions.
    """
    rows = vectors.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("embedding").isNotNull())
    spark, n = vectors.sparkSession, rows.count()
    batches = max(1, math.ceil(n / batch_rows))
    path = fresh_path(spark, "batches")
    deal = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(batches)).cast("int")
    files = min(8, math.ceil(batch_rows / BATCH_FILE_ROWS))
    rows.withColumn("batch", deal).repartition("batch", F.pmod(F.xxhash64("id"), F.lit(files))).write.partitionBy("batch").parquet(path)
    stored = spark.read.schema("id string, embedding array<double>, batch int").parquet(path)
    drawn = stored.where("batch = 0").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(first_rows).toPandas()
    if not len(drawn):
        return np.zeros((0, 0))
    centers = _spread_centers(np.stack(drawn["embedding"].to_list()), clusters, seed)
    seen = np.zeros(len(centers))
    for step in range(epochs * batches):
        batch = stored.where(F.col("batch") == step % batches)
        sums, counts = _nearest_sums(batch, centers)
        seen += counts
        moved = counts > 0
        centers[moved] += (sums[moved] - counts[moved, None] * centers[moved]) / seen[moved, None]
    return centers


def _spread_centers(vectors: np.ndarray, clusters: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    chosen = [vectors[rng.integers(len(vectors))]]
    distance = ((vectors - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < min(clusters, len(vectors)):
        total = distance.sum()
        at = rng.choice(len(vectors), p=distance / total) if total > 0 else rng.integers(len(vectors))
        chosen.append(vectors[at])
        distance = np.minimum(distance, ((vectors - vectors[at]) ** 2).sum(axis=1))
    return np.array(chosen)


def _nearest_sums(rows: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the vectors that are nearest to each centre. Sums are of whole multiples of 2^-40, so that
    their order does not matter."""
    k, dim = centers.shape
    unit = 2.0**40

    def assign(batches):
        sums, counts = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                matrix = batch.column(0).flatten().to_numpy().reshape(-1, dim)
                near = ((centers**2).sum(axis=1)[None, :] - 2 * matrix @ centers.T).argmin(axis=1)
                whole = np.rint(matrix * unit).astype(np.int64)
                for c in np.unique(near):
                    sums[c] += whole[near == c].sum(axis=0).astype(object)
                    counts[c] += int((near == c).sum())
        held = np.flatnonzero(counts)
        values = pa.array([[Decimal(int(v)) for v in sums[c]] for c in held], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held]), values], ["c", "n", "s"])

    parts = rows.select("embedding").mapInArrow(assign, "c long, n long, s array<decimal(38,0)>")
    # A batch is a few files, so a job is one stage: each task's sums come here.
    totals, counts = np.zeros((k, dim), object), np.zeros(k)
    for row in parts.collect():
        counts[row["c"]] += row["n"]
        totals[row["c"]] += np.array([int(v) for v in row["s"]], object)
    return (totals / unit).astype(float), counts


def assigned(df: DataFrame, centers: np.ndarray) -> DataFrame:
    """Adds `cluster`, the nearest centre, and `cost`, the squared distance from it."""
    points = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])
    apart = lambda c: F.aggregate(
        F.zip_with("embedding", c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x
    )
    near = F.array_min(F.transform(points, lambda c, i: F.struct(apart(c).alias("cost"), i.alias("cluster"))))
    return df.withColumn("_near", near).withColumn("cluster", F.col("_near.cluster")).withColumn("cost", F.col("_near.cost")).drop("_near")
