"""Packing by length: bucket bounds that waste the least padding, and batches of a token budget within each bucket.

Lengths are counted in one distributed histogram. A dynamic programme over it finds the bounds with which the whole
corpus, each text padded to its bucket's bound, holds the fewest padding tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.session import settled

BUCKETS = 16
TOKEN_BUDGET = 16_384
#: Up to here each length has its own bin. Beyond, a bin is at most 1/1024 of its length wide, so there are at most
#: 16,384 + 1,024 per doubling of length: the histogram has a fixed size.
EXACT_LENGTHS = 16_384
SHARD_ROWS = 2_000


def word_count(text: str) -> Column:
    """Words, as runs of anything but ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def bin_of(length: Column) -> Column:
    """The smallest length of a length's bin."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double") / EXACT_LENGTHS)) + 4).cast("long")
    return F.when(length < EXACT_LENGTHS, length).otherwise(F.floor(length / step).cast("long") * step)


def best_bounds(histogram: Sequence[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padding.

    `histogram` has (largest length, texts, tokens) per bin, by length. With C and S the running texts and tokens, bins
    i+1..j in one bucket cost length_j * (C_j - C_i) - (S_j - S_i). For a fixed number of buckets the best start of
    the last one is the lowest of the lines with slope -C_i at length_j; slopes fall and lengths rise, so the lines
    are kept as a hull and each step costs a constant time. Ties go to fewer buckets.
    """
    sizes = [h[0] for h in histogram]
    n = len(sizes)
    if not n:
        return []
    texts, tokens = [0], [0]
    for _, c, s in histogram:
        texts.append(texts[-1] + c)
        tokens.append(tokens[-1] + s)
    cost = [0] + [sizes[j - 1] * texts[j] - tokens[j] for j in range(1, n + 1)]
    came = [[0] * (n + 1)]
    best, choice = cost[n], 1
    for k in range(2, min(buckets, n) + 1):
        hull: list[tuple[int, int, int]] = []  # slope, height, start
        head, new, back = 0, [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            slope, height = -texts[j - 1], cost[j - 1] + tokens[j - 1]
            if j - 1 >= k - 1:
                while len(hull) - head >= 2:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (height - b1) * (m1 - m2) <= (b2 - b1) * (m1 - slope):
                        hull.pop()
                    else:
                        break
                hull.append((slope, height, j - 1))
            if not hull:
                new[j], back[j] = cost[j], came[-1][j]
                continue
            x = sizes[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            slope, height, start = hull[head]
            new[j], back[j] = slope * x + height + x * texts[j] - tokens[j], start
        came.append(back)
        cost = new
        if cost[n] < best:
            best, choice = cost[n], k
    bounds, end = [], n
    for k in range(choice - 1, -1, -1):
        bounds.append(sizes[end - 1])
        end = came[k][end]
    return sorted(set(bounds))


def pack(
    lengths: DataFrame,
    id_col: str = "doc_id",
    length_col: str = "n_tokens",
    buckets: int = BUCKETS,
    budget: int = TOKEN_BUDGET,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(id, length, bucket, bound, batch, slot, padding) of every row.

    A bucket holds lengths up to its bound; a batch holds budget // bound of its rows, at least one: a text longer
    than the budget is a batch by itself, whole. All batches of a bucket are full but for the last. `batch` counts
    from 0 within the bucket, `slot` within the batch. Rows are numbered by the hash of their id, then id and length; rows
    that repeat get numbers next to each other. A null or negative length counts as 0 and lands in the lowest bucket;
    null ids are packed like others; an empty table gives no rows. Only the two named columns are read.

    A bucket is numbered in shards of about `shard_rows` rows, by hash, and the numbers of a shard start where those
    of the shards before it end: no task sorts a whole bucket. What reaches the driver is the histogram, whose size
    is bounded, see EXACT_LENGTHS.
    """
    length = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    rows = settled(lengths.select(F.col(id_col).alias("id"), length.alias("length")), "lengths")
    bins = rows.groupBy(bin_of(F.col("length")).alias("bin")).agg(
        F.max("length").alias("most"), F.count(F.lit(1)).alias("texts"), F.sum("length").alias("tokens")
    )
    histogram = sorted((r["most"], r["texts"], r["tokens"]) for r in bins.collect())
    bounds = best_bounds(histogram, buckets)
    counts = [sum(c for most, c, _ in histogram if low < most <= high) for low, high in zip([-1, *bounds], bounds)]
    shards = [max(1, -(-c // shard_rows)) for c in counts]
    if not bounds:
        bounds, shards = [0], [1]
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)
    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("length")))
    dealt = rows.withColumn("bucket", bucket).withColumn("bound", pick(bounds))
    # The shard of a row is a range of its hash, so shards in order are rows in the order of their hashes.
    spread = F.xxhash64("id", "length")
    unit = F.shiftrightunsigned(spread, 33)
    dealt = dealt.withColumn("hash", spread).withColumn("shard", F.floor(unit * pick(shards) / F.lit(float(1 << 31))))
    sizes = dealt.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket", "shard").orderBy("hash", "id", "length")
    numbered = dealt.withColumn("nth", F.row_number().over(within) - 1).join(offsets, ["bucket", "shard"])
    per_batch = F.greatest(F.floor(F.lit(budget) / F.greatest("bound", F.lit(1))), F.lit(1))
    nth = (F.col("nth") + F.col("offset")).cast("long")
    return numbered.select(
        F.col("id").alias(id_col),
        F.col("length").alias(length_col),
        "bucket",
        "bound",
        F.floor(nth / per_batch).cast("long").alias("batch"),
        F.pmod(nth, per_batch).cast("long").alias("slot"),
        (F.col("bound") - F.col("length")).alias("padding"),
    )
