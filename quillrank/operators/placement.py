"""Joins, top-k and running totals that hold when one key has a large share of all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.text import let
from quillrank.session import settled

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1024
HOT_ROWS = 1_000_000
SALTS = 32
RANGE_ROWS = 1_000_000
MAX_RANGES = 16_384
FANOUT = 128
ONE_RANGE_ROWS = 5_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Counts rows and bytes in one distributed aggregate: true if the frame is safe to broadcast.

    Meant for sides that should be small, such as queries and vocabularies. A corpus is never measured; its
    joins are shuffled.
    """
    width = F.coalesce(F.length(F.to_json(F.struct(*df.columns))), F.lit(0)).cast("long")
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes


def hot_keys(df: DataFrame, key: Sequence[str], hot_rows: int = HOT_ROWS, limit: int = HOT_KEYS) -> DataFrame:
    """The keys with most rows. Any key left out holds less than one part in `limit` of them."""
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") >= hot_rows)
        .orderBy(F.desc("_rows"), *key)
        .limit(limit)
        .select(*key, F.lit(True).alias("_hot"))
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str] | str,
    how: str = "inner",
    spread: Sequence[str] | None = None,
    *,
    right_fits: bool | None = None,
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join of a large left side, which may be hot on the key, with a smaller right side.

    A right side measured as small is broadcast. Otherwise both sides are shuffled, and the rows of hot left
    keys go to `salts` places each, chosen by the `spread` columns, with a copy of the right row at each place.
    `hot` lists hot keys that are known already. Kinds: inner, left, left_semi, left_anti.
    """
    key = [key] if isinstance(key, str) else list(key)
    if right_fits is None:
        right_fits = fits_broadcast(right)
    if right_fits:
        return left.join(F.broadcast(right), key, how)
    hot = hot_keys(left, key, hot_rows) if hot is None else hot.select(*key, F.lit(True).alias("_hot"))
    by = list(spread) if spread else [c for c in left.columns if c not in key] or key
    salted_left = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    )
    salted_right = right.join(F.broadcast(hot), key, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    joined = salted_left.drop("_hot").join(salted_right.drop("_hot"), key + ["_salt"], how)
    return joined.drop("_salt")


def attach(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    """Inner join of derived rows, such as a run, with a large table that is unique on the key, such as a corpus.

    The left side is settled first. Where it fits, it is broadcast and the large table is only scanned; where it
    does not, both are shuffled and hot keys of the left are spread.
    """
    left = settled(left, "rows")
    if fits_broadcast(left):
        return right.join(F.broadcast(left), key)
    return spread_join(left, right, key, "inner", spread, right_fits=False)


def top_k(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", spread: str | None = None
) -> DataFrame:
    """Best `k` rows per group with their rank from 1; `order` must be total.

    Up to the session's group-limit threshold Spark keeps k rows per group and task before the shuffle.
    Above it a first pass over salted groups does the same, so no task ever sorts a whole group.
    """
    final = Window.partitionBy(*group).orderBy(*order)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit and spread is not None:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
        local = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = salted.withColumn("_local", F.row_number().over(local)).where(F.col("_local") <= k)
        df = df.drop("_salt", "_local")
    return df.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k)


def _range_of(key: Column, bounds: list, types: list) -> Column:
    """How many of the sorted bounds are at or below the key, searched in two steps of FANOUT."""
    spark_values = [F.struct(*[F.lit(v).cast(t) for v, t in zip(b, types)]) for b in bounds]
    blocks = [spark_values[i : i + FANOUT] for i in range(0, len(spark_values), FANOUT)]
    heads = F.array(*[b[0] for b in blocks])
    block = F.size(F.filter(heads, lambda h: h <= key))
    inner = F.element_at(F.array(*[F.array(*b) for b in blocks]), F.greatest(block, F.lit(1)))
    within = F.size(F.filter(inner, lambda h: h <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * FANOUT + within)


def running_total(
    df: DataFrame,
    order: Sequence[str],
    value: Column | None = None,
    group: Sequence[str] = (),
    name: str = "ordinal",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Sum of `value` over the rows before each row, by the unique `order` columns, within `group`.

    With no value this is the row's place from 0. Rows are cut into key ranges, summed per range, and offset by
    the ranges before, so neither the whole table nor a hot group passes through one task. Range bounds come
    from a sample and are constants of the plan: a retried task finds the same ranges.
    """
    amount = F.lit(1).cast("long") if value is None else value
    rows = df.count()
    ranges = min(MAX_RANGES, math.ceil(rows / range_rows)) if rows else 1
    if rows > ONE_RANGE_ROWS:
        ranges = max(ranges, 4 * df.sparkSession.sparkContext.defaultParallelism)
    work = df.withColumn("_value", amount)
    before = lambda keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda keys: F.coalesce(F.sum("_value").over(before(keys)), F.lit(0))
    if ranges == 1:
        keys = list(group) or [F.lit(0)]
        return work.withColumn(name, summed(keys)).drop("_value")
    share = min(1.0, 20.0 * ranges / rows)
    sample = [tuple(r) for r in df.select(*order).sample(fraction=share, seed=11).orderBy(*order).collect()]
    step = max(1, len(sample) // ranges)
    bounds = list(dict.fromkeys(sample[step::step]))
    types = [df.schema[c].dataType for c in order]
    if bounds:
        work = work.withColumn("_range", let(F.struct(*order), lambda key: _range_of(key, bounds, types)))
    else:
        work = work.withColumn("_range", F.lit(0))
    keys = list(group) + ["_range"]
    totals = work.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*(list(group) or [F.lit(0)])).orderBy("_range")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    local = work.withColumn("_local", summed(keys))
    # A null group is a group like any other.
    marks = [f"_key{i}" for i in range(len(keys))]
    offsets = offsets.select(*[F.col(k).alias(m) for k, m in zip(keys, marks)], "_offset")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, marks)])
    out = local.join(offsets, same)
    return out.withColumn(name, F.col("_local") + F.col("_offset")).drop("_value", "_range", "_local", "_offset", *marks)
