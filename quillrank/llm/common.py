"""What several operators share: texts in batches, vectors that can be compared, and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.session import settled

BATCH_CHARS = 2_000_000


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns as `id` and `text`; a null text is empty, other columns go."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_groups(batches: Iterable[pa.RecordBatch], chars: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about `chars` characters: a bound on what a task holds, whatever the length of the texts."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            ids.append(key)
            texts.append(text)
            held += len(text)
            if held >= chars or len(ids) >= 10_000:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def drawn(df: DataFrame, n: int, *by: str) -> DataFrame:
    """`n` rows at most, those with the smallest hash of the `by` columns; of rows with equal ones, any.

    Rows are counted first and cut by a bound on the hash, so that about `n` rows reach the one task that takes them,
    however many partitions there are.
    """
    rows = df.count()
    if rows > n:
        bound = -(1 << 63) + int((n + 6 * n**0.5 + 100) / rows * (1 << 64))
        df = df.where(F.xxhash64(*by) <= F.lit(min(bound, (1 << 63) - 1)))
    return df.orderBy(F.xxhash64(*by), *by).limit(n)


def usable(vector: str):
    """Vectors that can be compared: not null, not empty, every component a finite number, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of an edge list (a, b): component is the smallest node reachable, by alternating stars.

    Each round points every node's larger neighbours at its smallest one, then its smaller ones; the number of
    rounds grows with the logarithm of the longest path. A hot node costs one partial minimum per task and a
    join whose large side can be split. Self loops and rows with a null are left out.
    """
    pairs = edges.where(F.col("a") != F.col("b"))
    pairs = pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs, before = settled(pairs, name), None
    while True:
        seen = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                pairs.select(F.col("lo"), F.col("lo")).distinct()
            )
        before = seen
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = settled(large.distinct(), name)
        roots = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(roots, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = settled(moved.union(roots.select("hi", F.col("m").alias("lo"))).distinct(), name)
