"""What each of several text filters removes, in every order of applying them, and its Shapley share.

Documents are counted by part and by the set of filters they fail. From these counts the removals of every coalition of
filters are tabulated: v(S) is the number of documents that fail a filter of S. What a filter removes after those of S
is v(S + filter) - v(S), which gives all steps of all orders. The Shapley values are the solution of least squares over
the coalitions, weighted with the Shapley kernel, under the condition that they add up to v(all): its normal equations
are solved once in fractions, and the integers that come out are applied to each part.

Defined results: a null text is empty, a null part is the empty string. Words are maximal runs without white space. Of
equal texts all but those of the smallest id fail the copy filter; a row without id is no copy of any and none of it.
A document's label counts once, however many label rows say it; labels of unknown documents count nowhere. Repeated rows
count each. An empty table gives no rows. Other columns are left out, whatever they are called.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence
from fractions import Fraction
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The filters' limits.
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
MARKS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
COPY = "E"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides by itself, by letter."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    count = lambda found: F.size(found).cast("long")
    return {
        "A": count(words) < LEAST_WORDS,
        "B": 100 * count(F.array_distinct(words)) < DISTINCT_PERCENT * count(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> tuple[DataFrame, str]:
    """(part, mask, n, good, toxic), and the filters' letters; bit i of the mask stands for failing the filter of letter i."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(part_col, F.lit("")).alias("part"))
    failing = text_failures(F.col("text"))
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failing.values())), F.lit(0))
    rows = rows.select("id", "part", mask.alias("mask"), F.sha2("text", 256).alias("text"))
    rows = rows.groupBy("id", "part", "mask", "text").agg(F.count(F.lit(1)).alias("n"))
    yes = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(yes("quality"), yes("toxic"))
    rows = rows.join(marks, "id", "left").na.fill(False, ["quality", "toxic"])
    # Of a text, a part and a label only the smallest id can be the first one.
    alike = rows.groupBy("text", "part", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("id").alias("first"),
        F.min_by("n", "id").alias("n_first"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    )
    smallest = alike.groupBy("text").agg(F.min("first").alias("smallest"))
    alike = alike.join(smallest, "text")
    single = F.col("n_null") + F.when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0)
    bit = 1 << len(failing)
    split = F.explode(
        F.array(
            F.struct(F.col("mask").alias("mask"), single.alias("n")),
            F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - single).alias("n")),
        )
    ).alias("x")
    each = alike.select("part", "quality", "toxic", split).where("x.n > 0")
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("x.n"))), F.lit(0))
    counts = each.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), total(F.col("quality")).alias("good"), total(F.col("toxic")).alias("toxic")
    )
    return counts, "".join(failing) + COPY


def removals(counts: Sequence[int], filters: int) -> list[int]:
    """v(S) for every set of filters, from the counts by the exact set that fails: all but those that fail none of S."""
    within = list(counts)
    for bit in range(filters):
        for s in range(1 << filters):
            if s >> bit & 1:
                within[s] += within[s ^ (1 << bit)]
    everything = (1 << filters) - 1
    return [within[everything] - within[everything ^ s] for s in range(1 << filters)]


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X with matrix X = right, by elimination in fractions."""
    rows = [[*a, *b] for a, b in zip(matrix, right)]
    n = len(rows)
    for i in range(n):
        pivot = next(j for j in range(i, n) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(n):
            if j != i and rows[j][i]:
                times = rows[j][i]
                rows[j] = [x - times * y for x, y in zip(rows[j], rows[i])]
    return [row[n:] for row in rows]


def shapley_weights(filters: int) -> list[list[int]]:
    """For each filter the whole number that each v(S) counts with in its Shapley value times the number of orders.

    Least squares over all coalitions but the empty and the full one, with weight (m - 1) / (C(m, s) s (m - s)), under
    the condition that the values add up to v(all). The condition's multiplier is the last unknown.
    """
    m, full = filters, (1 << filters) - 1
    if m == 1:
        return [[0, 1]]
    weight = [Fraction(0)] * (full + 1)
    for s in range(1, full):
        k = s.bit_count()
        weight[s] = Fraction(m - 1, comb(m, k) * k * (m - k))
    inside = lambda i, s: s >> i & 1
    normal = [[sum((weight[s] for s in range(full + 1) if inside(i, s) and inside(j, s)), Fraction(0)) for j in range(m)] for i in range(m)]
    system = [[*row, Fraction(1)] for row in normal] + [[*[Fraction(1)] * m, Fraction(0)]]
    right = [[weight[s] * inside(i, s) for s in range(full + 1)] for i in range(m)]
    right.append([Fraction(s == full) for s in range(full + 1)])
    times = [[x * factorial(m) for x in row] for row in solve(system, right)[:m]]
    assert all(x.denominator == 1 for row in times for x in row)
    return [[int(x) for x in row] for row in times]


def _steps(letters: str, weights: list[list[int]]):
    """mapInArrow: (part, counts by mask) to one row per order and step."""
    m = len(letters)
    orders = list(itertools.permutations(range(m)))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    order_names = [("".join(letters[i] for i in order), order) for order in orders]
    full = (1 << m) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tables = []
                for what in ("n", "good", "toxic"):
                    counts = [0] * (full + 1)
                    for c in cells:
                        counts[c["mask"]] += c[what]
                    tables.append((sum(counts), removals(counts, m)))
                (total, v), (_, good), (_, toxic) = tables
                shares = [sum(w * x for w, x in zip(row, v)) for row in weights]
                out = []
                for name, order in order_names:
                    before = 0
                    for step, i in enumerate(order, 1):
                        now = before | 1 << i
                        gone = v[now] - v[before]
                        out.append(
                            (
                                part,
                                name,
                                step,
                                total - v[now],
                                gone,
                                v[1 << i] - gone,
                                v[full] - v[full ^ 1 << i],
                                good[now] - good[before],
                                toxic[now] - toxic[before],
                                shares[i],
                            )
                        )
                        before = now
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return run


def interaction_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row per part, filter order and step, with the counts within the part."""
    counts, letters = failure_counts(docs, labels, id_col, text_col, part_col)
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    longs = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return cells.mapInArrow(_steps(letters, shapley_weights(len(letters))), f"part string, filter_order string, step int, {longs}")
