"""Joins, top-k and running totals give the same rows on their large-data paths as on the plain ones."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillrank.operators import placement


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows have key 0."""
    ids = spark.range(900).withColumnRenamed("id", "v")
    return ids.withColumn("key", F.when(F.col("v") % 3 == 0, F.lit(0)).otherwise(F.col("v") % 50)).repartition(6)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, skewed, how):
    right = spark.range(0, 40, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("w"))
    plain = rows_of(skewed.join(right, "key", how))
    assert rows_of(placement.spread_join(skewed, right, "key", how)) == plain
    assert rows_of(placement.spread_join(skewed, right, "key", how, ["v"], right_fits=False, hot_rows=100, salts=4)) == plain


def test_spread_join_places_hot_rows_apart(skewed):
    hot = placement.hot_keys(skewed, ["key"], hot_rows=100)
    assert [r["key"] for r in hot.collect()] == [0]


def test_attach_equals_join(spark, skewed, monkeypatch):
    right = spark.range(60).select(F.col("id").alias("key"), (F.col("id") * 10).alias("w"))
    plain = rows_of(skewed.join(right, "key"))
    assert rows_of(placement.attach(skewed, right, "key", ["v"])) == plain
    monkeypatch.setattr(placement, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(placement, "HOT_ROWS", 100)
    assert rows_of(placement.attach(skewed, right, "key", ["v"])) == plain


def test_fits_broadcast_measures_rows_and_bytes(spark):
    rows = spark.range(100).select(F.col("id"), F.lit("x" * 100).alias("pad"))
    assert placement.fits_broadcast(rows)
    assert not placement.fits_broadcast(rows, max_rows=99)
    assert not placement.fits_broadcast(rows, max_bytes=1000)


@pytest.mark.parametrize("k", [3, 2000])
def test_top_k_is_exact_on_both_paths(spark, skewed, k):
    threshold = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    assert int(threshold) == 1000
    order = [F.desc(F.col("v") % 7), F.asc("v")]
    plain = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("rank") <= k)
    assert rows_of(placement.top_k(skewed, ["key"], order, k, spread="v")) == rows_of(plain)


def test_top_k_keeps_k_rows_per_task_before_the_shuffle(skewed, capsys):
    placement.top_k(skewed, ["key"], [F.desc("v")], 5).explain()
    plan = capsys.readouterr().out
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


@pytest.mark.parametrize("group", [[], ["key"]])
@pytest.mark.parametrize("order", [["v"], ["name"], ["name", "v"]])
@pytest.mark.parametrize("range_rows", [10, 10_000])
def test_running_total_equals_window(skewed, group, order, range_rows):
    df = skewed.withColumn("name", F.concat(F.lit("n"), F.col("v").cast("string")))
    over = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn("total", F.coalesce(F.sum(F.col("v") + 1).over(over), F.lit(0)))
    got = placement.running_total(df, order, F.col("v") + 1, group, "total", range_rows=range_rows)
    assert rows_of(got) == rows_of(plain)


def test_running_total_of_nothing(spark):
    assert placement.running_total(spark.range(0), ["id"]).count() == 0
