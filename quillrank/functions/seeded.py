"""Seeded order without a random generator, equal on every retry and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int, *cols: Column) -> Column:
    """A whole number of 60 bits from the MD5 of seed and key columns, joined by colons: any engine can draw the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def seeded_shuffle(items: Column, seed: int, *cols: Column) -> Column:
    """The array in an order drawn from the seed, the row's key columns and each item's place."""
    keyed = F.transform(
        items, lambda x, i: F.struct(seeded_key(seed, *cols, i).alias("k"), i.alias("i"), x.alias("v"))
    )
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def seeded_unit(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) drawn from the seed and the key columns."""
    return F.pmod(seeded_key(seed, *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))
