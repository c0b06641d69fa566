"""Column functions over ARRAY<FLOAT> vectors, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.text import let


def steady(score: Column, digits: int = 9) -> Column:
    """Score to a fixed number of digits, so that ties do not depend on the order of a float sum."""
    unit = float(10**digits)
    return F.rint(score * F.lit(unit)) / F.lit(unit)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    scaled = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return let(norm(a), scaled)
