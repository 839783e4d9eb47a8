"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector by its length; a zero vector stays as it is."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Null where one of both is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def mean_pool(vectors: Column, size: int) -> Column:
    """The mean of an array of vectors of ``size`` numbers; null if there is none."""
    zero = F.array_repeat(F.lit(0.0), size)
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors)))
