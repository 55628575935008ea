"""Column functions on array vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products of two arrays of one length; null where either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; null where one has length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def inverse_distance(squared: Column) -> Column:
    """1 / Euclidean distance; infinite at distance 0."""
    return F.when(squared > 0, 1.0 / F.sqrt(squared)).otherwise(F.lit(float("inf")))


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)
