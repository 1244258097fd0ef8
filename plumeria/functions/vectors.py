"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; the zero vector stays."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; 0 where either vector is missing or zero."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def parsed(text: Column) -> Column:
    """A vector from its text ``[0.1,...]``."""
    return F.from_json(text, "array<double>")


def element_sums(vector: Column, size: int, weight: Column) -> list[Column]:
    """One sum for each element: a weighted vector sum as plain aggregates, combined before the shuffle."""
    return [F.sum(F.get(vector, F.lit(i)).cast("double") * weight).alias(f"e{i}") for i in range(size)]


def gathered(size: int) -> Column:
    return F.array(*[F.col(f"e{i}") for i in range(size)])
