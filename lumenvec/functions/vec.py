"""Vector expressions on array columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mse(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def softmax(a: Column) -> Column:
    shifted = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(shifted, lambda x: x / total(shifted))


def matvec(rows: list[list[float]], a: Column) -> Column:
    """A fixed matrix times the vector, as literals: for small dimensions."""
    return F.array(*[dot(F.array(*map(F.lit, row)), a) for row in rows])
