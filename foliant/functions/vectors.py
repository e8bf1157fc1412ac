"""Vectors as arrays; arithmetic in double precision, in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def truncated(v: Column, n: int) -> Column:
    """The first n components, scaled to length one; unscaled if they are all zero."""
    head = F.slice(doubles(v), 1, n)
    size = norm(head)
    return F.transform(head, lambda x: F.coalesce(F.try_divide(x, size), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
