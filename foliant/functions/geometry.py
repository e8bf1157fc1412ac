"""Boxes as arrays [x0, y0, x1, y1] of doubles, origin at the top left; all are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def clipped(b: Column, width: Column, height: Column) -> Column:
    inside = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    return F.array(inside(b[0], width), inside(b[1], height), inside(b[2], width), inside(b[3], height))


def rounded(b: Column) -> Column:
    """To a tenth, halves to even."""
    return F.transform(b, lambda x: F.bround(x, 1))


def contains(outer: Column, inner: Column, tolerance: float = 2.0) -> Column:
    return (inner[0] >= outer[0] - tolerance) & (inner[1] >= outer[1] - tolerance) & (inner[2] <= outer[2] + tolerance) & (inner[3] <= outer[3] + tolerance)


def union(a: Column, b: Column) -> Column:
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def overlap(a: Column, b: Column) -> Column:
    return F.array(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def covered_share(a: Column, b: Column) -> Column:
    """How much of a lies in b; 0 for a box without area."""
    return F.when(area(a) > 0, area(overlap(a, b)) / area(a)).otherwise(0.0)
