"""Sums and neighbours along an order of all rows, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order that are worked out apart.
RANGES = 200


def ranged(df: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """df with ``_range``: the number of the range of values that ``order`` falls into, by approximate quantiles."""
    edges = sorted(set(df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.001)))
    return df.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e <= F.col(order))) if edges else F.lit(0))


def running_total(df: DataFrame, order: list[str], value: str, out: str, ranges: int = RANGES) -> DataFrame:
    """df with ``out``: the sum of ``value`` up to and with each row, in ascending ``order``.

    order: columns that tell rows apart; the first is a double without nulls. Each range is summed by itself, and the
    ranges' totals, a row each, are added up.
    """
    dealt = ranged(df, order[0], ranges)
    base = dealt.groupBy("_range").agg(F.sum(value).alias("_total"))
    base = base.select("_range", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    local = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("_local", local).join(F.broadcast(base), "_range").withColumn(out, F.col("_local") + F.col("_base")).drop("_range", "_local", "_base")


def with_previous(df: DataFrame, order: str, out: str, ranges: int = RANGES) -> DataFrame:
    """df with ``out``: the next smaller value of ``order`` (distinct doubles), null for the least."""
    dealt = ranged(df, order, ranges)
    last = dealt.groupBy("_range").agg(F.max(order).alias("_most"))
    last = last.select("_range", F.max("_most").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inner = F.lag(order).over(Window.partitionBy("_range").orderBy(order))
    return dealt.withColumn(out, inner).join(F.broadcast(last), "_range").withColumn(out, F.coalesce(out, "_before")).drop("_range", "_before")
