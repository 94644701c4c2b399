"""Exact global ranks and running sums without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.runtime import materialise

#: Rows of a range that is ranked by one task, about.
RANGE_ROWS = 200_000


def ranged(df: DataFrame, order: list) -> tuple[DataFrame, int]:
    """``df`` written in the order of ``order``, with __part and __at, the row's range and its place there; the number of ranges.

    Ranges are cut at sampled quantiles of the whole order, not of its first
    column alone, so rows that are equal there (the vertices of one degree, the
    edges of one source) are dealt out by what tells them apart next. Only rows
    equal in all of ``order`` share a range; their places are arbitrary.
    """
    parts = max(1, -(-df.count() // RANGE_ROWS))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    written = materialise(dealt.withColumn("__m", F.monotonically_increasing_id()), "ranged")
    # the number that Spark gives a row has the partition above bit 33
    return written.withColumn("__part", F.shiftright("__m", 33)).withColumn("__at", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m"), parts


def _before(rows: DataFrame, value, name: str) -> DataFrame:
    """(__part, name): the sum of ``value`` over the ranges before each, one row a range."""
    sums = rows.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias(name))


def rank_rows(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``df`` with the rank from 0 in the order of ``order``. ``df`` should be cheap to read again."""
    rows, parts = ranged(df, order)
    if parts == 1:
        return rows.withColumn(name, F.col("__at")).drop("__part", "__at")
    return rows.join(F.broadcast(_before(rows, F.lit(1), "__before")), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def running(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before this one, a range at a time."""
    rows, parts = ranged(df, order)
    inner = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    if parts == 1:
        return rows.withColumn(name, F.col("__in")).drop("__part", "__at", "__in")
    return rows.join(F.broadcast(_before(rows, F.col(value), "__before")), "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__at", "__in", "__before")


def cumulative(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to and with this one."""
    return running(df, order, value, name).withColumn(name, F.col(name) + F.col(value))
