"""Exact ranks over huge groups without a window over any whole group.

Rows are dealt to buckets by a number that is about uniform. A window ranks
the few rows of a bucket; the counts of the buckets before it, a small table,
give the offset. No task sees more than one bucket of one group, however large
the group is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket may hold on average, and the number of buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 2048


def bucket_count(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def ranked(df: DataFrame, groups: list[str], place: str, order: list[str], buckets: int, out: str) -> DataFrame:
    """Add ``out``: the rank from 0 within ``groups`` by ``place`` (in [0, 1)), then ``order``.

    ``df`` should be materialised, as it is read twice. ``groups`` may be empty.
    """
    cut = F.least(F.floor(F.col(place) * buckets), F.lit(buckets - 1)).cast("long")
    keyed = df.withColumn("__bucket", cut)
    counts = keyed.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*groups, "__bucket").orderBy(place, *order)
    ranks = keyed.withColumn("__rank", F.row_number().over(within) - 1)
    # the offsets are joined on the very columns by which the window has dealt the rows out
    return ranks.join(offsets, [*groups, "__bucket"]).withColumn(out, F.col("__before") + F.col("__rank")).drop("__bucket", "__before", "__rank")
