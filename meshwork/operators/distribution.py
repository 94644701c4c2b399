"""Degree distributions as (range_start bigint, percentage double) tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.graph import Graph
from meshwork.operators.topology import degree


def degree_distribution(graph: Graph, step: int = 10) -> DataFrame:
    """Share of vertices by degree range; ranges without vertices are left out; step 0 gives none."""
    if step <= 0:
        return graph.spark.createDataFrame([], "range_start long, percentage double")
    counts = degree(graph).groupBy(F.expr(f"degree div {step} * {step}").alias("range_start")).agg(F.count(F.lit(1)).alias("c"))
    # the number of vertices is the sum of the few counts
    total = counts.agg(F.sum("c").alias("n")).withColumn("k", F.lit(1))
    return counts.withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select("range_start", (F.col("c") / F.col("n") * 100.0).alias("percentage"))


def normalize(dist: DataFrame) -> DataFrame:
    """Percentages that sum up to 100."""
    total = dist.agg(F.sum("percentage").alias("t")).withColumn("k", F.lit(1))
    return dist.withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select("range_start", (F.col("percentage") / F.col("t") * 100.0).alias("percentage"))


def resample(dist: DataFrame, from_step: int, to_step: int) -> DataFrame:
    """The distribution on ranges of another width, shared out by overlap; shares of 0 go."""
    if from_step == to_step:
        return dist.where("percentage > 0")
    if to_step > from_step and to_step % from_step == 0:
        moved = dist.select(F.expr(f"range_start div {to_step} * {to_step}").alias("range_start"), "percentage")
    else:
        a, b = F.col("range_start"), F.col("range_start") + from_step
        first, last = F.expr(f"range_start div {to_step}"), F.expr(f"(range_start + {from_step - 1}) div {to_step}")
        cells = dist.withColumn("cell", F.explode(F.sequence(first, last)))
        low, high = F.greatest(a, F.col("cell") * to_step), F.least(b, (F.col("cell") + 1) * to_step)
        moved = cells.select((F.col("cell") * to_step).alias("range_start"), (F.col("percentage") * (high - low) / F.lit(float(from_step))).alias("percentage"))
    return moved.groupBy("range_start").agg(F.sum("percentage").alias("percentage")).where("percentage > 0")


def kl_table(p: DataFrame, q: DataFrame, step_p: int = 10, step_q: int = 10, epsilon: float = 1e-10) -> DataFrame:
    """One row: sum of p ln(p / q) over the union of ranges, a missing share being epsilon; null if one is empty."""
    step = min(step_p, step_q)
    a, b = (resample(normalize(d), s, step) for d, s in ((p, step_p), (q, step_q)))
    both = a.withColumnRenamed("percentage", "p").join(b.withColumnRenamed("percentage", "q"), "range_start", "full_outer")
    x, y = (F.greatest(F.coalesce(F.col(c) / 100.0, F.lit(epsilon)), F.lit(epsilon)) for c in ("p", "q"))
    sums = both.agg(F.sum(x * F.log(x / y)).alias("kl"), F.count("p").alias("np"), F.count("q").alias("nq"))
    return sums.select(F.when((F.col("np") > 0) & (F.col("nq") > 0), F.col("kl")).alias("kl"))


def kl_divergence(p: DataFrame, q: DataFrame, step_p: int = 10, step_q: int = 10, epsilon: float = 1e-10) -> float:
    value = kl_table(p, q, step_p, step_q, epsilon).first()[0]
    return math.inf if value is None else value


def symmetric_kl_divergence(p: DataFrame, q: DataFrame, step_p: int = 10, step_q: int = 10, epsilon: float = 1e-10) -> float:
    return (kl_divergence(p, q, step_p, step_q, epsilon) + kl_divergence(q, p, step_q, step_p, epsilon)) / 2
