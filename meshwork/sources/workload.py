"""Update workloads: random edges, Zipf-shaped edges, replay."""

from __future__ import annotations

import math
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators.ordering import rank_rows
from meshwork.runtime import materialise

#: Draws of a source that are made together.
DRAWS = 10_000


def random_workload(spark: SparkSession, n: int, k: int, seed: int = 42) -> DataFrame:
    """(seq, src, dst): k different targets other than itself for each of n sources.

    A source's targets are an affine walk over the other vertices: a seeded
    start and one of the 64 smallest steps without common factor, picked by a
    hash of the source, so no draw repeats.
    """
    if k >= n:
        raise ValueError("fewer targets than vertices are needed")
    others = n - 1
    src = spark.range(n).select(F.col("id").alias("src"))
    steps = list(islice((s for s in range(1, others + 1) if math.gcd(s, others) == 1), 64)) or [1]
    step = F.get(F.array(*[F.lit(s) for s in steps]), F.pmod(F.xxhash64(F.lit(seed + 1), "src"), F.lit(len(steps))).cast("int"))
    start = F.pmod(F.xxhash64(F.lit(seed), "src"), F.lit(others))
    rows = src.select("src", start.alias("a"), step.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    target = F.pmod(F.col("a") + F.col("b").cast("long") * F.col("j"), F.lit(others))
    return rows.select((F.col("src") * k + F.col("j")).alias("seq"), "src", F.when(target >= F.col("src"), target + 1).otherwise(target).alias("dst"))


def zipf_counts(spark: SparkSession, sources: int, edges: int, alpha: float, cap: int = 0) -> DataFrame:
    """(rank, n): edges of the sources by rank: weights 1 / (rank + 1) ** alpha, at most ``cap`` each, ``edges`` in all.

    What exceeds the cap is shared out again among the others by weight. As
    weights fall with the rank, the capped sources are the first few: a handful
    of sums over the ranks finds how many. Fractions go to the largest
    remainders, the smallest rank of equal ones.
    """
    if not math.isfinite(alpha) or alpha < 0:
        raise ValueError("alpha must be finite and not negative")
    limit = cap or edges
    if sources * limit < edges:
        raise ValueError("the cap is too small to keep the edge count")
    ranks = spark.range(sources).select(F.col("id").alias("rank"), F.pow(F.col("id") + 1, F.lit(-float(alpha))).alias("w"))
    full = 0
    while True:
        total = ranks.where(F.col("rank") >= full).agg(F.sum("w")).first()[0] or 1.0
        share = F.col("w") / F.lit(total) * F.lit(float(edges - limit * full))
        more = ranks.where((F.col("rank") >= full) & (share > limit)).count() if full < sources else 0
        if not more:
            break
        full += more
    exact = F.when(F.col("rank") < full, F.lit(float(limit))).otherwise(share)
    floor = F.least(F.floor(exact + 1e-9), F.lit(limit)).cast("long")
    counts = materialise(ranks.select("rank", floor.alias("n"), (floor - exact).alias("short")), "counts")
    missing = edges - (counts.agg(F.sum("n")).first()[0] or 0)
    while missing > 0:
        # one more each for those that are shortest of their share
        open_ = rank_rows(materialise(counts.where(F.col("n") < limit), "open"), ["short", "rank"], "place")
        given = open_.where(F.col("place") < missing).select("rank", F.lit(1).cast("long").alias("more"))
        counts = materialise(counts.join(given, "rank", "left").select("rank", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "short"), "counts")
        missing = edges - counts.agg(F.sum("n")).first()[0]
    return counts.select("rank", "n")


def to_zipf(edges: DataFrame, alpha: float, seed: int, cap: int = 0) -> DataFrame:
    """An edge list of the same length whose sources' counts are Zipf-shaped and whose targets are drawn from the old ones."""
    spark = edges.sparkSession
    sources = materialise(edges.select("src").distinct(), "sources")
    targets = materialise(edges.select("dst").distinct(), "targets")
    n, total = sources.count(), edges.count()
    if not total:
        return edges.select("seq", "src", "dst")
    counts = zipf_counts(spark, n, total, alpha, cap)
    shuffled = rank_rows(materialise(sources.withColumn("h", F.xxhash64("src", F.lit(seed))), "shuffled"), ["h", "src"], "rank").select("src", "rank")
    # a source's draws are made in stretches, so a hot source's are not one array
    sized = shuffled.join(counts.where("n > 0"), "rank")
    spans = sized.select("src", "n", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1), F.lit(DRAWS).cast("long"))).alias("first")).repartition("src", "first")
    drawn = spans.select("src", F.explode(F.sequence(F.col("first") + 1, F.least(F.col("first") + DRAWS, F.col("n")))).alias("j"))
    places = rank_rows(targets, ["dst"], "place")
    picked = drawn.withColumn("place", F.pmod(F.xxhash64(F.lit(seed + 1), "src", "j"), F.lit(targets.count()))).join(places, "place")
    mixed = materialise(picked.select("src", "dst", F.xxhash64(F.lit(seed + 2), "src", "j").alias("h"), "j"), "drawn")
    return rank_rows(mixed, ["h", "src", "j"], "seq").select("seq", "src", "dst")


def replay_order(edges: DataFrame, mode: str = "DEFAULT", seed: int = 42) -> DataFrame:
    """(seq, src, dst) renumbered: DEFAULT as it is, SEQUENTIAL by (src, dst), RANDOM by a seeded hash."""
    if mode == "DEFAULT":
        return edges
    keyed = edges.withColumn("h", F.xxhash64("seq", F.lit(seed)) if mode == "RANDOM" else F.col("src"))
    order = ["h", "seq"] if mode == "RANDOM" else ["h", "dst", "seq"]
    if mode not in ("RANDOM", "SEQUENTIAL"):
        raise ValueError(f"unknown mode {mode}")
    return rank_rows(materialise(keyed, "replay"), order, "n").select(F.col("n").alias("seq"), "src", "dst")


def replay_range(edges: DataFrame, first: int, count: int) -> DataFrame:
    """The edges at places first, first + 1, ... of the list."""
    ranked = rank_rows(materialise(edges, "list"), ["seq"], "place")
    return ranked.where((F.col("place") >= first) & (F.col("place") < first + count)).select("seq", "src", "dst")
