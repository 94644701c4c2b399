"""Samples of a graph: by search order, by random walk, by block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.graph import Graph
from meshwork.operators.topology import induced_edges
from meshwork.operators.traversal import bfs_visit_order
from meshwork.runtime import materialise


def sample_bfs(graph: Graph, start: int, n: int) -> Graph:
    """The subgraph on the first n vertices that a queue visits from ``start``; the search ends with the level in which they are reached."""
    ids = materialise(bfs_visit_order(graph, start, limit=n).where(F.col("visit_order") < n).select("id"), "sample")
    return Graph(graph.vertices.join(ids, "id", "left_semi"), induced_edges(graph.edges, ids), graph.symmetric)


def sample_random_walk(graph: Graph, start: int, n: int = 200, seed: int = 42, restart: float = 0.15, walkers: int = 32, max_steps: int = 400) -> DataFrame:
    """Walked edges (step, walker, src, dst), in the order of step and walker, until ``n`` distinct vertices were seen.

    Many walkers go at once: a superstep joins their places with the edges and
    each takes the neighbour of smallest seeded hash. With probability
    ``restart`` a walker goes on from a vertex seen before, picked by a hash of
    seed, step and walker, instead of from where it is. The walk is cut right
    after the move that brings the n-th vertex, so it never has more. At most
    ``max_steps`` supersteps, and it ends early where 20 bring nothing new, so a
    component with fewer vertices ends the walk. What has been seen, ``n``
    vertices at most, is known to the driver.
    """
    spark = graph.spark
    places = dict.fromkeys(range(walkers), start)
    seen, walked, stale = {start: None}, [], 0
    for step in range(max_steps):
        at = spark.createDataFrame(sorted(places.items()), "walker long, src long")
        pick = F.xxhash64(F.lit(seed), F.lit(step), "walker", "dst")
        moves = at.join(graph.edges, "src").groupBy("walker", "src").agg(F.min_by("dst", pick).alias("dst"))
        turn = F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(step), "walker"), F.lit(10_000))
        place = F.xxhash64(F.lit(seed + 2), F.lit(step), "walker")
        rows = moves.select("walker", "src", "dst", turn.alias("turn"), place.alias("place")).orderBy("walker").collect()
        before = len(seen)
        for r in rows:
            walked.append((step, r["walker"], r["src"], r["dst"]))
            seen.setdefault(r["dst"])
            if len(seen) >= n:
                break
        stale = stale + 1 if len(seen) == before else 0
        if len(seen) >= n or stale >= 20 or not rows:
            break
        known = list(seen)
        for r in rows:
            places[r["walker"]] = known[r["place"] % len(known)] if r["turn"] < restart * 10_000 else r["dst"]
    return spark.createDataFrame(walked, "step int, walker long, src long, dst long")


def sample_block(graph: Graph, blocks: DataFrame, start: int) -> Graph:
    """The subgraph on the start's block. ``blocks``: (id, block)."""
    mine = blocks.join(blocks.where(F.col("id") == start).select("block"), "block", "left_semi").select("id")
    return Graph(graph.vertices.join(mine, "id", "left_semi"), induced_edges(graph.edges, mine), graph.symmetric)
