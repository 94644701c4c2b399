"""Connected components of an edge table, label = smallest id of the component.

Partitions first contract their own edges to a forest, which
leaves at most one edge for each vertex a partition has seen. Then rounds of
large-star and small-star steps (Kiveris et al., 2014) contract what is left;
their number grows with the logarithm of the component size, not with its
diameter. As soon as no more than FOREST_EDGES edges are left, one task ends
the work: rounds over a few edges cost the driver more than the edges do.
Nothing but a row of counters per round reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.runtime import discard, materialise, ship, sized

#: Edges that one forest takes before it is written out and the next begun; some 150 bytes each in arrays.
FOREST_EDGES = 1_000_000


def _contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, root) edges that join what the edges (a, b) join; the root is the smallest vertex.

    Every root goes under the smallest one around it, then all paths are cut
    short: two such steps at least halve the roots that are still to be joined.
    """
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        u, v = root[u], root[v]
        apart = u != v
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while ((up := root[root]) != root).any():
            root = up
    below = np.flatnonzero(root != np.arange(len(ids)))
    return ids[below], ids[root[below]]


def _forest(batches):
    """Per partition: (vertex, root) edges that join what the partition's edges join."""

    def rows():
        src, dst = _contract(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column("src").to_numpy(), batch.column("dst").to_numpy()))
        n += batch.num_rows
        if n >= FOREST_EDGES:
            yield rows()
            held, n = [], 0
    if n:
        yield rows()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (src, dst) with src > dst.

    Large: each vertex links its larger neighbours to the smallest vertex
    around it. Small: each vertex links its smaller neighbours, and itself, to
    the smallest of them. A hub's minimum is a partial aggregate, and the join
    that brings it back is one that adaptive execution splits when skewed.
    """
    if large:
        both = edges.union(edges.select("dst", "src"))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        # (v, m) for neighbours v > u: v is the edge's src when u is its dst
        return edges.join(least.withColumnRenamed("src", "dst"), "dst").select("src", F.col("m").alias("dst")).distinct()
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src")
    linked = moved.select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(moved.select("src", F.col("m").alias("dst")))
    return linked.where("src <> dst").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, label) for every vertex of ``edges`` (src, dst bigint; direction and repeats do not matter).

    Vertices without edges do not occur: give them their own id as label.
    Self loops keep their vertex. Rows with a null end are ignored.
    """
    ship(edges.sparkSession)
    whole = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    loops = whole.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("label"))
    pairs = whole.where("src <> dst").select("src", "dst")
    now = materialise(pairs.mapInArrow(_forest, "src long, dst long"), "forest")
    left, mark = now.count(), None
    rows = 2 * left
    for _ in range(max_rounds):
        few = left <= FOREST_EDGES
        with sized(edges.sparkSession, rows):
            # one forest holds few edges, and its roots are the smallest ids
            last, now = now, materialise(now.coalesce(1).mapInArrow(_forest, "src long, dst long") if few else _star(_star(now, True), False), "stars")
        discard(last)
        if few:
            break
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        left, mark = seen[0], tuple(seen)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("dst").alias("id"), F.col("dst").alias("label")).union(loops).distinct()
    return now.select(F.col("src").alias("id"), F.col("dst").alias("label")).union(roots).groupBy("id").agg(F.min("label").alias("label"))
