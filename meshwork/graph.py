"""The graph value: two DataFrames and nothing else.

``vertices``: id bigint, label bigint, community bigint, deleted boolean.
``edges``: src bigint, dst bigint, one row for each stored direction.

A ``Graph`` is one immutable snapshot. Mutations make a new snapshot (see
``meshwork.plans.store``); every algorithm runs on the snapshot it is given.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.runtime import materialise

#: Degree from which on a vertex counts as giant.
GIANT_DEGREE = 128


@dataclass(frozen=True)
class Graph:
    """``symmetric`` is set where every edge is known to be stored both ways, which searches can rely on."""

    vertices: DataFrame
    edges: DataFrame
    symmetric: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def live(self) -> DataFrame:
        """Ids of the vertices that are not deleted."""
        return self.vertices.where(~F.coalesce("deleted", F.lit(False))).select("id")

    def materialised(self) -> "Graph":
        """The same graph on written tables, the edges clustered by source.

        Clustering puts a vertex's edges next to each other, so row-group
        statistics prune point reads and later joins find sorted runs. Range
        partitioning by (src, dst) also splits the edges of a giant vertex.
        """
        edges = materialise(self.edges.select("src", "dst").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst"), "edges")
        return replace(self, vertices=materialise(self.vertices, "vertices"), edges=edges)


def vertex_rows(ids: DataFrame, community=None) -> DataFrame:
    """Vertex rows from a DataFrame with an ``id`` column; the community defaults to the id."""
    return ids.select(
        F.col("id").cast("long").alias("id"), F.lit(0).cast("long").alias("label"), (F.col("id") if community is None else community).cast("long").alias("community"), F.lit(False).alias("deleted")
    )


def symmetrize(edges: DataFrame) -> DataFrame:
    """Directed multigraph to undirected simple graph: both directions, no self loops, no repeats."""
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    # one row an undirected edge is shuffled, then told both ways without another shuffle
    once = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return once.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


def from_edges(edges: DataFrame, isolated: DataFrame | None = None, undirected: bool = True) -> Graph:
    """A graph from (src, dst) rows; ``isolated`` may name further ids."""
    e = symmetrize(edges) if undirected else edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    ids = e.select(F.col("src").alias("id"))
    if not undirected:
        ids = ids.union(e.select("dst"))
    if isolated is not None:
        ids = ids.union(isolated.select(F.col("id").cast("long")))
    return Graph(vertex_rows(ids.distinct()), e, undirected)


def from_map(spark: SparkSession, adjacency: dict[int, list[int]], communities: dict[int, int] | None = None) -> Graph:
    """A directed graph as given by an adjacency map; ids run to the largest one that occurs, neighbours are a set."""
    n = max([*adjacency, *(x for xs in adjacency.values() for x in xs)], default=-1) + 1
    edges = spark.createDataFrame([(k, x) for k, xs in adjacency.items() for x in sorted(set(xs))], "src long, dst long")
    named = spark.createDataFrame(list((communities or {}).items()), "id long, c long")
    vertices = spark.range(n).join(named, "id", "left")
    return Graph(vertex_rows(vertices, F.coalesce("c", "id")), edges)


def from_csr(spark: SparkSession, offsets: list[int], neighbors: list[int], communities: list[int] | None = None) -> Graph:
    """A graph from compressed rows: the neighbours of i are neighbors[offsets[i]:offsets[i + 1]]."""
    rows = [(i, neighbors[a:b]) for i, (a, b) in enumerate(zip(offsets, offsets[1:]))]
    lists = spark.createDataFrame(rows, "src long, list array<long>")
    ids = spark.createDataFrame([(i, communities[i] if communities else i) for i in range(len(rows))], "id long, c long")
    return Graph(vertex_rows(ids, F.col("c")), lists.select("src", F.explode("list").alias("dst")))


def list_rows(spark: SparkSession, adjacency: dict[int, list[int]]) -> DataFrame:
    """(id, pos, neighbors) of an adjacency map with any ids: rows by id, neighbours in the order in which they are given."""
    rows = [(v, i, list(adjacency[v])) for i, v in enumerate(sorted(adjacency))]
    return spark.createDataFrame(rows, "id long, pos long, neighbors array<long>")
