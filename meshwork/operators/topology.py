"""Point reads, subgraphs, quotient graphs and statistics of one snapshot."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.graph import GIANT_DEGREE, Graph
from meshwork.runtime import materialise, sized


def id_rows(graph: Graph, ids) -> DataFrame:
    """A DataFrame with an ``id`` column from ids in any form."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct()
    return graph.spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id long")


def neighbors(graph: Graph, v: int) -> DataFrame:
    """Neighbours of one vertex, ascending; none for an unknown one. The filter reaches the scan."""
    return graph.edges.where(F.col("src") == v).select("dst").orderBy("dst")


def degree(graph: Graph) -> DataFrame:
    """(id, degree) of every vertex, 0 for isolated ones."""
    counted = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    return graph.vertices.select("id").join(counted, F.col("id") == F.col("src"), "left").select("id", F.coalesce("d", F.lit(0)).alias("degree"))


def vertex_count(graph: Graph) -> int:
    return graph.vertices.count()


def edge_count(graph: Graph) -> int:
    """Stored edges, both directions."""
    return graph.edges.count()


def has_vertex(graph: Graph, v: int) -> bool:
    return not graph.vertices.where(F.col("id") == v).isEmpty()


def has_edge(graph: Graph, src: int, dst: int) -> bool:
    return not graph.edges.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()


def adjacency(graph: Graph, rows: int | None = None) -> DataFrame:
    """(id, neighbors) of every vertex, sorted, with empty lists; written.

    For writing out and for small graphs: a vertex's whole list is one value.
    The algorithms use the edge rows instead. ``rows`` bounds the edges where
    counting them is work.
    """
    lists = graph.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("l"))
    every = graph.vertices.select("id").join(lists, F.col("id") == F.col("src"), "left").select("id", F.coalesce("l", F.array().cast("array<long>")).alias("neighbors"))
    with sized(graph.spark, rows or graph.edges.count()):
        return materialise(every, "lists")


def giant_vertices(graph: Graph, bound: int = GIANT_DEGREE) -> DataFrame:
    return graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= bound).select(F.col("src").alias("id"), "degree")


def community_members(graph: Graph, community: int) -> DataFrame:
    """Vertices of a community; an unknown community is an error."""
    found = graph.vertices.where(F.col("community") == community).select("id")
    if found.isEmpty():
        raise ValueError(f"no community {community}")
    return found


def communities(graph: Graph) -> DataFrame:
    return graph.vertices.groupBy("community").agg(F.sort_array(F.collect_list("id")).alias("members"))


def community_of(graph: Graph, v: int) -> int:
    row = graph.vertices.where(F.col("id") == v).select("community").first()
    if row is None:
        raise ValueError(f"no vertex {v}")
    return row[0]


def _checked(graph: Graph, ids: DataFrame) -> DataFrame:
    strange = ids.join(graph.vertices.select("id"), "id", "left_anti").first()
    if strange is not None:
        raise ValueError(f"no vertex {strange[0]}")
    return ids


def induced_edges(edges: DataFrame, ids: DataFrame, both_ends: bool = True) -> DataFrame:
    """Edges that begin within a set of ids and, if asked for, also end there."""
    s = ids.select("id")
    e = edges.join(s.withColumnRenamed("id", "src"), "src", "left_semi")
    return e.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst") if both_ends else e.select("src", "dst")


def induced_subgraph(graph: Graph, ids, check: bool = True) -> Graph:
    """The graph on a set of vertices and the edges within; isolated members stay; unknown ids are an error."""
    s = id_rows(graph, ids)
    if check:
        s = _checked(graph, s)
    return Graph(graph.vertices.join(s, "id", "left_semi"), induced_edges(graph.edges, s), graph.symmetric)


def induced_map(graph: Graph, ids, pruning: bool = False) -> DataFrame:
    """(id, neighbors) of a set of vertices; without pruning neighbours outside the set stay."""
    s = id_rows(graph, ids)
    return adjacency(Graph(graph.vertices.join(s, "id", "left_semi"), induced_edges(graph.edges, s, pruning)), graph.edges.count())


def community_subgraph(graph: Graph, community: int) -> Graph:
    members = community_members(graph, community)
    return Graph(graph.vertices.where(F.col("community") == community), induced_edges(graph.edges, members), graph.symmetric)


def within_communities(graph: Graph) -> DataFrame:
    """All community subgraphs at once: (community, src, dst) of edges whose ends share a community."""
    c = graph.vertices.select("id", "community")
    a = graph.edges.join(c.select(F.col("id").alias("src"), F.col("community").alias("ca")), "src")
    return a.join(c.select(F.col("id").alias("dst"), F.col("community").alias("cb")), "dst").where("ca = cb").select(F.col("ca").alias("community"), "src", "dst")


def block_adjacency(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Quotient graph: distinct (src_block, dst_block) of different blocks. ``blocks``: (id, block)."""
    a = edges.join(blocks.select(F.col("id").alias("src"), F.col("block").alias("src_block")), "src")
    b = a.join(blocks.select(F.col("id").alias("dst"), F.col("block").alias("dst_block")), "dst")
    return b.where("src_block <> dst_block").select("src_block", "dst_block").distinct()


def export_tree_json(tree: DataFrame, path: str) -> None:
    """Write the block tree as JSON lines."""
    kids = tree.where("parent IS NOT NULL").groupBy((F.col("level") + 1).alias("level"), F.col("parent").alias("block")).agg(F.sort_array(F.collect_list("block")).alias("children"))
    tree.join(kids, ["level", "block"], "left").select("level", F.col("block").alias("page_number"), F.coalesce(F.size("children"), F.lit(0)).alias("num_blocks"), "children").write.mode("overwrite").json(path)


def graph_statistics(graph: Graph) -> DataFrame:
    d = degree(graph)
    return d.agg(F.count(F.lit(1)).alias("vertices"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"), F.avg("degree").alias("avg_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))


def community_statistics(graph: Graph) -> DataFrame:
    sizes = graph.vertices.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("communities"), F.avg("size").alias("avg_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))


def community_size_histogram(graph: Graph) -> DataFrame:
    return graph.vertices.groupBy("community").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("communities"))


def locality_score(graph: Graph, order: DataFrame) -> DataFrame:
    """Mean distance in an order (id, pos) of the ends of the edges with src < dst."""
    e = graph.edges.where("src < dst")
    p = e.join(order.select(F.col("id").alias("src"), F.col("pos").alias("a")), "src").join(order.select(F.col("id").alias("dst"), F.col("pos").alias("b")), "dst")
    return p.agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("locality"))


def edge_scan(graph: Graph, value: Column, active: DataFrame | None = None) -> DataFrame:
    """Sum of an expression of (src, dst) over all stored edges, or over those whose src is active."""
    e = graph.edges if active is None else graph.edges.join(id_rows(graph, active).withColumnRenamed("id", "src"), "src", "left_semi")
    return e.agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def warm_up(graph: Graph) -> Graph:
    """Keep the graph in the executors' memory; what is lost is read again."""
    g = Graph(graph.vertices.persist(), graph.edges.persist(), graph.symmetric)
    g.vertices.count(), g.edges.count()
    return g
