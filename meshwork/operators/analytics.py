"""Components, PageRank and label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.graph import Graph
from meshwork.operators.components import connected_components
from meshwork.operators.topology import degree
from meshwork.runtime import bucketed, discard, materialise, sized

#: Vertices up to which a state, some 24 bytes each, is sent to every task; larger ones lie in the buckets of the edges.
STATE_ROWS = 500_000


class Rounds:
    """Edges and a state by vertex, written so that a round shuffles no edges, whatever the size.

    There are as many buckets as the number of edges asks for. A bucket's
    states are hashed, so the edges need no sorting.
    """

    def __init__(self, edges: DataFrame, state: DataFrame, vertices: int):
        self.spark, self.rows, self.large = edges.sparkSession, edges.count(), vertices > STATE_ROWS
        with sized(self.spark, self.rows):
            self.edges = bucketed(edges, "src", "edges") if self.large else materialise(edges, "edges")
            self.state = bucketed(state, "id", "state") if self.large else materialise(state, "state")

    def given(self, *columns: str) -> DataFrame:
        """The edges with columns of their source's state."""
        held = self.state.select(F.col("id").alias("src"), *columns)
        return self.edges.join(held.hint("shuffle_hash") if self.large else F.broadcast(held), "src")

    def told(self, given: DataFrame) -> DataFrame:
        """The state with what each vertex was given: (dst, ...), a row a vertex."""
        return self.state.join(given.hint("shuffle_hash") if self.large else given, F.col("id") == F.col("dst"), "left")

    def next(self, state: DataFrame) -> None:
        """Write the state of the next round, made from this one's, which goes."""
        last = self.state
        with sized(self.spark, self.rows):
            self.state = bucketed(state, "id", "state", dealt=True) if self.large else materialise(state, "state")
        discard(last)

    def end(self) -> DataFrame:
        discard(self.edges)
        return self.state


def wcc(graph: Graph) -> DataFrame:
    """(id, label): the smallest vertex id of the weakly connected component, for every vertex."""
    found = connected_components(graph.edges.where("src < dst") if graph.symmetric else graph.edges)
    with sized(graph.spark, 2 * graph.vertices.count()):
        return materialise(graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "labels")


def wcc_ordinal(graph: Graph) -> DataFrame:
    """(id, label): components numbered 0, 1, 2, ... by their smallest vertex."""
    from meshwork.operators.ordering import rank_rows

    labels = wcc(graph)
    with sized(graph.spark, labels.count()):
        # only the roots are ranked, one row a component
        roots = materialise(labels.where("id = label").select("label"), "roots")
        numbers = rank_rows(roots, ["label"], "ordinal")
        return materialise(labels.join(numbers, "label").select("id", F.col("ordinal").alias("label")), "ordinals")


def wcc_scan(graph: Graph, rounds: int) -> DataFrame:
    """(id, label): the smallest id within ``rounds`` hops, which is the component's once converged."""
    r = Rounds(graph.edges.select("src", "dst"), graph.vertices.select("id", F.col("id").alias("label")), graph.vertices.count())
    for _ in range(rounds):
        offers = r.given("label").groupBy("dst").agg(F.min("label").alias("offer"))
        r.next(r.told(offers).select("id", F.least("label", "offer").alias("label")))
    return r.end()


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def _ranked_edges(graph: Graph) -> DataFrame:
    """Edges with the degree of their source."""
    d = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    return graph.edges.join(d, "src").select("src", "dst", "d")


def _round(r: Rounds, share: Column, *columns: str) -> DataFrame:
    """Sum of what the neighbours give, worked out from ``columns`` of their state: (id, rank, degree, given). Only the partial sums are shuffled."""
    given = r.given(*columns or ("rank",)).groupBy("dst").agg(F.sum(share).alias("given"))
    return r.told(given).withColumn("given", F.coalesce("given", F.lit(0.0))).drop("dst")


def _pagerank(graph: Graph, iterations: int, damping: float, epsilon: float | None, dangling: bool) -> DataFrame:
    """The state, a row a vertex, is written each round; the edges are written once."""
    n = graph.vertices.count()
    if not n:
        return graph.vertices.select("id", F.lit(0.0).alias("rank"))
    r = Rounds(graph.edges.select("src", "dst"), degree(graph).select("id", "degree", F.lit(1.0 / n).alias("rank")), n)
    isolated = r.state.where("degree = 0").count() if dangling else 0
    base, held = (1 - damping) / n, 1.0 / n
    for _ in range(iterations):
        # isolated vertices are given nothing, so all of them hold the same
        lost = isolated * held
        held = base + damping * lost / n
        fresh = F.lit(base + damping * lost / n) + F.lit(damping) * F.col("given")
        r.next(_round(r, F.col("rank") / F.col("degree"), "rank", "degree").select("id", "degree", fresh.alias("rank"), F.abs(fresh - F.col("rank")).alias("moved")))
        if epsilon is not None and r.state.agg(F.sum("moved")).first()[0] < epsilon:
            break
    return r.end().select("id", "rank")


def pagerank_map(graph: Graph, iterations: int = 20, damping: float = 0.85, epsilon: float | None = 1e-6) -> DataFrame:
    """(id, rank) without redistribution of what isolated vertices hold. No epsilon: a fixed number of rounds."""
    return _pagerank(graph, iterations, damping, epsilon, False)


def pagerank(graph: Graph, iterations: int = 20, damping: float = 0.85, epsilon: float | None = 1e-6) -> DataFrame:
    """(id, rank); what isolated vertices hold is dealt to all, so that the ranks sum up to 1."""
    return _pagerank(graph, iterations, damping, epsilon, True)


def pagerank_scan(graph: Graph, iterations: int = 20, damping: float = 0.85, epsilon: float | None = None) -> DataFrame:
    """(id, rank) in the unnormalised form.

    The state is rank over degree, and only the last scheduled round leaves it
    undivided; stopping early by ``epsilon`` returns the divided values.
    Isolated vertices stay at 0 until the last round.
    """
    start = degree(graph).select("id", "degree", F.when(F.col("degree") > 0, 1.0 / F.col("degree")).otherwise(0.0).alias("rank"))
    r = Rounds(graph.edges.select("src", "dst"), start, graph.vertices.count())
    for i in range(iterations):
        full = F.lit(1 - damping) + F.lit(damping) * F.col("given")
        fresh = full if i == iterations - 1 else F.when(F.col("degree") > 0, full / F.col("degree")).otherwise(F.col("rank"))
        r.next(_round(r, F.col("rank")).select("id", "degree", fresh.alias("rank"), F.abs(fresh - F.col("rank")).alias("moved")))
        if epsilon is not None and (r.state.agg(F.sum("moved")).first()[0] or 0.0) < epsilon:
            break
    return r.end().select("id", "rank")


def most_frequent(votes: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label): the most frequent label of each key, the smallest of equally frequent ones.

    Counts by (key, label) come first, so a giant vertex's votes are folded
    before they meet in one place.
    """
    counts = votes.groupBy(key, label).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(key).agg(F.max_by(label, F.struct("__n", -F.col(label))).alias(label))


def cdlp(graph: Graph, iterations: int = 20, until_stable: bool = False) -> DataFrame:
    """(id, label): synchronous majority label propagation, ties to the smallest label; isolated vertices keep their id."""
    r = Rounds(graph.edges.select("src", "dst"), graph.vertices.select("id", F.col("id").alias("label")), graph.vertices.count())
    for _ in range(iterations):
        won = most_frequent(r.given("label").select("dst", "label"), "dst", "label").withColumnRenamed("label", "won")
        r.next(r.told(won).select("id", F.coalesce("won", "label").alias("label"), (F.coalesce("won", "label") != F.col("label")).alias("moved")))
        if until_stable and r.state.where("moved").isEmpty():
            break
    return r.end().select("id", "label")
