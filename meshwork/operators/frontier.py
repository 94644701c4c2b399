"""Frontiers and the supersteps over them.

A frontier is a set of vertex ids, with or without a payload. There is no
sparse and dense form: adaptive execution sends a small frontier to the edges
and shuffles a large one. What a superstep does to a vertex is a Column
expression for the message on each edge, an aggregate that combines the
messages of a vertex, and a condition on the target's state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.graph import Graph
from meshwork.operators.ordering import running


class VertexSubset:
    """A set of active vertices (``id``), with an optional ``data`` column."""

    def __init__(self, rows: DataFrame, data: bool = False):
        self.rows = rows.select("id", "data") if data else rows.select("id").distinct()
        self.has_data = data

    @classmethod
    def of(cls, spark: SparkSession, ids) -> "VertexSubset":
        return cls(spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id long"))

    @classmethod
    def from_flags(cls, spark: SparkSession, flags: list[bool]) -> "VertexSubset":
        return cls.of(spark, [i for i, f in enumerate(flags) if f])

    @classmethod
    def everything(cls, graph: Graph) -> "VertexSubset":
        return cls(graph.vertices)

    def size(self) -> int:
        return self.rows.count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def contains(self, v: int) -> bool:
        return not self.rows.where(F.col("id") == v).isEmpty()

    def to_sparse(self) -> DataFrame:
        """The ids, ascending."""
        return self.rows.select("id").orderBy("id")

    def to_dense(self, graph: Graph) -> DataFrame:
        """(id, active) for every vertex of the graph."""
        return graph.vertices.select("id").join(self.rows.select("id", F.lit(True).alias("active")), "id", "left").select("id", F.coalesce("active", F.lit(False)).alias("active"))

    def data_of(self, v: int):
        row = self.rows.where(F.col("id") == v).first()
        return None if row is None else row["data"]


def edge_map(graph: Graph, frontier: VertexSubset, combine: Column, message: Column | None = None, state: DataFrame | None = None, cond: Column | None = None) -> DataFrame:
    """(id, value) for each vertex that the frontier's edges reach.

    ``message`` is an expression of src, dst and, with a payload, data;
    ``combine`` aggregates the column ``message``. With ``state`` (id, ...) and
    ``cond``, only targets whose state meets the condition take messages.
    """
    active = frontier.rows.withColumnRenamed("id", "src")
    e = graph.edges.join(active, "src")
    if state is not None and cond is not None:
        e = e.join(state.where(cond).select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.select(F.col("dst").alias("id"), (F.col("src") if message is None else message).alias("message")).groupBy("id").agg(combine.alias("value"))


def vertex_map(frontier: VertexSubset, state: DataFrame, value: Column, name: str) -> DataFrame:
    """``state`` with column ``name`` set to ``value`` on the active vertices; other vertices keep theirs."""
    marked = state.join(frontier.rows.select("id", F.lit(True).alias("__active")), "id", "left")
    old = F.col(name) if name in state.columns else F.lit(None)
    return marked.withColumn(name, F.when(F.col("__active"), value).otherwise(old)).drop("__active")


def vertex_filter(frontier: VertexSubset, state: DataFrame, cond: Column) -> VertexSubset:
    """The active vertices whose state meets a condition."""
    return VertexSubset(frontier.rows.join(state.where(cond).select("id"), "id", "left_semi"), frontier.has_data)


def prefix_scan(df: DataFrame, order: str, value: str) -> DataFrame:
    """``df`` with ``prefix`` (sum before the row in the order of ``order``) and the whole in ``total``.

    Two passes over ranges of about equal row counts, wherever the values of
    ``order`` lie: each range is summed up on its own, and the sums of the ranges
    before it, one row a range, are added.
    """
    total = df.agg(F.coalesce(F.sum(value), F.lit(0))).first()[0]
    return running(df, [order], value, "prefix").withColumn("total", F.lit(total).cast("long"))


def reduce_rows(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def pack(df: DataFrame, keep: Column) -> DataFrame:
    """The rows that meet a condition."""
    return df.where(keep)
