"""Graphs and logs that follow from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.graph import Graph, from_edges, vertex_rows

#: Added to the second key of a bipartite graph.
SHIFT = 1_000_000
#: The table that a graph's edges come from.
SOURCES = {"supplier_part": "lineitem", "customer_order": "orders", "order_part": "lineitem", "customer_nation": "customer"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_part(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers and the parts they shipped."""
    li = read(spark, sf_dir, "lineitem")
    return from_edges(li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + SHIFT).alias("dst")))


def customer_order(spark: SparkSession, sf_dir: str) -> Graph:
    o = read(spark, sf_dir, "orders")
    return from_edges(o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + SHIFT).alias("dst")))


def order_part(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders and parts of all of lineitem; parts without edges are isolated."""
    li = read(spark, sf_dir, "lineitem")
    parts = read(spark, sf_dir, "part").select((F.col("p_partkey") + 1000 * SHIFT).alias("id"))
    return from_edges(li.select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 1000 * SHIFT).alias("dst")), parts)


def customer_nation(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and their nation, which is also the community of both."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c"), F.col("c_nationkey").cast("long").alias("n"))
    g = from_edges(c.select(F.col("c").alias("src"), (F.col("n") + SHIFT).alias("dst")))
    named = c.select(F.col("c").alias("id"), F.col("n").alias("k")).union(c.select(F.col("n") + SHIFT, "n").distinct())
    return Graph(vertex_rows(named, F.col("k")), g.edges, g.symmetric)


def event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge list (seq, src, dst) of events: the user and a target."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("src"), (F.col("event_id") % 97 + 1000).alias("dst"))


def event_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta log: an error deletes the edge, any other event inserts it; a hundred events are one commit."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "DELETE").otherwise("INSERT").alias("op"), F.col("user_id").alias("src"),
        (F.col("event_id") % 97 + 1000).alias("dst"), F.col("ts").cast("timestamp").alias("ts"), F.expr("event_id div 100 + 1").alias("commit_ts"),
    )


def event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base edges (src, dst, commit_ts) that the log partly changes."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("src"), (F.col("event_id") % 89 + 1000).alias("dst"), F.lit(0).cast("long").alias("commit_ts")).distinct()


def customer_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property log of customers: name and segment, then every third segment anew and every fifth name deleted."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), "c_name", "c_mktsegment")
    row = lambda n, key, value, gone=False: c.select((F.col("id") * 4 + n).alias("seq"), F.lit("vertex").alias("kind"), "id", F.lit(None).cast("long").alias("dst"), F.lit(key).alias("key"), value.cast("binary").alias("value"), F.lit(gone).alias("deleted"))
    log = row(0, "name", F.col("c_name")).union(row(1, "segment", F.col("c_mktsegment")))
    log = log.union(row(2, "segment", F.lower("c_mktsegment")).where("id % 3 = 0"))
    return log.union(row(3, "name", F.lit(None), True).where("id % 5 = 0"))
