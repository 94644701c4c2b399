"""Readers and writers for the text formats: graphs and edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.graph import Graph, from_edges, vertex_rows

#: Ids above this are an error.
MAX_ID = 1_000_000_000


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """The fields of each line that is neither blank nor a comment."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^[ \t]+|[ \t\r]+$", "").alias("line"))
    return lines.where("line <> '' AND NOT startswith(line, '#')").select(F.split("line", r"[ \t]+").alias("f"))


def load_graph(spark: SparkSession, path: str, communities: bool = True, dedup: bool = True) -> Graph:
    """A ``.graph`` file: ``t <V> <E>``, ``v <id> <label> <community>``, ``e <src> <dst>`` lines.

    Edges are undirected and stored in both directions; self loops and edges
    that touch an id from V on are left out; without a ``t`` line V is one more
    than the largest id. The label of a line is read over. With ``dedup`` off
    parallel edges stay. An id above MAX_ID is an error.
    """
    f = _fields(spark, path)
    tag = F.substring(F.col("f")[0], 1, 1)
    number = lambda i: F.get("f", F.lit(i)).cast("long")
    checked = lambda c: F.when(c > MAX_ID, F.raise_error(F.lit("vertex id too large"))).otherwise(c)
    heads = f.where(tag == "t").agg(F.max(number(1)).alias("n"))
    named = f.where(tag == "v").select(checked(number(1)).alias("id"), F.coalesce(number(3), F.lit(0)).alias("c"))
    raw = f.where(tag == "e").select(checked(number(1)).alias("src"), checked(number(2)).alias("dst"))
    # one row of bounds; the only thing that the driver reads
    low = heads.select(F.lit(0).alias("kind"), "n").union(named.agg(F.lit(1), F.max("id"))).union(raw.agg(F.lit(1), F.max(F.greatest("src", "dst")))).groupBy("kind").agg(F.max("n").alias("n")).collect()
    bound = {r["kind"]: r["n"] for r in low}
    n = bound.get(0) if bound.get(0) is not None else (bound.get(1) if bound.get(1) is not None else -1) + 1
    kept = raw.where((F.col("src") < n) & (F.col("dst") < n))
    if dedup:
        edges = from_edges(kept).edges
    else:
        loose = kept.where("src <> dst")
        edges = loose.union(loose.select("dst", "src"))
    ids = spark.range(n).join(named.where(F.col("id") < n).groupBy("id").agg(F.max("c").alias("c")), "id", "left")
    return Graph(vertex_rows(ids, F.coalesce("c", F.lit(0)) if communities else F.col("id")), edges)


def save_graph(graph: Graph, path: str) -> None:
    """Write a ``.graph`` file set: header, vertices, then each undirected edge once."""
    n, m = graph.vertices.count(), graph.edges.where("src < dst").count()
    spark = graph.spark
    head = spark.createDataFrame([(0, 0, 0, f"t {n} {m}")], "k int, a long, b long, value string")
    v = graph.vertices.select(F.lit(1).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws(" ", F.lit("v"), "id", "label", "community").alias("value"))
    e = graph.edges.where("src < dst").select(F.lit(2).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", F.lit("e"), "src", "dst").alias("value"))
    head.union(v).union(e).repartitionByRange("k", "a", "b").sortWithinPartitions("k", "a", "b").select("value").write.mode("overwrite").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class EdgeList:
    """An ordered list of directed edges: a DataFrame (seq, src, dst).

    ``seq`` rises with the line order of the file; it need not be gapless.
    """

    def __init__(self, spark: SparkSession, name: str = "", path: str | None = None):
        self.spark, self.name = spark, name
        self.path = path or f"data/{name}.delta"
        self.edges = spark.createDataFrame([], "seq long, src long, dst long")

    def load(self, path: str | None = None) -> bool:
        """Read ``<src> <dst>`` lines; a missing file gives False and leaves the list as it is."""
        where = path or self.path
        if not _exists(self.spark, where):
            return False
        self.path = where
        f = _fields(self.spark, where).withColumn("seq", F.monotonically_increasing_id())
        self.edges = f.where(F.size("f") >= 2).select("seq", F.col("f")[0].cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst"))
        return True

    def add(self, edges: list[tuple[int, int]]) -> None:
        last = self.edges.agg(F.max("seq")).first()[0]
        first = 0 if last is None else last + 1
        self.edges = self.edges.union(self.spark.createDataFrame([(first + i, a, b) for i, (a, b) in enumerate(edges)], "seq long, src long, dst long"))

    def clear(self) -> None:
        self.edges = self.edges.limit(0)

    def count(self) -> int:
        return self.edges.count()

    def statistics(self) -> DataFrame:
        """Edges, distinct end points and the largest id."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return ends.agg((F.count(F.lit(1)) / 2).cast("long").alias("edges"), F.countDistinct("id").alias("vertices"), F.max("id").alias("max_id"))
