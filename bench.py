"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Graphs are loaded before the clock starts. Every query runs to a ``noop`` sink:
three times, the median counts. Searches start from ten seeded vertices and count
by their mean; of those, one round is run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from meshwork import catalog  # noqa: E402
from meshwork.operators import analytics, deltas, topology, traversal  # noqa: E402
from meshwork.sources import derive  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    g = catalog.graph(spark, sf_dir, "supplier_part")
    lone = catalog.graph(spark, sf_dir, "customer_order")
    sources = traversal.bfs_benchmark_sources(g, 10)
    base, log = derive.event_base(spark, sf_dir), derive.event_deltas(spark, sf_dir)
    traversal.bfs_levels(g, sources[0]).count()

    def bfs():
        for s in sources:
            yield traversal.bfs_levels(g, s)

    runs = {
        "bfs_levels": bfs,
        "wcc": lambda: [analytics.wcc(g)],
        "wcc_many_components": lambda: [analytics.wcc(lone)],
        "pagerank_map": lambda: [analytics.pagerank_map(g, 5, epsilon=None)],
        "pagerank": lambda: [analytics.pagerank(g, 5, epsilon=None)],
        "pagerank_scan": lambda: [analytics.pagerank_scan(g, 5)],
        "cdlp_voting": lambda: [analytics.cdlp(g, 5)],
        "edge_scan_sum": lambda: [topology.edge_scan(g, F.col("src") + F.col("dst"))],
        "degree": lambda: [topology.degree(g)],
        "induced_subgraph": lambda: [topology.induced_subgraph(g, catalog.busy(g), check=False).edges],
        "block_adjacency": lambda: [topology.block_adjacency(g.edges, g.vertices.select("id", (F.col("id") % 64).alias("block")))],
        "apply_deltas": lambda: [deltas.apply_deltas(base, log)],
        "neighbors_merged": lambda: [deltas.neighbors_merged(base, log, 3)],
        "load_graph": lambda: [derive.supplier_part(spark, sf_dir).edges],
    }
    took = {}
    for name, run in runs.items():
        times = []
        for _ in range(1 if name == "bfs_levels" else 3):
            began, n = time.perf_counter(), 0
            for df in run():
                df.write.format("noop").mode("overwrite").save()
                n += 1
            times.append((time.perf_counter() - began) / n)
        took[name] = round(median(times), 3)
    spark.stop()
    print(json.dumps({"metric": "graph queries, sum of median times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
