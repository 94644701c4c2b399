"""Command line: ``python -m meshwork.cli bfs|wcc|pagerank|cdlp GRAPH [flags]``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from meshwork import config
from meshwork.operators import analytics, traversal
from meshwork.operators.topology import warm_up
from meshwork.sources.text import load_graph


def algorithms() -> dict[str, dict]:
    """For each command the functions by ``--algo`` name; the first is the default."""
    return {
        "bfs": {"map": lambda g, a: traversal.bfs_levels(g, a.start, named=g.vertices.count() // max(a.divisor, 1)), "scan": lambda g, a: traversal.bfs_levels(g, a.start, named=0), "sequential": lambda g, a: traversal.bfs_visit_order(g, a.start)},
        "wcc": {"sv": lambda g, a: analytics.wcc(g), "map": lambda g, a: analytics.wcc(g), "scan": lambda g, a: analytics.wcc(g), "sequential": lambda g, a: analytics.wcc_ordinal(g)},
        "pagerank": {
            "map": lambda g, a: analytics.pagerank_map(g, a.iters, a.damping, a.epsilon),
            "scan": lambda g, a: analytics.pagerank_scan(g, a.iters, a.damping, a.epsilon),
            "sequential": lambda g, a: analytics.pagerank(g, a.iters, a.damping, a.epsilon),
        },
        "cdlp": {"voting": lambda g, a: analytics.cdlp(g, a.iters, True), "map": lambda g, a: analytics.cdlp(g, a.iters), "scan": lambda g, a: analytics.wcc_scan(g, a.iters)},
    }


def parser(defaults: config.Settings) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="meshwork")
    p.add_argument("command", choices=sorted(algorithms()))
    p.add_argument("graph", nargs="?", default=defaults.graph)
    p.add_argument("--config")
    p.add_argument("--algo")
    p.add_argument("--start", type=int, default=defaults.start)
    p.add_argument("--iters", type=int, default=defaults.iterations)
    p.add_argument("--damping", type=float, default=defaults.damping)
    p.add_argument("--epsilon", type=float, default=defaults.epsilon)
    p.add_argument("--divisor", "-d", type=int, default=20, help="BFS: a frontier of up to a divisor-th of the vertices (1000 at most) is named to the scan of the edges, a larger one is joined")
    p.add_argument("--mem", action="store_true", help="keep the graph in the executors' memory")
    p.add_argument("--prefetch-workers", type=int, default=0, help="accepted and without effect: Spark schedules the reads")
    p.add_argument("--benchmark", action="store_true", help="print seconds; BFS runs from several seeded sources")
    p.add_argument("--result", help="write the result to this folder as Parquet")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    pre = argparse.ArgumentParser(add_help=False)
    pre.add_argument("--config")
    first, _ = pre.parse_known_args(argv)
    defaults = config.load(first.config) if first.config else config.Settings()
    args = parser(defaults).parse_args(argv)
    table = algorithms()[args.command]
    name = args.algo or next(iter(table))
    if name not in table:
        print(f"unknown algorithm {name}: use one of {', '.join(table)}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("meshwork").getOrCreate()
    graph = load_graph(spark, args.graph).materialised()
    if args.mem:
        graph = warm_up(graph)
    if args.benchmark:
        sources = traversal.bfs_benchmark_sources(graph, defaults.random_select, defaults.seed) if args.command == "bfs" else [args.start]
        took = []
        for args.start in sources:
            began = time.perf_counter()
            table[name](graph, args).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        print(f"{args.command} {name}: {sum(took):.6f} s in all, {sum(took) / len(took):.6f} s on average")
        return 0
    result = table[name](graph, args)
    if args.result:
        result.write.mode("overwrite").parquet(args.result)
    print(f"{args.command} {name}: {result.count()} rows")
    return 0


if __name__ == "__main__":
    sys.exit(main())
