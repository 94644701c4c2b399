"""Search, components, ranks and communities against known values."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwork.graph import from_edges
from meshwork.operators import analytics as A
from meshwork.operators import distribution as D
from meshwork.operators import frontier as Fr
from meshwork.operators import traversal as B
from meshwork import runtime as R
from meshwork.operators import components as C
from meshwork.operators.components import connected_components
from tests.test_topology import EDGES


@pytest.fixture(scope="module")
def g(spark):
    return from_edges(spark.createDataFrame(EDGES, "src long, dst long")).materialised()


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_bfs(g):
    assert pairs(B.bfs_levels(g, 0)) == {0: 0, 1: 1, 2: 1, 3: 1, 4: 2, 5: 3, 6: 3, 7: 2, 8: 3, 9: 3, 10: 3, 11: 2, 12: 3}
    assert B.bfs_levels(g, 99).count() == 0
    order = [r["id"] for r in B.bfs_visit_order(g, 0).orderBy("visit_order").collect()]
    near = {}
    for a, b in EDGES:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    queue, seen = [0], {0}
    for v in queue:
        for x in sorted(near[v]):
            if x not in seen:
                seen.add(x), queue.append(x)
    assert order == queue


def test_search_on_a_long_path_and_against_the_direction(spark, monkeypatch):
    monkeypatch.setattr(B, "MERGED_LEVELS", 5)
    path = from_edges(spark.createDataFrame([(i, i + 1) for i in range(23)], "src long, dst long")).materialised()
    for named in (0, 1000):
        assert path.symmetric and pairs(B.bfs_levels(path, 4, named=named)) == {i: abs(i - 4) for i in range(24)}
    one_way = from_edges(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 1), (5, 0)], "src long, dst long"), undirected=False)
    assert not one_way.symmetric and pairs(B.bfs_levels(one_way, 0)) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}


def test_search_in_all_blocks(spark, g):
    blocks = g.vertices.select("id", (F.col("id") % 3).alias("block"))
    got = {r["id"]: (r["block"], r["level"]) for r in B.bfs_in_blocks(g, blocks).collect()}
    for k in range(3):
        one = pairs(B.bfs_in_block(g, blocks, k))
        assert {i: x for i, x in one.items()} == {i: level for i, (block, level) in got.items() if block == k}


def test_wcc_where_greedy_propagation_fails(spark):
    tricky = from_edges(spark.createDataFrame([(0, 11), (1, 10), (10, 12), (11, 12), (5, 12)], "src long, dst long"), spark.createDataFrame([(20,)], "id long"))
    assert pairs(A.wcc(tricky)) == {**dict.fromkeys((0, 1, 5, 10, 11, 12), 0), 20: 20}
    assert pairs(A.wcc_ordinal(tricky)) == {**dict.fromkeys((0, 1, 5, 10, 11, 12), 0), 20: 1}


def test_components_of_a_long_path_and_random_graphs(spark):
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(path).where("label = 0").count() == 301
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    want = {x: find(x) for e in edges for x in e}
    assert pairs(connected_components(spark.createDataFrame(edges, "src long, dst long"))) == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("bound", [0, 40, 1000])
def test_components_end_in_one_task_once_few_edges_are_left(spark, monkeypatch, bound):
    rng = random.Random(5)
    edges = [(x, rng.randrange(max(0, x - 3), x)) for x in range(1, 300) if x % 50]
    want = {}
    for x in range(300):
        want[x] = min([want[b] for a, b in edges if a == x], default=x)
    want = {x: r for x, r in want.items() if any(x in e for e in edges)}
    monkeypatch.setattr(C, "FOREST_EDGES", bound)
    taken, star = [], C._star
    monkeypatch.setattr(C, "_star", lambda e, large: taken.append(large) or star(e, large))
    assert pairs(connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(8))) == want
    assert bool(taken) == (bound < 1000)


def test_pagerank(g):
    want = [0.07231, 0.07231, 0.07231, 0.140278, 0.099621, 0.057085, 0.057085, 0.111937, 0.06977, 0.06977, 0.06977, 0.068191, 0.039565]
    for f in (A.pagerank_map, A.pagerank):
        got = pairs(f(g, 5, epsilon=None))
        assert all(math.isclose(got[i], w, abs_tol=1e-6) for i, w in enumerate(want))
    scan = pairs(A.pagerank_scan(g, 5))
    assert math.isclose(scan[3], 1.823619, abs_tol=1e-6) and math.isclose(scan[12], 0.514348, abs_tol=1e-6)
    assert math.isclose(sum(pairs(A.pagerank_map(g, 100, epsilon=1e-9)).values()), 1.0, abs_tol=1e-6)


def test_pagerank_with_an_isolated_vertex(spark):
    lone = from_edges(spark.createDataFrame([(0, 1)], "src long, dst long"), spark.createDataFrame([(2,)], "id long"))
    assert math.isclose(sum(pairs(A.pagerank(lone, 10, epsilon=None)).values()), 1.0)
    assert sum(pairs(A.pagerank_map(lone, 10, epsilon=None)).values()) < 1
    assert math.isclose(pairs(A.pagerank_scan(lone, 3))[2], 0.15)


def test_cdlp(g):
    assert [v for _, v in sorted(pairs(A.cdlp(g, 1)).items())] == [1, 0, 0, 0, 3, 4, 4, 3, 7, 7, 7, 3, 11]
    assert [v for _, v in sorted(pairs(A.cdlp(g, 5)).items())] == [0, 0, 0, 0, 3, 3, 3, 7, 7, 7, 7, 0, 0]
    assert pairs(A.cdlp(g, 20, until_stable=True)) == pairs(A.cdlp(g, 5))
    assert set(pairs(A.wcc_scan(g, 10)).values()) == {0}


@pytest.mark.parametrize("rows", [0, 500_000])
def test_rounds_of_any_size(spark, g, monkeypatch, rows):
    """Sent to every task or in buckets: the same results, spent states are deleted, no round shuffles the edges."""
    monkeypatch.setattr(A, "STATE_ROWS", rows)
    before = len(spark.catalog.listTables())
    ranks = pairs(A.pagerank(g, 5, epsilon=None))
    assert math.isclose(ranks[3], 0.140278, abs_tol=1e-6) and math.isclose(pairs(A.pagerank_scan(g, 5))[3], 1.823619, abs_tol=1e-6)
    assert [v for _, v in sorted(pairs(A.cdlp(g, 5)).items())] == [0, 0, 0, 0, 3, 3, 3, 7, 7, 7, 7, 0, 0] and set(pairs(A.wcc_scan(g, 10)).values()) == {0}
    assert len(spark.catalog.listTables()) <= before + 4
    r = A.Rounds(A._ranked_edges(g), A.degree(g).select("id", "degree", F.lit(0.1).alias("rank")), 13)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A._round(r, F.col("rank") / F.col("d"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == (1 if rows == 0 else 2), plan  # the partial sums, and a state that is small


def test_frontiers(spark, g):
    s = Fr.VertexSubset.from_flags(spark, [False, True, False, True, True, False])
    assert s.size() == 3 and s.contains(3) and not s.contains(0) and [r[0] for r in s.to_sparse().collect()] == [1, 3, 4]
    reached = pairs(Fr.edge_map(g, Fr.VertexSubset.of(spark, [0]), F.min("message")))
    assert reached == {1: 0, 2: 0, 3: 0}
    assert Fr.VertexSubset.of(spark, []).is_empty()


def test_distributions(spark, g):
    d = pairs(D.degree_distribution(g, 2))
    assert math.isclose(sum(d.values()), 100) and set(d) == {0, 2, 4, 6}
    assert D.degree_distribution(g, 0).count() == 0
    p = spark.createDataFrame([(0, 50.0), (10, 50.0)], "range_start long, percentage double")
    q = spark.createDataFrame([(0, 25.0), (10, 75.0)], "range_start long, percentage double")
    want = 0.5 * math.log(2) + 0.5 * math.log(0.5 / 0.75)
    assert math.isclose(D.kl_divergence(p, q), want) and D.kl_divergence(p, p) == 0
    assert D.kl_divergence(p, p.limit(0)) == math.inf
    assert pairs(D.resample(p, 10, 20)) == {0: 100.0} and pairs(D.resample(p, 10, 5)) == {0: 25.0, 5: 25.0, 10: 25.0, 15: 25.0}


def test_rounds_have_buckets_for_their_edges(spark, g, monkeypatch):
    """A bucket is bounded whatever the session's partitions are, and its edges are not sorted."""
    monkeypatch.setattr(A, "STATE_ROWS", 0)
    monkeypatch.setattr(R, "TASK_ROWS", 4)
    r = A.Rounds(g.edges, g.vertices.select("id", F.col("id").alias("label")), 13)
    assert r.given("label").rdd.getNumPartitions() == 10 and r.edges.count() == 40
    r.next(r.told(r.given("label").groupBy("dst").agg(F.min("label").alias("offer"))).select("id", F.least("label", "offer").alias("label")))
    assert r.given("label").rdd.getNumPartitions() == 10 and pairs(r.state)[12] == 11
    plan = r.given("label")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan and "Exchange" not in plan, plan


def test_components_are_worked_out_in_sized_stages(spark, g, monkeypatch):
    seen, real = [], R.sized
    for module in (A, C):
        monkeypatch.setattr(module, "sized", lambda s, n: seen.append(n) or real(s, n))
    labels = A.wcc(g)
    assert seen[0] == 2 * 12 and seen[-1] == 2 * 13 and labels._meshwork_path and set(pairs(labels).values()) == {0}


def test_a_forest_takes_little_memory():
    """Some 150 bytes an edge in arrays, where a dictionary and lists of Python numbers took twice that."""
    n = 200_000
    rng = np.random.default_rng(1)
    batches = [pa.RecordBatch.from_arrays([pa.array(rng.integers(0, n, n // 4)), pa.array(rng.integers(n, 2 * n, n // 4))], names=["src", "dst"]) for _ in range(4)]
    tracemalloc.start()
    try:
        found = list(C._forest(batches))
        assert tracemalloc.get_traced_memory()[1] < 170 * n
    finally:
        tracemalloc.stop()
    up = {v: r for b in found for v, r in zip(*(c.to_pylist() for c in b.columns))}
    assert all(up.get(a, a) == up.get(b, b) for x in batches for a, b in zip(*(c.to_pylist() for c in x.columns)))
    assert all(r not in up and r < v for v, r in up.items())
