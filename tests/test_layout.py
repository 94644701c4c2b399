"""Orders, partitions, samples, workloads, codec, settings, command line."""

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshwork import cli, config
from meshwork.functions import codec
from meshwork.graph import from_edges
from meshwork.operators import layout as L
from meshwork.operators import ordering
from meshwork.operators import sampling as S
from meshwork.operators import topology as T
from meshwork.operators.components import connected_components
from meshwork.operators.frontier import prefix_scan
from meshwork.operators.ordering import rank_rows
from meshwork.operators.topology import degree, locality_score
from meshwork.runtime import ship
from meshwork.sources import workload as W
from tests.test_topology import EDGES


@pytest.fixture(scope="module")
def g(spark):
    return from_edges(spark.createDataFrame(EDGES + [(20, 21), (22, 21)], "src long, dst long"), spark.createDataFrame([(30,)], "id long")).materialised()


def test_orders(g):
    rows = L.degree_order(g).orderBy("pos").collect()
    assert [r["id"] for r in rows[:3]] == [3, 7, 4]
    inner = {r["id"]: r["degree"] for r in L.internal_degree_order(g, [0, 1, 2, 12]).collect()}
    assert inner == {0: 2, 1: 2, 2: 2, 12: 0}
    order = [r["id"] for r in L.bfs_order(g, 0).orderBy("pos").collect()]
    assert sorted(order) == sorted(r[0] for r in g.vertices.select("id").collect()) and order[0] == 0 and order[-4:] == [20, 21, 22, 30]
    window = L.window_order(g, g.vertices.select("id", F.lit(0).cast("long").alias("block")), 5)
    assert sorted(r["pos"] for r in window.collect()) == list(range(17))
    assert locality_score(g, window.select("id", "pos")).first()[0] < 10


def test_partitions(g):
    blocks = L.weight_bounded_partition(g, 12)
    assert blocks.count() == blocks.select("id").distinct().count() == 17
    heavy = L.block_weight(g, blocks).where("weight > 12 AND vertices > 1").count()
    assert heavy == 0
    names = sorted(r[0] for r in blocks.select("block").distinct().collect())
    assert names == list(range(len(names)))
    assert L.kway_partition(g, 4).select("block").distinct().count() == 4
    assert L.kway_partition(g, 99).select("block").distinct().count() == 17
    with pytest.raises(ValueError):
        L.weight_bounded_partition(g, 0)


@pytest.mark.parametrize("cap", [1, 2, 3])
def test_sparsify(g, cap):
    kept = {tuple(r) for r in L.sparsify(g, cap).collect()}
    whole = {tuple(r) for r in g.edges.collect()}
    assert kept <= whole and all((b, a) in kept for a, b in kept)
    used = {}
    for a, _ in kept:
        used[a] = used.get(a, 0) + 1
    assert max(used.values()) <= cap
    assert not any(used.get(a, 0) < cap and used.get(b, 0) < cap for a, b in whole - kept)


def greedy_sparsify(edges, cap):
    """The two passes, edge by edge."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    order = sorted({(min(e), max(e)) for e in edges}, key=lambda e: (-len(near[e[0]]) - len(near[e[1]]), e))
    used, up, kept = Counter(), {}, []

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for forest in (True, False):
        for a, b in order:
            if (a, b) not in kept and used[a] < cap and used[b] < cap and (not forest or root(a) != root(b)):
                up[root(a)] = root(b)
                kept.append((a, b)), used.update((a, b))
    return set(kept)


@pytest.mark.parametrize("cap", [1, 3])
def test_sparsify_is_the_greedy_pass(spark, cap):
    rng = random.Random(cap)
    for n, m in ((20, 40), (12, 60)):
        edges = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}
        edges |= {(0, i) for i in range(1, n)}  # a hub
        got = {tuple(r) for r in L.sparsify(from_edges(spark.createDataFrame(sorted(edges), "src long, dst long")), cap).collect()}
        assert {e for e in got if e[0] < e[1]} == greedy_sparsify(edges, cap) and all((b, a) in got for a, b in got)


def test_sparsify_keeps_a_connected_graph_connected(spark):
    for edges, cap in (([(i, i + 1) for i in range(4)], 2), ([(a, b) for a in range(6) for b in range(a)], 3)):
        kept = L.sparsify(from_edges(spark.createDataFrame(edges, "src long, dst long")), cap)
        assert connected_components(kept).select("label").distinct().count() == 1


def test_sparsify_writes_no_copy_of_the_edges_that_are_left(spark, monkeypatch):
    tags, real = [], L.materialise
    monkeypatch.setattr(L, "materialise", lambda df, tag="t": tags.append(tag) or real(df, tag))
    kept = L.sparsify(from_edges(spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "src long, dst long")), 2)
    assert kept.count() == 6 and "left" not in tags and tags.index("chosen") < tags.index("ready")


def test_sparsify_nothing(g, spark):
    assert L.sparsify(g, 0).count() == 0
    assert L.sparsify(from_edges(spark.createDataFrame([], "src long, dst long")), 3).count() == 0


def brute_window(ids, edges, window):
    """Scores counted anew at each step: edges and common neighbours with the last few."""
    near = {i: [b for a, b in edges if a == i] for i in ids}
    out = []
    while len(out) < len(ids):
        score = Counter()
        for v in out[-window:]:
            for x in near[v]:
                score[x] += 1
                score.update(near[x])
        left = [i for i in ids if i not in out]
        best = min(left, key=lambda i: (-score[i], i))
        out.append(best if score[best] > 0 else min(left, key=lambda i: (-len(near[i]), i)))
    return out


@pytest.mark.parametrize("hub", [3, 64])
def test_window_order_against_brute_force(monkeypatch, hub):
    monkeypatch.setattr(L, "HUB_DEGREE", hub)
    rng = random.Random(hub)
    for n, m in ((12, 20), (30, 60), (25, 200)):
        pairs = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b} | {(0, i) for i in range(1, n)}
        both = sorted(pairs | {(b, a) for a, b in pairs})
        assert L._window_order(list(range(n)), both, 4) == brute_window(list(range(n)), both, 4)


def test_window_order_of_a_star_is_not_quadratic(monkeypatch):
    pushes = []
    push = L.heapq.heappush
    monkeypatch.setattr(L.heapq, "heappop", lambda q, pop=L.heapq.heappop: pushes.append(0) or pop(q))
    monkeypatch.setattr(L.heapq, "heappush", lambda q, x: pushes.append(1) or push(q, x))
    n = 2000
    both = [e for i in range(n) for e in ((i, n), (n, i))]
    assert L._window_order(list(range(n + 1)), both, 20) == [n, *range(n)]
    assert len(pushes) < 20 * n


def test_large_blocks_are_cut(g, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_VERTICES", 6)
    blocks = g.vertices.select("id", F.when(F.col("id") < 13, 0).otherwise(1).cast("long").alias("block"))
    rows = L.window_order(g, blocks, 5).collect()
    for block, n in ((0, 13), (1, 4)):
        assert sorted(r["pos"] for r in rows if r["block"] == block) == list(range(n))


def test_partition_is_saved(g, spark, tmp_path):
    assert L.load_partition(spark, str(tmp_path / "p")) is None
    blocks = L.weight_bounded_partition(g, 12)
    L.save_partition(blocks, str(tmp_path / "p"))
    assert sorted(map(tuple, L.load_partition(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, blocks.collect()))
    assert {r["block"]: r["members"] for r in L.collect_blocks(blocks).collect()}[0] == sorted(r["id"] for r in blocks.where("block = 0").collect())


def test_samples(g):
    s = S.sample_bfs(g, 0, 5)
    assert sorted(r[0] for r in s.vertices.select("id").collect()) == [0, 1, 2, 3, 4]
    walk = S.sample_random_walk(g, 0, 6, seed=1)
    edges = {tuple(r) for r in g.edges.collect()}
    assert walk.count() and all((r["src"], r["dst"]) in edges for r in walk.collect())
    seen = {0} | {r["dst"] for r in walk.collect()}
    assert len(seen) == 6 and {r["src"] for r in walk.collect()} <= seen
    assert sorted(map(tuple, S.sample_random_walk(g, 0, 6, seed=1).collect())) == sorted(map(tuple, walk.collect()))
    assert S.sample_random_walk(g, 20, 50, seed=1, max_steps=60).count() > 0
    assert S.sample_random_walk(g, 30, 5).count() == 0


def test_rank_rows_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert [tuple(r) for r in rank_rows(df, ["x"]).orderBy("x").collect()] == [(i, i) for i in range(1000)]


def test_one_hot_value_does_not_make_one_hot_range(spark, monkeypatch):
    """Nine in ten rows are equal in the first column, as most vertices of a graph have degree one."""
    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)
    df = spark.range(3000).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("d"), (F.col("id") * 7919 % 3000).alias("x"), (F.col("id") % 13).alias("w")).cache()
    rows, parts = ordering.ranged(df, ["d", "x"])
    assert parts == 30 and rows.groupBy("__part").count().agg(F.max("count")).first()[0] < 300
    want = sorted(map(tuple, df.collect()))
    got = sorted((r["rank"], r["d"], r["x"]) for r in rank_rows(df, ["d", "x"]).collect())
    assert got == [(i, d, x) for i, (d, x, _) in enumerate(want)]
    sums = {(r["d"], r["x"]): (r["before"], r["upto"]) for r in ordering.cumulative(ordering.running(df, ["d", "x"], "w", "before"), ["d", "x"], "w", "upto").collect()}
    total = 0
    for d, x, w in want:
        assert sums[d, x] == (total, total + w)
        total += w


def test_prefix_scan_of_sparse_numbers(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 50)
    keys = [*range(500), 10**12, 10**15]
    rows = prefix_scan(spark.createDataFrame([(k, k % 7) for k in keys], "k long, v long"), "k", "v").orderBy("k").collect()
    assert [r["prefix"] for r in rows] == [sum(k % 7 for k in keys[:i]) for i in range(len(keys))] and {r["total"] for r in rows} == {sum(k % 7 for k in keys)}
    assert prefix_scan(spark.createDataFrame([], "k long, v long"), "k", "v").count() == 0


def test_workload(spark):
    rows = W.random_workload(spark, 50, 7, 1).collect()
    assert len(rows) == 350 and len({(r["src"], r["dst"]) for r in rows}) == 350 and all(r["src"] != r["dst"] and 0 <= r["dst"] < 50 for r in rows)
    with pytest.raises(ValueError):
        W.random_workload(spark, 3, 3)


def brute_counts(n, edges, alpha, cap):
    """Rounds of sharing out by weight, cut at the cap; then one more each by the largest remainder."""
    limit, weights = cap or edges, [(i + 1) ** -alpha for i in range(n)]
    full = set()
    while True:
        total = sum(w for i, w in enumerate(weights) if i not in full) or 1.0
        share = [float(limit) if i in full else w / total * (edges - limit * len(full)) for i, w in enumerate(weights)]
        over = {i for i, x in enumerate(share) if x > limit} - full
        if not over:
            break
        full |= over
    counts = [min(math.floor(x + 1e-9), limit) for x in share]
    missing = edges - sum(counts)
    while missing > 0:
        for i in sorted((i for i in range(n) if counts[i] < limit), key=lambda i: (counts[i] - share[i], i))[:missing]:
            counts[i] += 1
        missing = edges - sum(counts)
    return counts


@pytest.mark.parametrize("n, edges, alpha, cap", [(20, 200, 1.5, 15), (40, 400, 0.7, 0), (7, 70, 0.0, 10), (30, 17, 2.5, 3), (5, 0, 1.0, 2), (1, 9, 1.0, 9)])
def test_zipf_counts(spark, n, edges, alpha, cap):
    got = [r["n"] for r in W.zipf_counts(spark, n, edges, alpha, cap).orderBy("rank").collect()]
    assert sum(got) == edges and (not cap or max(got) <= cap) and got == brute_counts(n, edges, alpha, cap)
    with pytest.raises(ValueError):
        W.zipf_counts(spark, 4, 20, 1.0, 4)


def test_zipf_list(spark):
    lst = spark.createDataFrame([(i, i % 20, 100 + i % 10) for i in range(200)], "seq long, src long, dst long")
    out = W.to_zipf(lst, 1.5, 42, 15)
    counts = sorted((r["count"] for r in out.groupBy("src").count().collect()), reverse=True)
    assert out.count() == 200 and counts[0] == 15
    with pytest.raises(ValueError):
        W.to_zipf(lst, -1.0, 42)
    again = W.replay_order(lst, "RANDOM", 3)
    assert sorted(r["seq"] for r in again.collect()) == list(range(200))
    assert [r["seq"] for r in W.replay_range(lst, 5, 3).orderBy("seq").collect()] == [5, 6, 7]


def test_codec(spark):
    lists = [[], [0], [63, 64], [16383, 16384, 4194303, 4194304, codec.MAX_VALUE]]
    df = ship(spark).createDataFrame([(x,) for x in lists], "ids array<long>")
    got = df.select("ids", codec.decode_ids(codec.encode_ids(F.col("ids"))).alias("back"), F.length(codec.encode_ids(F.col("ids"))).alias("n")).collect()
    assert all(r["ids"] == r["back"] for r in got) and sorted(r["n"] for r in got) == [0, 1, 3, 16]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([([1 << 30],)], "ids array<long>").select(codec.encode_ids(F.col("ids"))).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1 << 40), unique=True, max_size=300).map(sorted), max_size=6), st.integers(0, 2))
def test_gap_and_frame_codecs(lists, skip):
    ids = pa.array([[], [0], *lists], pa.list_(pa.int64())).slice(min(skip, 2))
    for encode, decode in ((codec.encode_gap_lists, codec.decode_gap_lists), (codec.encode_frame_lists, codec.decode_frame_lists)):
        assert decode(encode(ids)).to_pylist() == ids.to_pylist()
    with pytest.raises(ValueError):
        codec.encode_gap_lists(pa.array([[3, 3]]))


def test_a_giant_list_is_decoded_in_little_time():
    rng = np.random.default_rng(3)
    ids = np.unique(rng.integers(0, codec.MAX_VALUE, 1_000_000))
    gaps, frames = codec.encode_gap_lists(pa.array([ids])), codec.encode_frame_lists(pa.array([ids]))
    began = time.perf_counter()
    assert codec.decode_gap_lists(gaps)[0].values.to_numpy().tolist() == codec.decode_frame_lists(frames)[0].values.to_numpy().tolist() == ids.tolist()
    tagged = b"".join(int(x + (3 << 30)).to_bytes(4, "big") for x in ids[:300_000])
    assert codec.decode_tagged(pa.array([tagged]))[0].values.to_numpy().tolist() == ids[:300_000].tolist()
    assert time.perf_counter() - began < 10 and len(frames[0].as_py()) < len(gaps[0].as_py()) * 1.1


def test_config_and_cli(spark, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text("algo:\n  iterations: 2 * 3  # six\n  damping: 0.5\nunknown: 1\n")
    assert config.load(str(tmp_path / "c.yaml")).iterations == 6 and config.number("1024 * 16") == 16384
    (tmp_path / "g.graph").write_text("t 4 2\ne 0 1\ne 1 2\n")
    for args in (["bfs", "--start", "0"], ["wcc", "--algo", "sequential"], ["pagerank", "--iters", "2", "--result", str(tmp_path / "out")], ["cdlp"], ["bfs", "--benchmark"], ["bfs", "--mem", "--divisor", "2", "--prefetch-workers", "4"]):
        assert cli.main([args[0], str(tmp_path / "g.graph"), *args[1:]], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert cli.main(["wcc", str(tmp_path / "g.graph"), "--algo", "none"], spark) == 1
    assert "unknown algorithm" in capsys.readouterr().err


def test_degree_counts_isolated(g):
    assert degree(g).where("id = 30").first()["degree"] == 0


def test_frames_of_short_lists_are_made_together(monkeypatch):
    """A call for many lists, not one for each; cuts between blocks change nothing."""
    ids = pa.array([[i] for i in range(5000)] + [list(range(0, 3000, 7)), None, [5, 2**40]], pa.list_(pa.int64()))
    want, calls, real = codec.encode_frame_lists(ids), [], codec._frames
    monkeypatch.setattr(codec, "FRAME_GAPS", 1000)
    monkeypatch.setattr(codec, "_frames", lambda gaps, sizes: calls.append(len(sizes)) or real(gaps, sizes))
    assert codec.encode_frame_lists(ids).equals(want) and len(calls) == 6
    assert codec.decode_frame_lists(want).to_pylist() == [x or [] for x in ids.to_pylist()]
    for bad in (b"\x05", b"\x01\x08\x00", want[0].as_py() + b"\x00", b"\x80"):
        with pytest.raises(ValueError):
            codec.decode_frame_lists(pa.array([bad]))


def test_adjacency_is_written_in_sized_stages(g, monkeypatch):
    seen, real = [], T.sized
    monkeypatch.setattr(T, "sized", lambda s, n: seen.append(n) or real(s, n))
    lists = {r[0]: r[1] for r in T.induced_map(g, [3, 12]).collect()}
    assert lists[12] == [11] and len(lists[3]) == 6 and seen == [g.edges.count()]
