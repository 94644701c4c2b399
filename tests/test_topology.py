"""Graphs, text formats, point reads and subgraphs on the 13-vertex fixture."""

import random

import pytest
from pyspark.sql import functions as F

from meshwork.graph import from_csr, from_edges, from_map, list_rows
from meshwork.operators import topology as T
from meshwork.plans.block_index import build
from meshwork.sources.text import EdgeList, load_graph, save_graph

EDGES = [(0, 2), (1, 0), (1, 2), (1, 3), (2, 3), (3, 0), (3, 4), (3, 11), (4, 6), (4, 7), (5, 4), (6, 5), (7, 3), (7, 8), (7, 9), (8, 9), (8, 10), (10, 7), (10, 9), (11, 12)]
COMMUNITY = {**dict.fromkeys(range(4), 0), **dict.fromkeys((4, 5, 6), 1), **dict.fromkeys(range(7, 11), 2), 11: 3, 12: 3}


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("g") / "small.graph"
    lines = ["# a comment", "", "t 13 20", *[f"v {i} 0 {COMMUNITY[i]}" for i in range(13)], *[f"e {a}\t{b}" for a, b in EDGES]]
    return load_graph(spark, write(path, lines)).materialised()


def test_loaded_counts_and_degrees(small):
    assert T.edge_count(small) == 40 and T.vertex_count(small) == 13
    got = [r["degree"] for r in T.degree(small).orderBy("id").collect()]
    assert got == [3, 3, 3, 6, 4, 2, 2, 5, 3, 3, 3, 2, 1]


def test_map_is_directed_and_file_is_not(spark):
    lists = {i: [b for a, b in EDGES if a == i] for i in range(13)}
    g = from_map(spark, lists)
    assert T.edge_count(g) == 20 and T.vertex_count(g) == 13
    assert [r[0] for r in g.vertices.orderBy("id").select("community").collect()] == list(range(13))


def test_header_bounds_edges_and_ids(spark, tmp_path):
    g = load_graph(spark, write(tmp_path / "a.graph", ["t 3 3", "e 0 1", "e 1 1", "e 1 5"]))
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1), (1, 0)] and g.vertices.count() == 3
    g = load_graph(spark, write(tmp_path / "b.graph", ["e 0 4", "e 0 4", "e 4 0"]), dedup=False)
    assert g.vertices.count() == 5 and g.edges.count() == 6
    with pytest.raises(Exception, match="too large"):
        load_graph(spark, write(tmp_path / "c.graph", ["e 0 1000000001"])).edges.collect()


def test_save_and_load(small, spark, tmp_path):
    save_graph(small, str(tmp_path / "out"))
    again = load_graph(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, small.edges.collect()))
    assert again.vertices.where("community = 2").count() == 4


def test_csr(spark):
    g = from_csr(spark, [0, 2, 3, 3], [1, 2, 0], [5, 5, 6])
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1), (0, 2), (1, 0)] and T.community_of(g, 2) == 6


def test_lists_keep_their_order_and_any_ids(spark):
    rows = list_rows(spark, {90: [5, 3, 4], 7: [], 1_000_000_007: [90]}).orderBy("pos").collect()
    assert [(r["id"], r["neighbors"]) for r in rows] == [(7, []), (90, [5, 3, 4]), (1_000_000_007, [90])]


def test_warm_graphs_read_the_same(small):
    warm = T.warm_up(small)
    assert warm.edges.storageLevel.useMemory and T.edge_count(warm) == 40
    warm.edges.unpersist(), warm.vertices.unpersist()


def test_tree_export(small, spark, tmp_path):
    tree = build(small.edges, small.vertices.select("id", F.col("community").alias("block")), 4).tree
    T.export_tree_json(tree, str(tmp_path / "tree"))
    rows = spark.read.json(str(tmp_path / "tree")).collect()
    assert len(rows) == tree.count() and sum(r["num_blocks"] for r in rows) == len(rows) - 1


def test_membership_never_raises_but_communities_do(small):
    assert T.has_edge(small, 0, 2) and T.has_edge(small, 2, 0) and not T.has_edge(small, 0, 12)
    assert T.has_vertex(small, 12) and not T.has_vertex(small, 13)
    assert T.neighbors(small, 99).count() == 0
    with pytest.raises(ValueError):
        T.community_members(small, 9)


def test_induced(small):
    g = T.induced_subgraph(small, [0, 1, 2, 3])
    assert g.vertices.count() == 4 and T.has_edge(g, 3, 0) and not T.has_edge(g, 3, 4)
    with pytest.raises(ValueError):
        T.induced_subgraph(small, [0, 999])
    assert {r[0] for r in T.community_subgraph(small, 0).vertices.select("id").collect()} == {0, 1, 2, 3}
    whole = {r["id"]: r["neighbors"] for r in T.induced_map(small, [3]).collect()}
    assert whole == {3: [0, 1, 2, 4, 7, 11]}
    assert {r["id"]: r["neighbors"] for r in T.induced_map(small, [3, 4], pruning=True).collect()} == {3: [4], 4: [3]}


def test_quotient_and_tree(small):
    blocks = small.vertices.select("id", F.col("community").alias("block"))
    q = {tuple(r) for r in T.block_adjacency(small.edges, blocks).collect()}
    assert q == {(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1), (0, 3), (3, 0)}


def brute_tree(edges, members, cap):
    """(level, block, parent) rows: blocks in search order of their graph, ``cap`` to a parent, up to one root."""
    rows, level, block = [], 0, dict(members)
    pairs = {(block[a], block[b]) for a, b in edges if block[a] != block[b]}
    names = sorted(set(block.values()))
    while len(names) > 1:
        near = {n: sorted({b for a, b in pairs if a == n}) for n in names}
        order, start = [], max(names, key=lambda n: (len(near[n]), -n))
        comps = {}
        for n in names:
            todo, seen = [n], {n}
            while todo:
                x = todo.pop()
                for y in near[x]:
                    if y not in seen:
                        seen.add(y), todo.append(y)
            comps[n] = min(seen)
        roots = [start] + sorted(c for c in set(comps.values()) if c != comps[start])
        for root in roots:
            queue, seen = [root], {root}
            for x in queue:
                for y in near[x]:
                    if y not in seen:
                        seen.add(y), queue.append(y)
            order += queue
        parent = {n: i // cap for i, n in enumerate(order)}
        rows += [(level, n, parent[n]) for n in names]
        pairs = {(parent[a], parent[b]) for a, b in pairs if parent[a] != parent[b]}
        names, level = sorted(set(parent.values())), level + 1
    return sorted([*rows, *((level, n, None) for n in names)], key=lambda r: r[:2])


@pytest.mark.parametrize("seed", [1, 2])
def test_block_tree_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(90)]
    both = {(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b}
    members = {v: v * 7 % 23 for v in range(80)}
    index = build(spark.createDataFrame(sorted(both), "src long, dst long"), spark.createDataFrame(sorted(members.items()), "id long, block long"), 5)
    tree = sorted((tuple(r) for r in index.tree.select("level", "block", "parent").collect()), key=lambda r: r[:2])
    assert tree == brute_tree(both, members, 3)
    # reads
    assert [r[0] for r in index.neighbor_blocks(0, 5).collect()] == sorted({members[b] for a, b in both if members[a] == 5 and members[b] != 5})
    lists = {r["block"]: r["neighbors"] for r in index.block_adjacency(0).collect()}
    assert set(lists) == set(range(23)) and lists[5] == [r[0] for r in index.neighbor_blocks(0, 5).collect()]
    kids = {r[0] for r in index.blocks(0, index.parent(0, 5)).collect()}
    assert 5 in kids and len(kids) <= 3 and index.parent(99, 0) is None


def test_block_tree_maintenance(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(19)] + [(i + 1, i) for i in range(19)], "src long, dst long")
    members = spark.range(20).select("id", (F.col("id") / 2).cast("long").alias("block"))
    index = build(edges, members, 5)
    more = index.insert_edge(0, 9)
    assert 9 in [r[0] for r in more.neighbor_blocks(0, 0).collect()] and more.neighbor_blocks(1, more.parent(0, 0)).count() >= index.neighbor_blocks(1, index.parent(0, 0)).count()
    # a block is written anew under another name, then split in two, then in many: the tree still covers every block once
    for new in ([40], [40, 41], [50, 51, 52, 53, 54, 55]):
        moved = members.where("block = 3").select("id", F.element_at(F.array(*[F.lit(b) for b in new]), (F.col("id") % len(new) + 1).cast("int")).cast("long").alias("block"))
        after = index.replace_block(3, new, moved, edges)
        used = {r[0] for r in after.members.select("block").distinct().collect()}
        got = [r[0] for r in after.tree.where("level = 0").select("block").collect()]
        assert used <= set(got) and 3 not in got and len(got) == len(set(got)) and after.tree.where("parent IS NULL").count() == 1
        sizes = after.tree.where("parent IS NOT NULL").groupBy("level", "parent").count().agg(F.max("count")).first()[0]
        assert sizes <= 5


def test_statistics(small):
    assert T.graph_statistics(small).first().asDict() == {"vertices": 13, "edges": 40, "avg_degree": 40 / 13, "min_degree": 1, "max_degree": 6}
    assert T.community_statistics(small).first().asDict() == {"communities": 4, "avg_size": 3.25, "min_size": 2, "max_size": 4}


def test_edge_lists(spark, tmp_path):
    lst = EdgeList(spark, "x")
    assert lst.path == "data/x.delta" and not lst.load(str(tmp_path / "none"))
    assert lst.load(write(tmp_path / "x.delta", ["0 1", "# no", "", "1 2"])) and lst.count() == 2
    lst.add([(2, 3)])
    assert [tuple(r)[1:] for r in lst.edges.orderBy("seq").collect()] == [(0, 1), (1, 2), (2, 3)]
    assert lst.statistics().first().asDict() == {"edges": 3, "vertices": 4, "max_id": 3}
    lst.clear()
    assert lst.count() == 0


def test_empty_graph(spark):
    g = from_edges(spark.createDataFrame([], "src long, dst long"))
    assert T.graph_statistics(g).first()["edges"] == 0 and T.degree(g).count() == 0
