"""Delta log, store, transactions, properties, streaming."""

import time

import pytest
from pyspark.sql import functions as F

from meshwork.graph import from_edges, from_map
from meshwork.operators import deltas as D
from meshwork.plans.manifest import ConflictError
from meshwork.plans.properties import PropertyStore
from meshwork.plans import store as S
from meshwork.plans.small import MutableGraph, SmallGraph
from meshwork.plans.store import READERS, GraphStore
from meshwork.streaming import ingest


@pytest.fixture
def store(spark, tmp_path):
    g = from_edges(spark.createDataFrame([(0, 1), (0, 2), (3, 4), (5, 6)], "src long, dst long"), spark.createDataFrame([(7,)], "id long"))
    return GraphStore.create(g, str(tmp_path / "store"))


def test_merge_on_read(store):
    assert store.delete_edge(0, 3) and store.insert_edge(0, 3)
    assert store.neighbors(0) == [1, 2, 3] and store.base_neighbors(0) == [1, 2]
    assert store.insert_edge(0, 3) and store.neighbors(0) == [1, 2, 3]
    assert store.delete_edge(0, 1) and store.neighbors(0) == [2, 3] and store.neighbors(1) == [0]
    assert not store.insert_edge(0, 99) and not store.delete_edge(99, 0)


def test_compaction_keeps_what_is_read_and_reopening_too(store, spark):
    store.insert_edge(0, 5), store.delete_edge(0, 2), store.insert_edge(0, 2), store.delete_edge(3, 4)
    before = {v: store.neighbors(v) for v in range(8)}
    again = GraphStore.open(spark, store.manifest.root)
    assert {v: again.neighbors(v) for v in range(8)} == before
    ts = again.latest_commit
    again.compact(watermark=ts)
    with pytest.raises(ValueError, match="gone"):
        again.neighbors(0, ts - 2)
    assert again.deltas().count() == 1 and {v: again.neighbors(v) for v in range(8)} == before
    again.compact(), again.compact()
    assert again.deltas().count() == 0 and {v: again.base_neighbors(v) for v in range(8)} == before
    again.vacuum()
    assert again.neighbors(0) == before[0]
    again.close(), again.close()
    with pytest.raises(FileNotFoundError):
        GraphStore.open(spark, store.manifest.root + "-none")


def test_vertices(store):
    assert not store.insert_vertex(0) and store.delete_vertex(0, remove_neighbors=True) and not store.delete_vertex(0)
    g = store.snapshot()
    assert g.vertices.where("id = 0").count() == 0 and g.edges.where("src = 0 OR dst = 0").count() == 0
    assert store.insert_vertex(0) and store.neighbors(0) == []
    assert store.insert_vertex_with_neighbors([1, 2]) == 8 and store.neighbors(8) == [1, 2] and store.neighbors(1) == []
    store.insert_vertices({11: [0]})
    assert store.vertices().count() == 12 and store.neighbors(11) == [0]
    with pytest.raises(ValueError):
        store.insert_vertices({3: [0]})


def test_transactions(store):
    t, old = store.begin(), store.begin()
    t.insert_edge(0, 3)
    assert t.neighbors(0) == [1, 2]
    ts = t.commit()
    assert old.neighbors(0) == [1, 2] and store.begin().neighbors(0) == [1, 2, 3] and ts == store.latest_commit
    with pytest.raises(RuntimeError):
        t.insert_edge(0, 4)
    with store.begin() as u:
        u.delete_edge(0, 3)
    assert store.neighbors(0) == [1, 2] and store.neighbors(0, ts) == [1, 2, 3]
    bad = store.begin()
    bad.insert_edge(0, 1234)
    with pytest.raises(ValueError):
        bad.commit()
    bad2 = store.begin()
    bad2.insert_edge(0, 5), bad2.abort()
    assert store.neighbors(0) == [1, 2]


def test_serializable_conflict(store):
    a, b = store.begin(serializable=True), store.begin(serializable=True)
    a.neighbors(0), b.neighbors(0)
    a.insert_edge(0, 4), b.insert_edge(0, 5)
    a.commit()
    with pytest.raises(ConflictError):
        b.commit()
    c = store.begin(serializable=True)
    c.neighbors(5), c.insert_edge(5, 7)
    store.insert_edge(3, 5)
    c.commit()
    assert store.neighbors(0) == [1, 2, 4] and store.neighbors(5) == [6, 7]


def test_a_transaction_reads_the_same_after_compaction(store):
    t = store.begin()
    assert t.neighbors(0) == [1, 2]
    store.delete_edge(0, 1), store.insert_edge(0, 5)
    store.compact(), store.compact(watermark=99)
    store.vacuum()
    assert t.neighbors(0) == [1, 2] and sorted(map(tuple, t.snapshot().edges.where("src = 0").collect())) == [(0, 1), (0, 2)]
    assert store.neighbors(0) == [2, 5]
    t.abort()
    store.vacuum()
    assert store.manifest.versions() == [store.version]


def test_watermark_defers_what_an_open_transaction_does_not_see(store):
    with store.begin() as early:
        early.insert_edge(3, 5)
    store.insert_edge(4, 6)
    reader = store.begin()
    assert reader.neighbors(3) == [4, 5] and store.watermark() == reader.read_ts
    store.insert_edge(3, 7)
    store.compact()
    assert store.base_neighbors(3) == [4, 5] and store.deltas().where("src = 3").count() == 1
    assert reader.neighbors(3) == [4, 5] and store.begin().neighbors(3) == [4, 5, 7]
    reader.abort()
    assert READERS.snapshots(store.manifest.root) == 1  # the reader begun in between


def test_merged_after_the_oldest_reader_ended(store):
    reader = store.begin()
    store.insert_edge(3, 7)
    store.compact()
    assert store.base_neighbors(3) == [4]
    reader.abort(), store.insert_edge(6, 7), store.compact()
    assert store.base_neighbors(3) == [4, 7] and store.deltas().count() == 0


def test_staged_bases_are_read_after_their_publication(spark, tmp_path):
    store = GraphStore.create(from_map(spark, {0: [1], 1: [0], 2: []}), str(tmp_path / "s"))
    store.insert_edge(0, 2)
    store.compact(publish=False)
    assert store.pending() == 1 and store.base_neighbors(0) == [1] and store.neighbors(0) == [1, 2]
    store.insert_edge(1, 2), store.delete_edge(0, 1)
    store.publish_pending()
    assert store.pending() == 0 and store.base_neighbors(0) == [1, 2] and store.base_neighbors(1) == [0]
    assert store.neighbors(0) == [2] and store.neighbors(1) == [0, 2] and store.deltas().count() == 2
    store.compact()
    assert store.base_neighbors(0) == [2] and store.deltas().count() == 0


def test_a_writer_that_died_blocks_nobody(store, monkeypatch):
    """It wrote its manifest aside, and perhaps its parts, and got no further."""
    monkeypatch.setattr(type(store.manifest), "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.insert_edge(0, 3)
    monkeypatch.undo()
    began = time.perf_counter()
    assert store.neighbors(0) == [1, 2] and store.insert_edge(0, 4) and store.neighbors(0) == [1, 2, 4]
    assert time.perf_counter() - began < 15


def test_many_commits_leave_short_logs(store, spark, monkeypatch):
    monkeypatch.setattr(S, "TIER_PARTS", 3)
    monkeypatch.setattr(S, "KEPT_WRITES", 4)
    staged = GraphStore.open(spark, store.manifest.root)
    staged.compact(publish=False)
    late = store.begin(serializable=True)
    late.neighbors(0)
    for i in range(10):
        assert store.insert_edge(0, 3 + i % 5) if i % 3 else store.delete_edge(0, 3 + i % 5)
    state = store.manifest.read()
    assert len(state["deltas"]) <= 5 and len(state["writes"]) == 4 and store.deltas().count() == 10
    want = store.neighbors(0)
    staged.publish_pending()
    assert store.neighbors(0) == want
    late.insert_edge(1, 2)
    with pytest.raises(ConflictError):
        late.commit()
    store.compact()
    assert store.base_neighbors(0) == want


def test_a_vertex_costs_a_record(store, spark):
    before = store.manifest.read()
    assert store.delete_vertex(0, remove_neighbors=True)
    after = store.manifest.read()
    assert after["version"] == before["version"] + 1 and after["vertices"] == before["vertices"]
    assert store.neighbors(1) == [] and store.vertices().where("deleted").count() == 1
    store.insert_vertices(spark.createDataFrame([(9, [1, 2]), (8, [])], "id long, neighbors array<long>"))
    assert store.neighbors(9) == [1, 2] and store.vertices().count() == 10 and store.manifest.read()["top_id"] == 9
    store.compact()
    assert store.manifest.read()["vertex_log"] == [] and store.vertices().where("deleted").count() == 1 and store.neighbors(9) == [1, 2]


def test_only_one_writer_makes_a_version(store):
    state = store.manifest.read()
    store.manifest.commit(state | {"version": 1})
    with pytest.raises(ConflictError):
        store.manifest.commit(state | {"version": 1})


def test_layout_does_not_change_reads(spark, tmp_path, store):
    blocks = store.vertices().select("id", (F.col("id") % 2).alias("block"))
    other = GraphStore.create(store.base(), str(tmp_path / "by-block"), blocks)
    assert sorted(map(tuple, other.base().edges.collect())) == sorted(map(tuple, store.base().edges.collect()))


def test_last_record_wins(spark):
    g = from_map(spark, {10: [11, 12, 13], 11: [], 12: [], 13: []})
    log = spark.createDataFrame([(1, "DELETE", 10, 12), (2, "INSERT", 10, 14), (3, "INSERT", 10, 12), (4, "DELETE", 10, 12)], "seq long, op string, src long, dst long")
    log = log.withColumn("commit_ts", F.col("seq")).withColumn("ts", F.current_timestamp())
    assert [r[0] for r in D.neighbors_merged(g.edges, log, 10).collect()] == [11, 13, 14]
    base = g.edges.withColumn("commit_ts", F.lit(0))
    assert [r[0] for r in D.snapshot_edges(base, log, 3).where("src = 10").select("dst").orderBy("dst").collect()] == [11, 12, 13, 14]
    assert D.delta_token(0, log, 10) == (0, 4)


def test_policy(spark):
    rows = [(0, 0, 4, 0), (3, 0, 4, 0), (100, 0, 1, 0), (90, 10, 4, 1), (70, 30, 6, 2), (40, 60, 12, 3), (10, 90, 20, 4)]
    e = spark.createDataFrame([(i, r, w) for i, (r, w, _, _) in enumerate(rows)], "id long, reads long, writes long")
    assert [(r["threshold"], r["reservation"]) for r in D.update_sketch(e).orderBy("id").collect()] == [x[2:] for x in rows]


def test_properties(spark, tmp_path):
    p = PropertyStore(spark, str(tmp_path / "props"))
    p.set_many(10, {"name": b"Bob", "age": b"25", "city": b"Berlin"})
    p.set(10, "name", b"\x00\x01\x02\xff"), p.set(11, "name", b"Eve"), p.set(10, "name", b"edge", dst=11)
    assert p.get(10, "name") == b"\x00\x01\x02\xff" and p.get(10, "none") is None and p.get(10, "name", dst=11) == b"edge"
    assert p.delete(10, "age") and p.delete(10, "age")
    assert p.get_all(10) == {"city": b"Berlin", "name": b"\x00\x01\x02\xff"}
    p.compact()
    p.delete_all(10)
    again = PropertyStore(spark, str(tmp_path / "props"))
    assert again.get_all(10) == {} and again.get_all(11) == {"name": b"Eve"} and again.get_all(10, dst=11) == {"name": b"edge"}
    again.set(10, "age", b"1")
    assert again.get_all(10) == {"age": b"1"}
    with pytest.raises(ValueError):
        p.set(1, "", b"x")


def test_stream(spark, store, tmp_path):
    rows = [(i, "2024-01-01 00:00:00", 0, 3 + i % 3, "INSERT") for i in range(6)] + [(6, "2024-01-01 00:07:00", 0, 4, "DELETE")]
    df = spark.createDataFrame(rows, "event_id long, ts string, src long, dst long, op string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    q = ingest.ingest(ingest.read_events(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"), compact_every=1)
    q.awaitTermination()
    assert store.neighbors(0) == [1, 2, 3, 5] and store.deltas().count() == 0
    rates = ingest.write_rates(ingest.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    rates.awaitTermination()
    assert sorted(r["writes"] for r in spark.sql("SELECT * FROM rates").collect()) == [1, 6]


def test_mutable_graph(spark):
    g = MutableGraph({0: [1, 2], 5: []})
    assert g.vertices() == [0, 1, 2, 5] and g.edge_count() == 2 and not g.add_vertex(5) and g.add_vertex(7)
    assert g.add_edge(7, 7) and not g.add_edge(7, 7) and g.add_edge(1, 0) and g.neighbors(7) == [7]
    assert g.remove_edge(0, 2) and not g.remove_edge(0, 2) and not g.remove_edge(99, 0)
    assert g.remove_vertex(0) and not g.remove_vertex(0) and not g.has_edge(1, 0) and g.neighbors(1) == [] and g.has_vertex(1)
    assert g.remove_vertex(7) and g.edge_count() == 0 and not g.has_vertex(7)
    g.add_edge(1, 2)
    whole = g.to_graph(spark)
    assert sorted(r[0] for r in whole.vertices.select("id").collect()) == [1, 2, 5] and whole.edges.collect() == [(1, 2)]
    g.clear()
    assert g.vertex_count() == 0 and g.neighbors(1) == []


def test_small_graph():
    g = SmallGraph()
    a, b, c = g.insert_vertex(), g.insert_vertex(), g.insert_vertex()
    bare = g.memory_usage()
    assert (a, b, c) == (0, 1, 2) and g.insert_edge(a, c) and g.insert_edge(a, b) and not g.insert_edge(a, b) and not g.insert_edge(a, 99)
    assert g.neighbors(a) == [1, 2] and g.edge_count() == 2 and g.memory_usage() > bare
    shot = g.snapshot()
    assert shot.neighbors == [[1, 2], [], []] and shot.edge_count == 2 and shot.memory_usage == g.memory_usage() and shot.deleted == [False] * 3
    assert g.delete_edge(a, b) and not g.delete_edge(a, b) and g.insert_edge(c, a)
    assert g.delete_vertex(a) and not g.delete_vertex(a) and not g.has_edge(c, a) and g.edge_count() == 0
    assert g.insert_vertex() == 3 and g.live_vertex_count() == 3 and g.vertex_id_bound() == 4 and g.snapshot().deleted == [True, False, False, False]
    assert shot.neighbors[0] == [1, 2] and not g.insert_edge(a, b)
