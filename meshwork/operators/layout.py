"""Vertex orders, partitions into blocks, and sparsification."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.graph import GIANT_DEGREE, Graph
from meshwork.operators.analytics import wcc
from meshwork.operators.components import connected_components
from meshwork.operators.ordering import cumulative, rank_rows
from meshwork.operators.topology import degree, id_rows, induced_edges
from meshwork.operators.traversal import bfs_visit_order, union_all
from meshwork.runtime import materialise, ship, sized

#: Vertices of a block, and edges within, up to which an order is worked out in one task.
BLOCK_VERTICES, BLOCK_EDGES = 100_000, 2_000_000
#: Neighbours from which on a vertex raises them as classes.
HUB_DEGREE = 64


def degree_order(graph: Graph) -> DataFrame:
    """(id, degree, pos): degree descending, id ascending."""
    d = materialise(degree(graph).withColumn("down", -F.col("degree")), "degrees")
    return rank_rows(d, ["down", "id"], "pos").select("id", "degree", "pos")


def internal_degree_order(graph: Graph, ids) -> DataFrame:
    """Like ``degree_order`` on a set of vertices, counting only edges within it."""
    s = id_rows(graph, ids)
    return degree_order(Graph(graph.vertices.join(s, "id", "left_semi"), induced_edges(graph.edges, s)))


def bfs_order(graph: Graph, start: int | None = None) -> DataFrame:
    """(id, pos): search order from ``start`` (by default the largest degree), then the other components by smallest id.

    The components after the first are searched all at once: their roots are
    the sources of one search, and vertices are ordered by component, level and
    parent.
    """
    if start is None:
        row = degree(graph).orderBy(F.col("degree").desc(), "id").first()
        if row is None:
            return graph.vertices.select("id", F.lit(0).cast("long").alias("pos"))
        start = row["id"]
    first = bfs_visit_order(graph, start)
    rest = materialise(graph.vertices.select("id").join(first.select("id"), "id", "left_anti"), "rest")
    n = first.count()
    if rest.isEmpty():
        return first.select("id", F.col("visit_order").alias("pos"))
    labels = materialise(wcc(Graph(graph.vertices.join(rest, "id", "left_semi"), induced_edges(graph.edges, rest))), "labels")
    # one search from all roots: the order within a component is that of its own search
    done = materialise(labels.where("id = label").select("id", F.col("label"), F.lit(0).cast("long").alias("level"), F.col("label").alias("key")), "roots")
    files, last, depth = done.inputFiles(), done, 0
    while not last.isEmpty():
        depth += 1
        offers = graph.edges.join(last.select(F.col("id").alias("src"), "label", F.col("key").alias("parent")), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.min("parent").alias("parent"))
        known = graph.spark.read.schema(done.schema).parquet(*files)
        fresh = materialise(offers.join(known.select("id"), "id", "left_anti"), "fresh")
        last = materialise(rank_rows(fresh, ["parent", "id"], "key").select("id", "label", F.lit(depth).cast("long").alias("level"), "key"), "level")
        files += last.inputFiles()
    known = materialise(graph.spark.read.schema(done.schema).parquet(*files), "known")
    tail = rank_rows(known, ["label", "level", "key", "id"], "pos").select("id", (F.col("pos") + n).alias("pos"))
    return first.select("id", F.col("visit_order").alias("pos")).union(tail)


def native_partition(graph: Graph) -> DataFrame:
    """(id, block): the file's communities as blocks."""
    return graph.vertices.select("id", F.col("community").alias("block"))


def block_weight(graph: Graph, blocks: DataFrame) -> DataFrame:
    """(block, vertices, weight) with weight 1 + degree of a vertex."""
    return blocks.join(degree(graph), "id").groupBy("block").agg(F.count(F.lit(1)).alias("vertices"), F.sum(F.col("degree") + 1).alias("weight"))


def collect_blocks(blocks: DataFrame) -> DataFrame:
    """(block, members), members ascending; for writing out, as a block's members are one value."""
    return blocks.groupBy("block").agg(F.sort_array(F.collect_list("id")).alias("members"))


def compress_block_ids(blocks: DataFrame) -> DataFrame:
    """Block numbers without gaps, in the order of the old ones."""
    names = materialise(blocks.select("block").distinct(), "names")
    return blocks.join(rank_rows(names, ["block"], "dense"), "block").select("id", F.col("dense").alias("block"))


def weight_bounded_partition(graph: Graph, max_weight: int, order: DataFrame | None = None, giants_full: bool = False) -> DataFrame:
    """(id, block): every vertex in one block, and no block above ``max_weight`` unless it is a single vertex.

    Vertices are laid out in an order that keeps neighbours together (search
    order by default) and the running weight is cut at half the bound; a block
    is what lies between two cuts, so it weighs less than half the bound plus
    one vertex. Giants weigh 1 unless ``giants_full``; a vertex of more than
    half the bound gets a block of its own.
    """
    if max_weight <= 0:
        raise ValueError("the weight bound must be positive")
    order = bfs_order(graph) if order is None else order
    weight = F.col("degree") + 1 if giants_full else F.when(F.col("degree") >= GIANT_DEGREE, F.lit(1)).otherwise(F.col("degree") + 1)
    rows = materialise(order.join(degree(graph), "id").select("id", "pos", weight.cast("long").alias("w")), "weights")
    if rows.isEmpty():
        return rows.select("id", F.col("pos").alias("block"))
    half = max(1, max_weight // 2)
    small = materialise(cumulative(rows.where(F.col("w") <= half), ["pos"], "w", "upto").select("id", F.expr(f"(upto - w) div {half}").alias("cut"), F.lit(None).cast("long").alias("own")), "small")
    large = rows.where(F.col("w") > half).select("id", F.lit(None).cast("long").alias("cut"), F.col("id").alias("own"))
    keys = materialise(small.select("cut", "own").union(large.select("cut", "own")).distinct().withColumn("key", F.coalesce(F.col("cut"), F.lit(1 << 40) + F.col("own"))), "keys")
    numbered = rank_rows(keys, ["key"], "block").select("key", "block")
    return small.union(large).withColumn("key", F.coalesce(F.col("cut"), F.lit(1 << 40) + F.col("own"))).join(numbered, "key").select("id", "block")


def block_partition(quotient: Graph, cap: int) -> DataFrame:
    """(id, block): the blocks of a quotient graph, each of weight one, in parents of ``cap`` along a search order."""
    if cap <= 0:
        raise ValueError("the weight bound must be positive")
    return bfs_order(quotient).select("id", F.expr(f"pos div {int(cap)}").alias("block"))


def save_partition(blocks: DataFrame, path: str) -> None:
    """Write a partition (id, block and, where it has one, pos), clustered by block."""
    blocks.repartitionByRange("block", "id").sortWithinPartitions("block", "id").write.mode("overwrite").parquet(path)


def load_partition(spark, path: str) -> DataFrame | None:
    """A partition that was saved; None where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path)


def kway_partition(graph: Graph, k: int, order: DataFrame | None = None) -> DataFrame:
    """(id, block): k blocks of about equal weight (no more than vertices), along a locality order."""
    n = graph.vertices.count()
    k = max(1, min(k, n))
    order = bfs_order(graph) if order is None else order
    rows = materialise(order.join(degree(graph), "id").select("id", "pos", (F.col("degree") + 1).alias("w")), "weights")
    if not n:
        return rows.select("id", F.col("pos").alias("block"))
    total = rows.agg(F.sum("w")).first()[0]
    cut = cumulative(rows, ["pos"], "w", "upto").select("id", F.expr(f"(upto - w) * {k} div {total}").alias("block"))
    filled = compress_block_ids(materialise(cut, "cut"))
    found = filled.agg(F.max("block")).first()[0] + 1
    # heavy vertices can leave cuts empty: then vertices are counted instead of weighed
    return filled if found == k else rows.select("id", F.expr(f"pos * {k} div {n}").alias("block"))


def _window_order(ids: list[int], edges: list[tuple[int, int]], window: int) -> list[int]:
    """Greedy order: next comes the vertex that shares most edges and common neighbours with the last few.

    A common neighbour of few edges raises its neighbours one by one. One of
    more than HUB_DEGREE edges raises all of its neighbours alike, so vertices
    are kept in classes by the hubs around them, and the class is raised.
    """
    near: dict[int, list[int]] = {i: [] for i in ids}
    for a, b in edges:
        near[a].append(b)
    hubs = {v for v, xs in near.items() if len(xs) > HUB_DEGREE}
    class_of = {v: frozenset(hubs.intersection(near[v])) for v in ids} if hubs else dict.fromkeys(ids, frozenset())
    around: dict[int, list[frozenset]] = {h: [] for h in hubs}
    raised, queues = {}, {}
    for c in dict.fromkeys(class_of.values()):
        raised[c], queues[c] = 0, []
        for h in c:
            around[h].append(c)
    score = dict.fromkeys(ids, 0)
    fresh = [(-len(near[i]), i) for i in ids]
    heapq.heapify(fresh)
    for v in ids:
        if class_of[v]:
            queues[class_of[v]].append((0, v))
    for q in queues.values():
        heapq.heapify(q)
    tops: list[tuple[int, int, int, frozenset]] = []  # (-score, vertex, its own part, class): entries go stale
    live: dict[frozenset, tuple | None] = {}  # the one entry of a class that counts: any other is dropped when it comes up
    out, placed = [], set()

    def offer(c: frozenset) -> None:
        q = queues[c]
        while q and (q[0][1] in placed or -q[0][0] != score[q[0][1]]):
            heapq.heappop(q)
        entry = (q[0][0] - raised[c], q[0][1], -q[0][0], c) if q and raised[c] - q[0][0] > 0 else None
        if entry != live.get(c):
            live[c] = entry
            if entry:
                heapq.heappush(tops, entry)

    def change(v: int, by: int) -> None:
        touched = set()
        for x in near[v]:
            for y in (x, *(near[x] if x not in hubs else ())):
                if y not in placed:
                    score[y] += by
                    heapq.heappush(queues[class_of[y]], (-score[y], y))
                    touched.add(class_of[y])
            if x in hubs:
                for c in around[x]:
                    raised[c] += by
                    touched.add(c)
        for c in touched:
            offer(c)

    while len(out) < len(ids):
        best = None
        while tops:
            entry = heapq.heappop(tops)
            s, v, own, c = entry
            if entry is not live.get(c):
                continue
            live[c] = None
            if v in placed or own != score[v] or own + raised[c] != -s:
                offer(c)
            else:
                best = v
                break
        while best is None:
            _, v = heapq.heappop(fresh)
            if v not in placed:
                best = v
        placed.add(best)
        out.append(best)
        offer(class_of[best])
        change(best, 1)
        if len(out) > window:
            change(out[-window - 1], -1)
    return out


def window_order(graph: Graph, blocks: DataFrame, window: int = 20) -> DataFrame:
    """(id, block, pos): a locality order within each block, worked out a piece at a time in pandas.

    Blocks come from a weight-bounded partition. One above BLOCK_VERTICES
    vertices or BLOCK_EDGES inner edges is cut along the search order into
    pieces below both, which are ordered by themselves, one after the other.
    """
    ship(graph.spark)
    b = materialise(blocks.select("id", "block"), "blocks")
    inner = graph.edges.join(b.select(F.col("id").alias("src"), "block"), "src").join(b.select(F.col("id").alias("dst"), F.col("block").alias("other")), "dst").where("block = other")
    inner = materialise(inner.select("block", "src", "dst"), "inner")
    inside = inner.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    weighed = b.join(inside, F.col("id") == F.col("src"), "left").select("id", "block", F.coalesce("d", F.lit(0)).alias("d"))
    sizes = materialise(weighed.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("e")), "sizes")
    large = sizes.where((F.col("n") > BLOCK_VERTICES) | (F.col("e") > BLOCK_EDGES)).select("block")
    if large.isEmpty():
        pieces = b.select("id", "block", F.lit(0).cast("long").alias("piece"))
    else:
        heavy = materialise(weighed.join(large, "block", "left_semi"), "heavy")
        order = bfs_order(Graph(heavy.select("id"), inner.join(large, "block", "left_semi").select("src", "dst"), graph.symmetric))
        # a vertex counts for its share of either bound; a piece is what lies between two cuts
        share = F.greatest(F.lit(1.0 / BLOCK_VERTICES), F.col("d") / F.lit(float(BLOCK_EDGES))) * (1 << 30)
        placed = materialise(heavy.join(order, "id").withColumn("w", F.ceil(share).cast("long")), "placed")
        cut = cumulative(placed, ["block", "pos"], "w", "upto").select("id", "block", F.expr(f"(upto - w) div {1 << 29}").alias("piece"))
        pieces = materialise(b.join(large, "block", "left_anti").select("id", "block", F.lit(0).cast("long").alias("piece")).union(cut), "pieces")
    p = pieces.select("id", "block", "piece")
    e = inner.join(p.select(F.col("id").alias("src"), "piece"), "src").join(p.select(F.col("id").alias("dst"), F.col("piece").alias("there")), "dst").where("piece = there")
    rows = p.select("block", "piece", "id", F.lit(None).cast("long").alias("dst")).union(e.select("block", "piece", F.col("src").alias("id"), "dst"))

    def order_of(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf.loc[pdf.dst.isna(), "id"].astype("int64").tolist())
        e = pdf.loc[pdf.dst.notna()]
        found = _window_order(ids, list(zip(e.id.astype("int64").tolist(), e.dst.astype("int64").tolist())), window)
        return pd.DataFrame({"id": found, "block": pdf.block.iloc[0], "piece": pdf.piece.iloc[0], "at": range(len(found))})

    found = materialise(rows.groupBy("block", "piece").applyInPandas(order_of, "id long, block long, piece long, at long"), "pieces")
    per = found.groupBy("block", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("block", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(offsets, ["block", "piece"]).select("id", "block", (F.col("before") + F.col("at")).alias("pos"))


def sparsify(graph: Graph, max_degree: int) -> DataFrame:
    """Edges (src, dst), both directions, so that no vertex keeps more than ``max_degree``.

    Edges of important ends (sum of degrees) come first, then by (src, dst). A
    pass over the edges in that order takes those that join two components
    while both ends have room, which keeps the graph together as far as the
    bound allows; a second pass takes what still fits. Both are done in rounds
    that take at once what the pass would take whatever comes before: see
    ``_forest_round`` and ``_fill_round``.
    """
    spark = graph.spark
    none = spark.createDataFrame([], "src long, dst long")
    if max_degree <= 0:
        return none
    with sized(spark, graph.edges.count()):
        return _sparsify(graph, max_degree, none)


def _sparsify(graph: Graph, max_degree: int, none: DataFrame) -> DataFrame:
    d = degree(graph)
    e = graph.edges.where("src < dst")
    weighed = e.join(d.select(F.col("id").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("b")), "dst")
    every = materialise(weighed.select("src", "dst", (F.col("a") + F.col("b")).alias("weight")), "weighed")
    room = materialise(graph.vertices.select("id", F.lit(max_degree).cast("long").alias("room")), "room")
    comps = materialise(graph.vertices.select("id", F.col("id").alias("comp")), "comps")
    kept: list[DataFrame] = []
    for forest in (True, False):
        # most ends have no room by then, so the room is looked at before the edges that were kept
        left, first = every, not kept
        if not forest and kept:
            left = _with_room(every, room).select("src", "dst", "weight").join(union_all(kept), ["src", "dst"], "left_anti")
        while True:
            if first:
                # all ends have room, and every vertex is a component
                full = F.lit(max_degree).cast("long")
                ready = left.select("*", full.alias("src_room"), full.alias("dst_room"), F.col("src").alias("src_comp"), F.col("dst").alias("dst_comp"))
            else:
                ready = _with_room(left, room)
            if forest and not first:
                a, b = (comps.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp")) for c in ("src", "dst"))
                ready = ready.join(a, "src").join(b, "dst").where("src_comp <> dst_comp")
            # the first round reads what was written; what joined two components is dropped by the next
            ready, first = ready if first else materialise(ready, "ready"), False
            if ready.isEmpty():
                break
            chosen = materialise((_forest_round if forest else _fill_round)(ready, max_degree), "chosen")
            kept.append(chosen.select("src", "dst"))
            used = chosen.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("used"))
            room = materialise(room.join(used, "id", "left").select("id", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")), "room")
            if forest:
                merged = materialise(connected_components(chosen.select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst"))), "merged")
                comps = materialise(comps.join(merged.select(F.col("id").alias("comp"), "label"), "comp", "left").select("id", F.coalesce("label", "comp").alias("comp")), "comps")
            left = ready.select("src", "dst", "weight")
            if not forest:
                left = left.join(chosen, ["src", "dst"], "left_anti")
    if not kept:
        return none
    out = union_all([materialise(k, "kept") for k in kept])
    return out.union(out.select("dst", "src"))


def _with_room(edges: DataFrame, room: DataFrame) -> DataFrame:
    """Edges whose ends both have room, with it."""
    a, b = (room.where("room > 0").select(F.col("id").alias(c), F.col("room").alias(f"{c}_room")) for c in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst")


def _first_of(ready: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(key, src, dst, nth): the first ``n`` edges of each key, which is at either end of an edge."""
    ends = ready.select(F.explode(F.array(*[F.struct(F.col(k).alias("key"), F.col(f"{c}_room").alias("room")) for k, c in zip(keys, ("src", "dst"))])).alias("k"), "src", "dst", "weight")
    order = Window.partitionBy("key").orderBy(F.col("weight").desc(), "src", "dst")
    # the bound on the rank reaches the tasks before the shuffle, so a hub sends a few edges from each
    return ends.select("k.key", "k.room", "src", "dst", "weight").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def _fill_round(ready: DataFrame, max_degree: int) -> DataFrame:
    """Edges that are, at both ends, among the first that still have room there: earlier edges cannot use it up."""
    fits = _first_of(ready, ["src", "dst"], max_degree).where("nth <= room")
    both = fits.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("src", "dst")
    return ready.join(both, ["src", "dst"], "left_semi")


def _forest_round(ready: DataFrame, max_degree: int) -> DataFrame:
    """Edges that come first at one of their components, and at the other end among the first that have room there.

    No earlier edge touches that component, so when the pass gets to the edge
    its ends are still apart and have room.
    """
    first = _first_of(ready, ["src_comp", "dst_comp"], 1).select("src", "dst", F.col("key").alias("comp"))
    fits = _first_of(ready, ["src", "dst"], max_degree).where("nth <= room")
    ends = fits.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("src", "dst")
    return ready.join(first.select("src", "dst").distinct(), ["src", "dst"], "left_semi").join(ends, ["src", "dst"], "left_semi")
