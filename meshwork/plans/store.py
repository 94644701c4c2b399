"""A durable graph: base and log parts, snapshots, transactions, compaction."""

from __future__ import annotations

import threading
from collections import Counter
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.graph import Graph, vertex_rows
from meshwork.operators import deltas as D
from meshwork.plans.manifest import ConflictError, Manifest

EDGE_SCHEMA = "src long, dst long, commit_ts long"
VERTEX_SCHEMA = "id long, label long, community long, deleted boolean"
VERTEX_LOG_SCHEMA = f"seq long, {VERTEX_SCHEMA}"
#: Records in one commit at most; they number the records of a commit.
COMMIT_ROWS = 1 << 40
#: Parts of one tier of a log that are merged into one of the next; a log of n commits has some log n parts.
TIER_PARTS = 16
#: Commits whose written vertices are kept for the serializable check.
KEPT_WRITES = 1000
#: Commits that are tried against other writers.
ATTEMPTS = 100


class Readers:
    """Read timestamps and versions of the active transactions of this process, by store."""

    def __init__(self):
        self._lock, self._active = threading.Lock(), {}

    def add(self, root: str, read_ts: int, version: int) -> None:
        with self._lock:
            self._active.setdefault(root, Counter())[read_ts, version] += 1

    def remove(self, root: str, read_ts: int, version: int) -> None:
        with self._lock:
            active = self._active.get(root, Counter())
            active[read_ts, version] -= 1
            if active[read_ts, version] <= 0:
                del active[read_ts, version]

    def oldest(self, root: str) -> int | None:
        """The oldest read timestamp, if there is any reader."""
        with self._lock:
            return min((ts for ts, _ in self._active.get(root, ())), default=None)

    def versions(self, root: str) -> set[int]:
        with self._lock:
            return {v for _, v in self._active.get(root, ())}

    def snapshots(self, root: str) -> int:
        """How many different timestamps are read at."""
        with self._lock:
            return len({ts for ts, _ in self._active.get(root, ())})


READERS = Readers()


class GraphStore:
    """Open with ``GraphStore.open`` or make with ``GraphStore.create``.

    A commit appends log parts and a manifest, all of it or nothing; readers keep
    the version they began with. Inserted edges are directed, as given. Vertices
    have a log of their own, so one vertex costs one record.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.manifest = spark, Manifest(spark, root)
        self.closed = False
        self._staged: list[dict] = []

    @classmethod
    def create(cls, graph: Graph, root: str, blocks: DataFrame | None = None) -> "GraphStore":
        """Write a graph. ``blocks`` (id, block) clusters the edges by block instead of by id; reads are the same."""
        store = cls(graph.spark, root)
        v, e = store._write_base(graph.vertices, graph.edges.withColumn("commit_ts", F.lit(0).cast("long")), blocks)
        top = graph.vertices.agg(F.max("id")).first()[0]
        store.manifest.commit(
            {
                "version": 0, "base_version": 0, "commit_ts": 0, "merged_to": 0, "top_id": -1 if top is None else top,
                "vertices": v, "edges": e, "deltas": [], "vertex_log": [], "writes": [], "writes_from": 0,
            }
        )
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "GraphStore":
        """An existing store; FileNotFoundError if there is none."""
        store = cls(spark, root)
        store.manifest.read()
        return store

    def close(self) -> None:
        """Publish what is staged and end the use of the object."""
        self.publish_pending()
        self.closed = True

    def _write_base(self, vertices: DataFrame, edges: DataFrame, blocks: DataFrame | None) -> tuple[str, str]:
        m = self.manifest
        v, e = m.part("vertices"), m.part("edges")
        vertices.select("id", "label", "community", "deleted").write.parquet(m.path(v))
        rows = edges.select("src", "dst", "commit_ts")
        if blocks is not None:
            rows = rows.join(blocks.select(F.col("id").alias("src"), "block"), "src", "left").repartitionByRange("block", "src").sortWithinPartitions("block", "src", "dst").select("src", "dst", "commit_ts")
        else:
            rows = rows.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
        rows.write.parquet(m.path(e))
        return v, e

    @property
    def version(self) -> int:
        return self.manifest.versions()[-1]

    @property
    def latest_commit(self) -> int:
        return self.manifest.read()["commit_ts"]

    def watermark(self) -> int:
        """The oldest timestamp that a transaction of this process reads at; the last commit's without any."""
        oldest = READERS.oldest(self.manifest.root)
        return self.latest_commit if oldest is None else oldest

    # the parts of a version

    def _log(self, parts: list, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[self.manifest.path(p) for p, _ in parts]) if parts else self.spark.createDataFrame([], schema)

    def vertices(self, state: dict | None = None) -> DataFrame:
        """All vertices ever made, with their last record."""
        state = state or self.manifest.read()
        base = self.spark.read.schema(VERTEX_SCHEMA).parquet(self.manifest.path(state["vertices"]))
        if not state["vertex_log"]:
            return base
        log = self._log(state["vertex_log"], VERTEX_LOG_SCHEMA)
        last = log.groupBy("id").agg(F.max_by(F.struct("label", "community", "deleted"), "seq").alias("r")).select("id", "r.*")
        return base.join(last.select("id"), "id", "left_anti").select("id", "label", "community", "deleted").unionByName(last)

    def base_edges(self, state: dict | None = None) -> DataFrame:
        state = state or self.manifest.read()
        return self.spark.read.schema(EDGE_SCHEMA).parquet(self.manifest.path(state["edges"]))

    def deltas(self, state: dict | None = None) -> DataFrame:
        return self._log((state or self.manifest.read())["deltas"], D.DELTA_SCHEMA)

    # reading

    def _at(self, state: dict, read_ts: int | None) -> int:
        at = state["commit_ts"] if read_ts is None else read_ts
        if at < state["merged_to"]:
            raise ValueError(f"commits up to {state['merged_to']} are merged: the snapshot at {at} is gone")
        return at

    def base(self) -> Graph:
        """The last consolidated graph; pending updates are not in it."""
        state = self.manifest.read()
        return Graph(self.vertices(state), self.base_edges(state).select("src", "dst"))

    def snapshot(self, read_ts: int | None = None, state: dict | None = None) -> Graph:
        """The graph as of a commit, by default the last; deleted vertices and their edges are not in it."""
        state = state or self.manifest.read()
        edges = D.snapshot_edges(self.base_edges(state), self.deltas(state), self._at(state, read_ts))
        vertices = self.vertices(state)
        gone = vertices.where("deleted").select("id")
        edges = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(vertices.where("NOT deleted"), edges.select("src", "dst"))

    def neighbors(self, v: int, read_ts: int | None = None, state: dict | None = None) -> list[int]:
        """Neighbours with all committed updates up to ``read_ts``, ascending, each once."""
        state = state or self.manifest.read()
        mine = lambda df: df.where(F.col("src") == v)
        return [r[0] for r in D.snapshot_edges(mine(self.base_edges(state)), mine(self.deltas(state)), self._at(state, read_ts)).select("dst").distinct().orderBy("dst").collect()]

    def base_neighbors(self, v: int) -> list[int]:
        return [r[0] for r in self.base_edges().where(F.col("src") == v).select("dst").orderBy("dst").collect()]

    def live(self, ids: list[int], state: dict | None = None) -> set[int]:
        rows = self.vertices(state).where(F.col("id").isin([int(i) for i in ids]) & ~F.col("deleted")).select("id").collect()
        return {r[0] for r in rows}

    # writing

    def _tiered(self, parts: list, new: str, schema: str) -> list:
        """A log with one more part; the last TIER_PARTS of a tier become one part of the next."""
        parts = [*parts, [new, 0]]
        while len(parts) >= TIER_PARTS and len({tier for _, tier in parts[-TIER_PARTS:]}) == 1:
            last = parts[-TIER_PARTS:]
            merged = self.manifest.part("log")
            self._log(last, schema).write.parquet(self.manifest.path(merged))
            parts = [*parts[:-TIER_PARTS], [merged, last[0][1] + 1]]
        return parts

    def _commit(self, edges: DataFrame | None, vertices: DataFrame | None, keys: list[int] | None, expected: int | None, top_id: int | None = None) -> int:
        """One commit of edge records (n, op, src, dst) and vertex records; the new commit_ts."""
        m = self.manifest
        for _ in range(ATTEMPTS):
            state = m.read()
            if expected is not None and state["version"] != expected:
                raise ConflictError(f"version {state['version']} came after {expected}")
            ts = state["commit_ts"] + 1
            first = F.lit(ts) * F.lit(COMMIT_ROWS)
            nxt = state | {"version": state["version"] + 1, "commit_ts": ts}
            if edges is not None:
                part, now = m.part("deltas"), datetime.now(timezone.utc)
                edges.select(
                    (first + F.col("n")).alias("seq"), "op", F.col("src").cast("long"), F.col("dst").cast("long"), F.lit(now).cast("timestamp").alias("ts"), F.lit(ts).cast("long").alias("commit_ts")
                ).write.parquet(m.path(part))
                nxt["deltas"] = self._tiered(state["deltas"], part, D.DELTA_SCHEMA)
            if vertices is not None:
                part = m.part("vertex-log")
                vertices.select(first.alias("seq"), "id", "label", "community", "deleted").write.parquet(m.path(part))
                nxt["vertex_log"] = self._tiered(state["vertex_log"], part, VERTEX_LOG_SCHEMA)
            if top_id is not None:
                nxt["top_id"] = max(top_id, state["top_id"])
            writes = [*state["writes"], [ts, keys]]
            if len(writes) > KEPT_WRITES:
                nxt["writes_from"] = writes[-KEPT_WRITES - 1][0]
            nxt["writes"] = writes[-KEPT_WRITES:]
            try:
                m.commit(nxt)
                return ts
            except ConflictError:
                if expected is not None:
                    raise
        raise ConflictError("too many writers")

    def append(self, rows: DataFrame, keys: list[int] | None = None, expected: int | None = None) -> int:
        """Commit (op, src, dst) rows in the order of their column ``n``; the new commit_ts.

        ``expected`` is the version that the rows build on: ConflictError if
        there is a newer one. Without it the commit is tried again on top of
        whatever came between, which is right as rows only append.
        """
        return self._commit(rows, None, keys, expected)

    def _ops(self, ops: list[tuple[str, int, int]]) -> DataFrame:
        return self.spark.createDataFrame([(i, *op) for i, op in enumerate(ops)], "n long, op string, src long, dst long")

    def insert_edge(self, src: int, dst: int) -> bool:
        """False if an end is unknown or deleted."""
        if len(self.live([src, dst])) < len({src, dst}):
            return False
        self.append(self._ops([("INSERT", src, dst)]), [src])
        return True

    def delete_edge(self, src: int, dst: int) -> bool:
        """False if an end is out of range; deleting an edge that is not there is fine."""
        known = self.vertices().where(F.col("id").isin([int(src), int(dst)])).count()
        if known < len({src, dst}):
            return False
        self.append(self._ops([("DELETE", src, dst)]), [src])
        return True

    def insert_edges(self, edges: DataFrame) -> int:
        """Append many inserts (src, dst[, n]) whose ends are live; the new commit_ts."""
        live = self.vertices().where("NOT deleted").select("id")
        ok = edges.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi")
        n = F.col("n") if "n" in edges.columns else F.monotonically_increasing_id()
        return self.append(ok.select(F.lit("INSERT").alias("op"), "src", "dst", n.alias("n")))

    def _vertex_record(self, v: int, **change) -> DataFrame:
        rows = self.vertices().where(F.col("id") == v)
        return rows.withColumns({k: F.lit(x) for k, x in change.items()})

    def delete_vertex(self, v: int, remove_neighbors: bool = False) -> bool:
        """Mark a vertex deleted; with ``remove_neighbors`` its edges get tombstones both ways, in the same commit."""
        if not self.live([v]):
            return False
        edges = self._ops([op for x in self.neighbors(v) for op in (("DELETE", v, x), ("DELETE", x, v))]) if remove_neighbors else None
        self._commit(edges, self._vertex_record(v, deleted=True), [v], None)
        return True

    def insert_vertex(self, v: int) -> bool:
        """Live: False. Deleted: live again. Unknown: one new vertex, with the next id."""
        if self.live([v]):
            return False
        if not self.vertices().where(F.col("id") == v).isEmpty():
            self._commit(None, self._vertex_record(v, deleted=False), [v], None)
        else:
            self.insert_vertex_with_neighbors([])
        return True

    def _new(self, first: int, last: int, edges: DataFrame | None, keys: list[int] | None, expected: int) -> None:
        self._commit(edges, vertex_rows(self.spark.range(first, last + 1)), keys, expected, last)

    def insert_vertex_with_neighbors(self, neighbors: list[int]) -> int:
        """A new vertex with directed edges to its neighbours; its id."""
        for _ in range(ATTEMPTS):
            state = self.manifest.read()
            new = state["top_id"] + 1
            try:
                self._new(new, new, self._ops([("INSERT", new, int(x)) for x in neighbors]) if neighbors else None, [new], state["version"])
                return new
            except ConflictError:
                continue
        raise ConflictError("too many writers")

    def insert_vertices(self, lists: dict[int, list[int]] | DataFrame) -> None:
        """Many new vertices with their neighbours, as a dict or as (id, neighbors) rows, in one commit.

        Their ids must be new; gaps below them are filled.
        """
        if isinstance(lists, DataFrame):
            low, high = lists.agg(F.min("id"), F.max("id")).first()
            rows = lists.select(F.col("id").alias("src"), F.posexplode("neighbors").alias("n", "dst")).select(F.lit("INSERT").alias("op"), "src", "dst", F.col("n").cast("long").alias("n"))
            keys = None
        else:
            low, high = min(lists, default=None), max(lists, default=None)
            ops = [("INSERT", v, int(x)) for v, xs in lists.items() for x in xs]
            rows, keys = (self._ops(ops) if ops else None), sorted(lists)
        if low is None:
            return
        state = self.manifest.read()
        if low <= state["top_id"]:
            raise ValueError("ids of new vertices must follow the known ones")
        self._new(state["top_id"] + 1, high, rows, keys, state["version"])

    # consolidation

    def compact(self, watermark: int | None = None, blocks: DataFrame | None = None, publish: bool = True) -> int | None:
        """Write a new base with the records below the watermark; later ones stay in the log.

        The watermark is by default the oldest timestamp that a transaction of
        this process reads at; without one everything is merged. Transactions,
        of other processes too, keep the version they began with. Without
        ``publish`` the new base is staged: readers see it after
        ``publish_pending``.
        """
        state = self.manifest.read()
        if watermark is None:
            watermark = READERS.oldest(self.manifest.root)
        log = self.deltas(state)
        take = log if watermark is None else log.where(F.col("commit_ts") < watermark)
        v, e = self._write_base(self.vertices(state), D.apply_deltas_ts(self.base_edges(state), take), blocks)
        left = []
        if watermark is not None and state["deltas"]:
            part = self.manifest.part("deltas")
            log.where(F.col("commit_ts") >= watermark).write.parquet(self.manifest.path(part))
            left = [[part, 0]]
        merged = state["commit_ts"] if watermark is None else max(state["merged_to"], min(watermark - 1, state["commit_ts"]))
        self._staged.append({"of": state, "vertices": v, "edges": e, "deltas": left, "merged_to": merged})
        return self.publish_pending() if publish else None

    consolidate = compact

    def pending(self) -> int:
        """Bases that are written and not published."""
        return len(self._staged)

    def publish_pending(self) -> int:
        """Make the staged bases the ones that are read, in order; the version then.

        Commits that came in between stay in the log. Where a log has been
        merged meanwhile, it stays whole: what the base holds already is decided
        once more by the same records.
        """
        m = self.manifest
        while self._staged:
            staged = self._staged[0]
            for _ in range(ATTEMPTS):
                state, of = m.read(), staged["of"]
                later = {}
                for kind in ("deltas", "vertex_log"):
                    old = {p for p, _ in of[kind]}
                    kept = [x for x in state[kind] if x[0] not in old]
                    whole = old <= {p for p, _ in state[kind]}
                    later[kind] = [*(staged["deltas"] if kind == "deltas" else []), *kept] if whole else state[kind]
                try:
                    m.commit(state | later | {"version": state["version"] + 1, "base_version": state["version"] + 1, "vertices": staged["vertices"], "edges": staged["edges"], "merged_to": max(state["merged_to"], staged["merged_to"])})
                    break
                except ConflictError:
                    continue
            else:
                raise ConflictError("too many writers")
            self._staged.pop(0)
        return self.version

    force_switch_new_version = publish_pending

    def vacuum(self, keep: int = 1) -> None:
        """Delete the parts and manifests that none of the newest ``keep`` versions, nor a transaction of this process, needs.

        Transactions of other processes on older versions have to be over.
        """
        m = self.manifest
        known = m.versions()
        held = set(known[-keep:]) | READERS.versions(m.root)

        def parts(state):
            return {state["vertices"], state["edges"], *(p for kind in ("deltas", "vertex_log") for p, _ in state[kind])}

        needed = set().union(*(parts(m.read(v)) for v in known if v in held))
        for v in known:
            if v not in held:
                gone = parts(m.read(v)) - needed
                m.forget(v)
                for part in gone:
                    m.delete(part)

    def begin(self, serializable: bool = False) -> "Transaction":
        return Transaction(self, serializable)


class Transaction:
    """Snapshot isolation: reads as of the begin, writes on commit, at once.

    The version it began with is pinned, so neither a commit nor a compaction
    changes what it reads. A transaction does not see its own writes. With
    ``serializable`` the commit fails if a later commit wrote to a vertex whose
    neighbours were read, or if that is no longer known.
    """

    def __init__(self, store: GraphStore, serializable: bool = False):
        self.store, self.serializable = store, serializable
        self.pinned = store.manifest.read()
        self.read_ts, self.read_keys, self.ops, self.state = self.pinned["commit_ts"], set(), [], "active"
        READERS.add(store.manifest.root, self.read_ts, self.pinned["version"])

    def _active(self) -> None:
        if self.state != "active":
            raise RuntimeError(f"the transaction is {self.state}")

    def _end(self, state: str) -> None:
        self.state = state
        READERS.remove(self.store.manifest.root, self.read_ts, self.pinned["version"])

    def neighbors(self, v: int) -> list[int]:
        self._active()
        self.read_keys.add(int(v))
        return self.store.neighbors(v, self.read_ts, self.pinned)

    def snapshot(self) -> Graph:
        """The whole graph as this transaction sees it; for the serializable check that is no read."""
        self._active()
        return self.store.snapshot(self.read_ts, self.pinned)

    def insert_edge(self, src: int, dst: int) -> None:
        self._active()
        self.ops.append(("INSERT", int(src), int(dst)))

    def delete_edge(self, src: int, dst: int) -> None:
        self._active()
        self.ops.append(("DELETE", int(src), int(dst)))

    def abort(self) -> None:
        self._active()
        self._end("aborted")

    def commit(self) -> int:
        """The commit_ts; ValueError for an operation on an unknown vertex, ConflictError for a conflict."""
        self._active()
        if not self.ops:
            self._end("committed")
            return self.read_ts
        for _ in range(ATTEMPTS):
            state = self.store.manifest.read()
            if self.serializable and self.read_keys:
                unknown = state["writes_from"] > self.read_ts
                if unknown or any(ts > self.read_ts and (keys is None or self.read_keys & set(keys)) for ts, keys in state["writes"]):
                    self._end("aborted")
                    raise ConflictError("a vertex that was read has been written to" if not unknown else "too many commits came after the begin to tell whether they conflict")
            ends = {x for _, a, b in self.ops for x in (a, b)}
            missing = ends - self.store.live(sorted(ends), state)
            if missing:
                self._end("aborted")
                raise ValueError(f"no vertex {min(missing)}")
            try:
                ts = self.store.append(self.store._ops(self.ops), sorted({a for _, a, _ in self.ops}), state["version"])
            except ConflictError:
                continue
            self._end("committed")
            return ts
        self._end("aborted")
        raise ConflictError("too many writers")

    def __enter__(self) -> "Transaction":
        return self

    def __exit__(self, kind, *_) -> None:
        if self.state == "active":
            if kind is None:
                self.commit()
            else:
                self.abort()
