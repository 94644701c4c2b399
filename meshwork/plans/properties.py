"""Free-form properties of vertices and edges as an append-only log.

A record is (seq, kind, id, dst, key, value, deleted); for each (kind, id, dst,
key) the last record decides. ``dst`` is null for vertices. A record with a
null key deletes all earlier properties of its vertex or edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.plans.manifest import ConflictError, Manifest

SCHEMA = "seq long, kind string, id long, dst long, key string, value binary, deleted boolean"


def current(log: DataFrame) -> DataFrame:
    """(kind, id, dst, key, value) of what is set, from a log."""
    wiped = log.where("key IS NULL").groupBy("kind", "id", "dst").agg(F.max("seq").alias("wiped"))
    last = log.where("key IS NOT NULL").groupBy("kind", "id", "dst", "key").agg(F.max_by(F.struct("value", "deleted", "seq"), "seq").alias("r"))
    same = (F.col("l.kind") == F.col("w.kind")) & (F.col("l.id") == F.col("w.id")) & F.col("l.dst").eqNullSafe(F.col("w.dst"))
    both = last.alias("l").join(wiped.alias("w"), same, "left").where("NOT l.r.deleted AND (w.wiped IS NULL OR l.r.seq > w.wiped)")
    return both.select("l.kind", "l.id", "l.dst", "l.key", F.col("l.r.value").alias("value"))


def as_maps(rows: DataFrame) -> DataFrame:
    """(kind, id, dst, properties) with all properties of a vertex or edge in one map."""
    return rows.groupBy("kind", "id", "dst").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("properties"))


class PropertyStore:
    """Set, get and delete properties; keys are non-empty strings, values bytes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.manifest = spark, Manifest(spark, root)
        if not self.manifest.versions():
            self.manifest.commit({"version": 0, "parts": []})

    def log(self) -> DataFrame:
        parts = self.manifest.read()["parts"]
        return self.spark.read.schema(SCHEMA).parquet(*[self.manifest.path(p) for p in parts]) if parts else self.spark.createDataFrame([], SCHEMA)

    def append(self, rows: list[tuple]) -> None:
        """Commit (kind, id, dst, key, value, deleted) rows at once."""
        m, part = self.manifest, self.manifest.part("log")
        for _ in range(100):
            state = m.read()
            first = (state["version"] + 1) << 32
            self.spark.createDataFrame([(first + i, *r) for i, r in enumerate(rows)], SCHEMA).coalesce(1).write.mode("overwrite").parquet(m.path(part))
            try:
                m.commit({"version": state["version"] + 1, "parts": [*state["parts"], part]})
                return
            except ConflictError:
                continue
        raise ConflictError("too many writers")

    @staticmethod
    def _key(key: str) -> str:
        if not key or len(key.encode()) > 65535:
            raise ValueError("a key has 1 to 65535 bytes")
        return key

    def set(self, v: int, key: str, value: bytes, dst: int | None = None) -> None:
        self.set_many(v, {key: value}, dst)

    def set_many(self, v: int, values: dict[str, bytes], dst: int | None = None) -> None:
        self.append([(_kind(dst), v, dst, self._key(k), bytearray(x), False) for k, x in values.items()])

    def delete(self, v: int, key: str, dst: int | None = None) -> bool:
        """True also for what is not there."""
        self.append([(_kind(dst), v, dst, self._key(key), None, True)])
        return True

    def delete_all(self, v: int, dst: int | None = None) -> None:
        self.append([(_kind(dst), v, dst, None, None, True)])

    def _of(self, v: int, dst: int | None) -> DataFrame:
        return current(self.log().where((F.col("kind") == _kind(dst)) & (F.col("id") == v) & F.col("dst").eqNullSafe(F.lit(dst).cast("long"))))

    def get(self, v: int, key: str, dst: int | None = None) -> bytes | None:
        row = self._of(v, dst).where(F.col("key") == key).first()
        return None if row is None else bytes(row["value"])

    def get_all(self, v: int, dst: int | None = None) -> dict[str, bytes]:
        return {r["key"]: bytes(r["value"]) for r in self._of(v, dst).orderBy("key").collect()}

    def compact(self) -> None:
        """Rewrite the log as what is set now."""
        m, state = self.manifest, self.manifest.read()
        part = m.part("log")
        current(self.log()).select(F.lit((state["version"] + 1) << 32).alias("seq"), "kind", "id", "dst", "key", "value", F.lit(False).alias("deleted")).write.parquet(m.path(part))
        m.commit({"version": state["version"] + 1, "parts": [part]})


def _kind(dst: int | None) -> str:
    return "vertex" if dst is None else "edge"
