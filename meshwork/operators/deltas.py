"""Updates as an append-only log, merged with the base on reading.

A delta is (seq bigint, op 'INSERT' | 'DELETE', src bigint, dst bigint,
ts timestamp, commit_ts bigint); ``seq`` orders all of them. For each (src,
dst) the last record decides. The base is never changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELTA_SCHEMA = "seq long, op string, src long, dst long, ts timestamp, commit_ts long"

#: Shares of writes that part the levels, the factors of the levels from the second on, and the events below which the baseline holds.
WRITE_LEVELS, LEVEL_FACTORS, LEAST_EVENTS = (0.1, 0.25, 0.5, 0.75), (1.0, 1.5, 3.0, 5.0), 8


def latest(deltas: DataFrame) -> DataFrame:
    """The last record of each (src, dst): (src, dst, op, commit_ts). Partial maxima first, so a hot edge is one row a task."""
    return deltas.groupBy("src", "dst").agg(F.max_by(F.struct("op", "commit_ts"), "seq").alias("r")).select("src", "dst", "r.op", "r.commit_ts")


def apply_deltas(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """Merged edges (src, dst): the base without what the log decides, and what the log inserted."""
    last = latest(deltas)
    kept = base.select("src", "dst").join(last.select("src", "dst"), ["src", "dst"], "left_anti")
    return kept.union(last.where("op = 'INSERT'").select("src", "dst"))


def apply_deltas_ts(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """Like ``apply_deltas`` with each edge's commit_ts; ``base`` needs that column."""
    last = latest(deltas)
    kept = base.select("src", "dst", "commit_ts").join(last.select("src", "dst"), ["src", "dst"], "left_anti")
    return kept.union(last.where("op = 'INSERT'").select("src", "dst", "commit_ts"))


def snapshot_edges(base: DataFrame, deltas: DataFrame, read_ts: int) -> DataFrame:
    """The edges that a reader at ``read_ts`` sees: base edges and records up to that commit, the last one wins."""
    seen = base.where((F.col("commit_ts") == 0) | (F.col("commit_ts") <= read_ts))
    return apply_deltas(seen, deltas.where((F.col("commit_ts") > 0) & (F.col("commit_ts") <= read_ts)))


def neighbors_merged(base: DataFrame, deltas: DataFrame, v: int) -> DataFrame:
    """Neighbours of a vertex with its pending updates; the filter reaches both scans."""
    return apply_deltas(base.where(F.col("src") == v), deltas.where(F.col("src") == v)).select("dst").orderBy("dst")


def delta_token(base_version: int, deltas: DataFrame, v: int) -> tuple[int, int | None]:
    """(base version, last seq of the vertex): equal tokens mean an unchanged neighbourhood."""
    return base_version, deltas.where(F.col("src") == v).agg(F.max("seq")).first()[0]


def chain_lengths(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("src").agg(F.count(F.lit(1)).alias("records"))


def update_sketch(events: DataFrame, baseline: int = 4) -> DataFrame:
    """(id, reads, writes, write_ratio, threshold, reservation) from (id, reads, writes) counts.

    The more of a vertex's events are writes, the more records may gather
    before its page is consolidated; with few events the baseline holds.
    """
    total = F.col("reads") + F.col("writes")
    ratio = F.when(total > 0, F.col("writes") / total).otherwise(F.lit(0.0))
    base = max(baseline, 1)
    level = F.lit(0)
    for bound in WRITE_LEVELS:
        level = level + (ratio >= bound).cast("int")
    threshold = F.when(total < LEAST_EVENTS, F.lit(base)).when(level == 0, F.lit(1))
    for i, factor in enumerate(LEVEL_FACTORS, 1):
        threshold = threshold.when(level == i, F.lit(max(1, int(base * factor))))
    return events.select("id", "reads", "writes", ratio.alias("write_ratio"), threshold.cast("long").alias("threshold"), F.when(total < LEAST_EVENTS, F.lit(0)).otherwise(level).cast("long").alias("reservation"))
