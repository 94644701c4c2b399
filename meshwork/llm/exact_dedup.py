"""Exact deduplication against immutable snapshots with binary-fuse filters.

Documents arrive in batches. The distinct digests of a finished batch are an
immutable snapshot with a static filter of about nine bits a digest, built in
shards. A later batch is first grouped by digest on its own, which also folds
hot groups of copies to one row each. Its digests are then screened shard by
shard: what every filter denies is new; what a filter affirms is joined with
the exact buckets of the snapshots, and the texts are compared byte by byte.
Within a batch equal SHA-256 digests count as equal bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import BLANKS
from meshwork.runtime import materialise, small_join

#: Digests for which a shard's filter is built at once, and the number of shards at least.
SHARD_KEYS, LEAST_SHARDS = 500_000, 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _slots(hashes: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots for each hash, in three neighbouring segments."""
    first = ((hashes >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((hashes >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (hashes & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(hashes: np.ndarray) -> np.ndarray:
    return (_mixed(hashes) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """A binary-fuse filter over distinct uint64 keys: 12 bytes of parameters, then the prints."""
    n = max(len(keys), 2)
    segment = 1 << max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
    room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)))
    segments = max(1, -(-room // segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1000):
        if seed % 10 == 9:  # does not happen in practice: give it more room
            segments += max(1, segments // 8)
            size = (segments + 2) * segment
        hashes = _mixed(keys + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        slots = _slots(hashes, segment, segments)
        count = np.bincount(slots.ravel(), minlength=size)
        total = np.zeros(size, np.int64)  # of the keys' numbers at each slot
        for row in slots:
            np.add.at(total, row, np.arange(len(keys)))
        rounds, peeled, single = [], 0, np.flatnonzero(count == 1)
        while len(single):
            key, at = np.unique(total[single], return_index=True)
            rounds.append((key, single[at]))
            peeled += len(key)
            for row in slots:
                np.subtract.at(count, row[key], 1)
                np.subtract.at(total, row[key], key)
            touched = np.unique(slots[:, key])
            single = touched[count[touched] == 1]
        if peeled == len(keys):
            break
    else:
        raise RuntimeError("no filter found: are the keys distinct?")
    table, prints = np.zeros(size, np.uint8), _prints(hashes)
    for key, slot in reversed(rounds):
        table[slot] = prints[key] ^ table[slots[0, key]] ^ table[slots[1, key]] ^ table[slots[2, key]]
    return np.array([seed, segment, segments], np.uint32).tobytes() + table.tobytes()


def in_filter(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key whether the filter holds it; wrongly yes for about one key in 256."""
    seed, segment, segments = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    table = np.frombuffer(blob, np.uint8, offset=12)
    hashes = _mixed(keys + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    a, b, c = _slots(hashes, segment, segments)
    return (table[a] ^ table[b] ^ table[c]) == _prints(hashes)


def _keys(table: pa.Table) -> np.ndarray:
    return table["key"].to_numpy().view(np.uint64)


def _filter_rows(table: pa.Table) -> pa.Table:
    shard = table["shard"][0].as_py()
    return pa.table({"shard": pa.array([shard], pa.int64()), "filter": pa.array([build_filter(np.unique(_keys(table)))], pa.binary())})


def _screened(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    keys = _keys(incoming)
    found = np.zeros(len(keys), bool)
    for blob in filters["filter"]:
        found |= in_filter(blob.as_py(), keys)
    return incoming.select(["batch", "sha"]).filter(pa.array(found))


def snapshot_filters(snapshot: DataFrame) -> DataFrame:
    """One filter a shard, from a snapshot's (shard, key) rows."""
    return snapshot.select("shard", "key").groupBy("shard").applyInArrow(_filter_rows, "shard long, filter binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The (batch, sha) of the incoming digests that some filter affirms."""
    return incoming.select("shard", "key", "batch", "sha").groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_screened, "batch int, sha string")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, batch: Column | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after each run of white space became one
    space; null counts as empty. Of equal texts the smallest id stays. ``batch``
    tells each row's batch (0 to ``batches`` - 1, the order of arrival); by
    default a hash of the id deals rows out. Exactly one row of equal texts
    stays: that of the smallest id, any id before null; where rows repeat that id
    and text, or none of them has an id, one of them, and which one does not show
    in the result. An empty table gives an empty result; further columns are
    ignored. A text of any length is hashed where it stands.
    """
    text = normalised(F.col(text_col))
    arrival = batch if batch is not None else F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(arrival.cast("int"), F.lit(0)).alias("batch"), F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("key"))
    # the row's number is written with it, so it does not change when the table is read again
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    shards = max(LEAST_SHARDS, -(-rows.count() // SHARD_KEYS))
    # copies fold here, before anything else is dealt out
    groups = materialise(
        rows.groupBy("batch", "sha").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"), F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).withColumn("keep", F.col("first.id")).withColumn("shard", F.pmod(F.hash("sha"), F.lit(shards)).cast("long")),
        "groups",
    )
    links, filters, fresh = None, None, None
    for b in range(1, batches):
        # the snapshot of the batch before this one holds what no earlier snapshot has
        last = groups.where(F.col("batch") == b - 1)
        if links is not None:
            last = last.join(links.select("batch", "sha"), ["batch", "sha"], "left_anti")
        fresh = last if fresh is None else fresh.unionByName(last)
        new_filters = materialise(snapshot_filters(last), "filters")
        filters = new_filters if filters is None else filters.unionByName(new_filters)
        incoming = groups.where(F.col("batch") == b)
        likely = screen(incoming, filters)
        held = fresh.select("sha", F.col("keep").alias("held_id"), F.col("batch").alias("root"))
        pairs = materialise(likely.join(incoming.select("batch", "sha", "keep"), ["batch", "sha"]).join(held, "sha"), "pairs")
        same = same_bytes(docs, pairs, id_col, text_col)
        links = same if links is None else links.unionByName(same)
    own = groups.select("batch", "sha", "first", "n")
    rooted = own.withColumn("root", F.col("batch")) if links is None else own.join(links, ["batch", "sha"], "left").withColumn("root", F.coalesce("root", "batch"))
    classes = rooted.groupBy("sha", "root").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"), F.collect_set("batch").alias("batches"))
    named = classes.select("sha", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size", F.explode("batches").alias("batch"))
    return rows.join(named, ["batch", "sha"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def same_bytes(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of the pairs (batch, sha, keep, held_id, root) those whose texts are the same: batch, sha, root.

    ``sha`` names one incoming group and one held bucket, so there is one pair
    of representatives for each, however many copies there are.
    """
    wanted = materialise(pairs.select(F.col("keep").alias("wanted")).union(pairs.select("held_id")).distinct(), "wanted")
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    found = small_join(rows, wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    texts = found.select("id", F.sha2("text", 256).alias("of"), F.col("text").cast("binary").alias("body")).dropDuplicates(["id", "of"])

    def with_text(df, id_name, body):
        own = texts.withColumnRenamed("body", body)
        return df.join(own, F.col(id_name).eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of"))).drop("id", "of")

    return materialise(with_text(with_text(pairs, "keep", "a"), "held_id", "b").where("a = b").select("batch", "sha", "root"), "same")
