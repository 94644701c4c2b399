"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash. A row's fractional rank
is its rank within the source, moved by a seeded phase of the source, over the
source's rows: the rows of a source lie evenly over [0, 1), and sources with
few rows do not meet in one place. Sorted by it, any stretch of rows holds the
sources in their proportions; the sorted rows are cut into shards whose counts
differ by one at most, so each shard matches the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import uniform
from meshwork.llm.ranking import bucket_count, ranked
from meshwork.runtime import materialise, small_join

SHARDS = 16


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "shard") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: the shards' counts differ by one at most; ``slot`` runs from 0
    without gaps. Size is the text's bytes plus one, null like empty. Null is a
    source of its own. The order within a source is that of a hash of id and
    text, so null or repeated ids spread too; rows that are equal in both are
    interchangeable. An empty table gives an empty result; further columns are
    ignored. A text of any length is read where it stands.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
    )
    rows = materialise(keyed.withColumn("u", uniform(seed, F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "size", "crc"))), "rows")
    per_source = materialise(rows.groupBy("source").agg(F.count(F.lit(1)).alias("of")).withColumn("phase", uniform(seed, F.col("source"))), "sources")
    total = rows.count()
    buckets = bucket_count(total)
    by_source = small_join(ranked(rows, ["source"], "u", ["id", "size", "crc"], buckets, "rank"), per_source, "source")
    spread = materialise(by_source.withColumn("place", (F.col("rank") + F.col("phase")) / F.col("of")), "placed")
    whole = ranked(spread, [], "place", ["u", "id", "size", "crc", "source"], buckets, "at")
    n = F.lit(max(total, 1))
    number = F.floor(F.col("at") * shards / n) if total * shards < 2**52 else F.expr(f"at * {shards} div {max(total, 1)}")
    out = whole.withColumn("shard", number.cast("int"))
    first = F.ceil(F.col("shard").cast("double") * n / shards).cast("long")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", (F.col("at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
