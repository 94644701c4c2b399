"""Packing by concatenating and cutting.

First pass: every text is encoded, and the ids are written with their place
within the partition. The partitions' token totals, a row each, are summed up
in order: that gives every partition its offset in the one long sequence.
Second pass: each document's ids are cut where the fixed windows end; the
pieces on either side of a cut are marked as boundary records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.wordbpe import WordBpe
from meshwork.runtime import materialise, small_join

WINDOW, END_ID = 2048, 1
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 12_000_000

_encoders: dict[str, WordBpe] = {}


def _encoder(path: str) -> WordBpe:
    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    return _encoders[path]


def _chunks(batch: pa.RecordBatch):
    """Slices of a batch of about CHUNK_BYTES each; a longer text is a slice alone."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0)).astype(np.int64)
    group = np.cumsum(sizes) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode_partition(path: str, batches):
    """(id, part, start, n_tokens, ids): ids as little-endian uint32, END_ID last."""
    encoder, part, start, seen = _encoder(path), TaskContext.get().partitionId(), 0, 0
    for whole in batches:
        for batch in _chunks(whole):
            flat, n = encoder.encode(batch.column("text"))
            ends = np.cumsum(n + 1)
            out = np.full(int(ends[-1]), END_ID, np.uint32)
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = flat
            starts = start + ends - (n + 1)
            ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.full(len(n), part, np.int64)), pa.array(np.arange(seen, seen + len(n))), pa.array(starts), pa.array(n + 1), ids],
                names=["id", "part", "row", "start", "n_tokens", "ids"],
            )
            start += int(ends[-1])
            seen += len(n)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first pass, written to the shared scratch folder."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    coded = rows.mapInArrow(lambda batches: encode_partition(tokenizer, batches), f"id {kind}, part long, row long, start long, n_tokens long, ids binary")
    return materialise(coded, "tokens")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, continued, continues.

    Every sequence but the last holds exactly ``window`` ids. Null texts count
    as empty: a lone END_ID. A text of any length is cut as often as needed;
    repeated rows are packed as often as they occur; an empty table gives no
    pieces; further columns are ignored. The order is that of the partitions.
    """
    coded = encode(docs, tokenizer, id_col, text_col)
    parts = coded.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(parts.select("part", before.alias("before")), "offsets")
    placed = small_join(coded, offsets, "part").withColumn("at", F.col("before") + F.col("start"))
    w = F.lit(window).cast("long")
    at, n = F.col("at"), F.col("n_tokens")
    first, last = F.expr(f"at div {window}"), F.expr(f"(at + n_tokens - 1) div {window}")

    def piece(s):
        begin, end = F.greatest(s * w, at) - at, F.least((s + 1) * w, at + n) - at
        ids = F.substring(F.col("ids"), (begin * 4 + 1).cast("int"), ((end - begin) * 4).cast("int"))
        return F.struct(begin.alias("start"), (end - begin).alias("length"), ids.alias("ids"), s.alias("sequence_id"), (at + begin - s * w).alias("offset"))

    cut = placed.select("id", n.alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return cut.select(
        F.col("id").alias(id_col), "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset",
        (F.col("p.start") > 0).alias("continued"), (F.col("p.start") + F.col("p.length") < F.col("doc_tokens")).alias("continues"),
    )


def packed_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    pieces = pack(docs, tokenizer)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "continued", "continues")
