"""Byte codecs of id lists.

* Prefix-tagged ids, one to four bytes, big endian: the two highest bits of the
  first byte tell how many bytes follow; an id has 6, 14, 22 or 30 bits.
* Gaps: ascending ids as a first id and the gaps between them, seven bits a byte.
* Patched frames: the gaps in blocks of 128, each at the width that most of its
  gaps need; the high bits of the others come after the block.

Encoding the first kind is a Column expression. The rest works on Arrow batches,
in time about linear in the bytes: a giant's list is one value, read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_VALUE = (1 << 30) - 1
#: Gaps of a block, and the share of them that its width has to hold.
BLOCK, FITTING = 128, 0.9
#: Gaps whose frames are worked out at once, about.
FRAME_GAPS = 65_536


def encode_ids(ids: Column) -> Column:
    """Binary of an array of ids; an id outside 0 .. MAX_VALUE is an error."""

    def one(x):
        ok = F.when((x < 0) | (x > MAX_VALUE), F.raise_error(F.lit("id out of range")).cast("long")).otherwise(x)
        hex_of = lambda bits, tag, width: F.lpad(F.hex(ok + tag * (1 << bits)), width, "0")
        return F.when(ok < 1 << 6, hex_of(6, 0, 2)).when(ok < 1 << 14, hex_of(14, 1, 4)).when(ok < 1 << 22, hex_of(22, 2, 6)).otherwise(hex_of(30, 3, 8))

    return F.unhex(F.array_join(F.transform(ids, one), ""))


def _bytes(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and where each value begins (one more than values); null is empty."""
    data = pc.fill_null(data, b"").cast(pa.large_binary())
    bounds = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    if not len(data) or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(data) + 1, np.int64)
    return np.frombuffer(data.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _chain(step: np.ndarray) -> np.ndarray:
    """The places that are reached from place 0 when each leads ``step`` further, by doubling."""
    n = len(step)
    jump = np.append(np.minimum(np.arange(n) + step, n), n)
    seen = np.zeros(n + 1, bool)
    seen[0], count = True, 0
    while (now := int(seen.sum())) != count:
        count = now
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
    return np.flatnonzero(seen)


def decode_tagged(data: pa.Array) -> pa.Array:
    raw, bounds = _bytes(data)
    size = (raw >> 6).astype(np.int64) + 1
    places = _chain(size)
    if len(np.setdiff1d(bounds, places)):
        raise ValueError("the data ends within an id")
    at = places[places < len(raw)]
    value = (raw[at] & 0x3F).astype(np.int64)
    for j in range(1, 4):
        more = size[at] > j
        value[more] = (value[more] << 8) | raw[at[more] + j]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), pa.array(value))


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low bits first, the last byte of a value below 128: the bytes, and the number of each value."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << (7 * k))
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    out = (np.repeat(values, sizes) >> (7 * place).astype(np.uint64)) & np.uint64(0x7F)
    last = place == np.repeat(sizes, sizes) - 1
    return np.where(last, out, out | np.uint64(0x80)).astype(np.uint8), sizes


def _read_varints(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values, and the place after each."""
    ends = np.flatnonzero(raw < 128) + 1
    if len(raw) and (not len(ends) or ends[-1] != len(raw)):
        raise ValueError("the data ends within a number")
    sizes = np.diff(ends, prepend=0)
    place = np.arange(len(raw)) - np.repeat(ends - sizes, sizes)
    parts = (raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
    return (np.add.reduceat(parts, ends - sizes) if len(ends) else np.zeros(0, np.uint64)).astype(np.int64), ends


def _lists(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and where each list begins; each list must ascend from 0 on."""
    ids = pc.fill_null(ids, pa.scalar([], ids.type))
    flat = np.asarray(pc.list_flatten(ids)).astype(np.int64)
    bounds = np.append(0, np.cumsum(np.asarray(pc.list_value_length(ids)).astype(np.int64)))
    first = np.zeros(len(flat), bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    gaps = np.where(first, flat, flat - np.append(0, flat[:-1]))
    if len(gaps) and (gaps[~first].min(initial=1) < 1 or gaps.min() < 0):
        raise ValueError("ids have to ascend from 0 on")
    return gaps, bounds


def _sums(gaps: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """From gaps to lists of ids."""
    total = np.append(0, np.cumsum(gaps))
    values = total[1:] - np.repeat(total[bounds[:-1]], np.diff(bounds))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int64)))


def encode_gap_lists(ids: pa.Array) -> pa.Array:
    gaps, bounds = _lists(ids)
    raw, sizes = _varints(gaps)
    at = np.append(0, np.cumsum(sizes))[bounds]
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def decode_gap_lists(data: pa.Array) -> pa.Array:
    raw, bounds = _bytes(data)
    gaps, ends = _read_varints(raw)
    return _sums(gaps, np.searchsorted(ends, bounds, side="right"))


def _bit_length(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for k in range(63):
        out += values >= (1 << k)
    return out


def _spread(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places at[i], at[i] + 1, ..., counts[i] of them for each i."""
    return np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _frames(gaps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of blocks that follow each other, and the number of each block.

    A block: width, exceptions, gaps at that width; then the places of the
    exceptions and their high bits.
    """
    bits, first, block = _bit_length(gaps), _starts(sizes), np.repeat(np.arange(len(sizes)), sizes)
    width = bits[np.lexsort((bits, block))][first + np.ceil(sizes * FITTING).astype(np.int64) - 1]
    each = width[block]
    low = gaps & ((1 << each) - 1)
    body = -(-sizes * width // 8)
    cells = np.zeros(8 * int(body.sum()), np.uint8)
    cells[_spread(8 * _starts(body), sizes * width)] = (np.repeat(low, each) >> _spread(np.zeros_like(each), each)) & 1
    odd = np.flatnonzero(gaps >> each)
    n_odd = np.bincount(block[odd], minlength=len(sizes))
    high, high_sizes = _varints(gaps[odd] >> each[odd])
    n_high = np.bincount(block[odd], high_sizes, len(sizes)).astype(np.int64)
    total = 2 + body + n_odd + n_high
    out, at = np.zeros(int(total.sum()), np.uint8), _starts(total)
    out[at], out[at + 1] = width, n_odd
    out[_spread(at + 2, body)] = np.packbits(cells)
    out[_spread(at + 2 + body, n_odd)] = odd - first[block[odd]]
    out[_spread(at + 2 + body + n_odd, n_high)] = high
    return out, total


def encode_frame_lists(ids: pa.Array) -> pa.Array:
    gaps, bounds = _lists(ids)
    lengths = np.diff(bounds)
    blocks = -(-lengths // BLOCK)
    nth = _spread(np.zeros_like(blocks), blocks)
    sizes = np.minimum(np.repeat(lengths, blocks) - BLOCK * nth, BLOCK)
    # so many gaps at once that their single bits stay small
    ends = np.cumsum(sizes)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(gaps), FRAME_GAPS)), len(sizes)))
    parts = [_frames(gaps[ends[i] - sizes[i] : ends[j - 1]], sizes[i:j]) for i, j in zip(cuts.tolist(), cuts[1:].tolist())]
    raw = np.concatenate([np.zeros(0, np.uint8), *(x for x, _ in parts)])
    per_block = np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])))
    body = np.diff(per_block[np.append(0, np.cumsum(blocks))])
    head, n_head = _varints(lengths)
    total = n_head + body
    out, at = np.zeros(int(total.sum()), np.uint8), _starts(total)
    out[_spread(at, n_head)], out[_spread(at + n_head, body)] = head, raw
    bounds = np.append(0, np.cumsum(total)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(bounds), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _varint_at(raw: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number that begins at each place, and the place after it."""
    value, at, going = np.zeros(len(at), np.int64), at.copy(), np.arange(len(at))
    for shift in range(0, 70, 7):
        if (at[going] >= ends[going]).any():
            raise ValueError("the data ends within a number")
        byte = raw[at[going]].astype(np.int64)
        value[going] |= (byte & 0x7F) << shift
        at[going] += 1
        going = going[byte >= 128]
    return value, at


def decode_frame_lists(data: pa.Array) -> pa.Array:
    """The first blocks of all lists at once, then the second ones, and so on."""
    raw, bounds = _bytes(data)
    at, ends, counts = bounds[:-1].copy(), bounds[1:], np.zeros(len(bounds) - 1, np.int64)
    some = np.flatnonzero(at < ends)
    counts[some], at[some] = _varint_at(raw, at[some], ends[some])
    if (counts > BLOCK * (ends - at)).any():
        raise ValueError("the data does not end with its last block")
    begin = np.append(0, np.cumsum(counts)).astype(np.int64)
    gaps, going, nth = np.zeros(begin[-1], np.int64), np.flatnonzero(counts), 0
    while len(going):
        a, e = at[going], ends[going]
        size = np.minimum(counts[going] - BLOCK * nth, BLOCK)
        if (a + 2 > e).any():
            raise ValueError("the data does not end with its last block")
        width, odd = raw[a].astype(np.int64), raw[a + 1].astype(np.int64)
        body = -(-size * width // 8)
        a += 2
        if (a + body + odd > e).any():
            raise ValueError("the data does not end with its last block")
        each, bit = np.repeat(width, size), np.repeat(8 * a, size) + _spread(np.zeros_like(size), size) * np.repeat(width, size)
        values = np.zeros(len(each), np.int64)
        for j in range(int(width.max())):
            wide = np.flatnonzero(each > j)
            place = bit[wide] + j
            values[wide] |= ((raw[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(np.int64) << j
        a += body
        where, a = a, a + odd
        for k in range(int(odd.max())):
            has = np.flatnonzero(odd > k)
            high, a[has] = _varint_at(raw, a[has], e[has])
            values[_starts(size)[has] + raw[where[has] + k]] |= high << width[has]
        gaps[_spread(begin[going] + BLOCK * nth, size)] = values
        at[going] = a
        nth += 1
        going = going[counts[going] > BLOCK * nth]
    if (at != ends).any():
        raise ValueError("the data does not end with its last block")
    return _sums(gaps, begin)


def _over_batches(f, kind: str):
    return lambda c: F.arrow_udf(f, kind)(c)


decode_ids = _over_batches(decode_tagged, "array<long>")
gap_encode, gap_decode = _over_batches(encode_gap_lists, "binary"), _over_batches(decode_gap_lists, "array<long>")
frame_encode, frame_decode = _over_batches(encode_frame_lists, "binary"), _over_batches(decode_frame_lists, "array<long>")
