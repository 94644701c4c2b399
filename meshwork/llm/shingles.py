"""Word-shingle sets of whole texts as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose words are hashed at once.
CHUNK_BYTES = 2_000_000

_rng = np.random.Generator(np.random.PCG64(20240607))
_byte = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_byte[0x41:0x5B] = _byte[0x61:0x7B]  # A-Z count as a-z
letter_codes = _byte
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array):
    """(first row, rows) of stretches of about CHUNK_BYTES; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    group = np.cumsum(sizes) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row (null: none) and where each begins (one more entry than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    return data, bounds


def word_spans(data: np.ndarray, bounds: np.ndarray, blank: np.ndarray = _blank):
    """Words as runs of bytes outside ``blank``: hashes (A-Z lowered), first word of each text, first byte and length of each word."""
    none = np.zeros(0, np.int64)
    solid = ~blank[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins[inner] = solid[inner]
    at = np.flatnonzero(begins)
    first = np.searchsorted(at, bounds)
    if not len(at):
        return np.zeros(0, np.uint64), first, none, none
    letters = data[solid]
    offsets = (np.cumsum(solid, dtype=np.int32) - 1)[at]  # of each word among the bytes of words
    sizes = np.diff(np.append(offsets, len(letters)))
    power = np.cumprod(np.full(int(sizes.max()), _TURN))
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(offsets, sizes)
    hashes = mixed(np.add.reduceat(_byte[letters] * power[place], offsets) + sizes.astype(np.uint64) * _STEP)
    return hashes, first, at, sizes


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    Fewer words than k: the whole sequence is the one shingle; no words: none.
    """
    words, first, _, _ = word_spans(*text_bytes(texts))
    rolled = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    powers = np.cumprod(np.full(k, _STEP))
    for j in range(k):
        rolled += words[j : j + len(rolled)] * powers[j]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            powers = np.cumprod(np.full(b - a, _STEP))
            out.append(mixed(np.array([(words[a:b] * powers).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
