"""Vectorised reading of Arrow text columns: many documents as one array of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
SEED = 20240229

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)  # digits, letters, and every byte of a character outside ASCII
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
BYTE_VALUES = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64)[LOWER]
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows with about ``most`` bytes; null is empty, texts stay whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1))
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of maximal runs of ``member`` bytes; a run ends with its document."""
    before, after = np.zeros_like(member), np.zeros_like(member)
    before[1:], after[:-1] = member[:-1], member[1:]
    inner = offsets[1:-1]
    before[inner[inner < len(member)]] = False
    after[inner[inner > 0] - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, A-Z taken as a-z; spans may overlap."""
    powers = np.empty(len(data) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = BASE
    inverse = np.full(len(data) + 1, BASE_INVERSE, np.uint64)
    inverse[0] = 1
    powers, inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word, and for each document the index of its first word (one more at the end)."""
    starts, ends = spans(IS_WORD[data], offsets)
    return span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in rising order, and the index of each document's first (one more at the end).

    A document of fewer than ``size`` words, but not none, is one shingle.
    """
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    left = np.repeat(first[1:], n) - at
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    weights = np.random.default_rng(SEED + 1).integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for j in range(size):
        total += np.where(left > j, padded[at + j], np.uint64(0)) * weights[j]
    total = mixed(total)
    order = np.lexsort((total, doc))
    doc, total = doc[order], total[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])
    doc, total = doc[fresh], total[fresh]
    return total, np.searchsorted(doc, np.arange(len(n) + 1))


def per_document(values: np.ndarray, first: np.ndarray, combine: np.ufunc, empty) -> np.ndarray:
    """``combine`` over each document's run of ``values``; ``empty`` for a document without any."""
    out = np.full(len(first) - 1, empty, values.dtype)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = combine.reduceat(values, first[:-1][full])
    return out
