"""Vectorised word and shingle hashes over batches of texts (numpy, inside tasks).

Words follow the subpackage's convention (runs of characters other than space
and U+0009..U+000D). A word's hash is a 64-bit polynomial over random byte
values, finished with a mixing step, so equal hashes mean equal words but for a
chance of about 2**-58 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are hashed at once (a longer text is a block of its own).
BLOCK = 1 << 21

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUES[_SPACES] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, BLOCK)
        got = np.empty(size, np.uint64)
        got[0] = 1
        have = 1
        while have < size:  # doubling: powers[have:2*have] = powers[:have] * base**have
            step = min(have, size - have)
            got[have : have + step] = got[:step] * np.uint64(pow(base, have, 1 << 64))
            have += step
        _powers[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def blocks(lengths: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` in total, or of one row."""
    lo = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets of the rows, bytes) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    got = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], got[at[0] : at[-1]]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where a word begins; a row's start always breaks words."""
    inside = ~_SPACES[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begin[heads] = inside[heads]
    return np.flatnonzero(begin)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) byte positions of the words."""
    starts = word_starts(data, offsets)
    inside = ~_SPACES[data]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    last[heads - 1] = inside[heads - 1]
    return starts, np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, word offsets of the rows) of one block."""
    starts = word_starts(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    values = _VALUES[_LOWER[data] if lower else data]
    values *= powers(_BASE, len(data))
    hashes = np.add.reduceat(values, starts)
    hashes *= powers(_INVERSE, len(data))[starts]
    return mix(hashes), np.searchsorted(starts, offsets)


def ngrams(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n-gram inside a row, n-gram offsets of the rows)."""
    count = np.maximum(np.diff(at) - n + 1, 0)
    out = np.concatenate([[0], np.cumsum(count)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * np.uint64((_BASE * (2 * k + 3) ** 5 | 1) & _MASK)
    inside = np.ones(len(total), bool)
    for k in range(1, n):  # windows that start in the last n - 1 words of a row leave it
        ends = at[1:][np.diff(at) >= k] - k
        inside[ends[ends < len(total)]] = False
    return mix(total[inside]), out
