"""Sets of hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .arrow import flat

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        done = 1
        while done < len(out):
            more = min(done, len(out) - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        _powers[base] = out
    return _powers[base][:n]


BYTE = np.zeros(256, np.uint64)
BYTE[:] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, row of each word) of all texts; A-Z count as a-z."""
    data, offsets = flat(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    summed = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[LOWER[data]] * powers(BASE, n), out=summed[1:])
    value = (summed[ends] - summed[starts]) * powers(INVERSE, n)[starts]
    return mix(value + (ends - starts).astype(np.uint64)), np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted set of k-word shingles of each text.

    With fewer than k words the whole sequence is the only shingle; without words, or for null, the set
    is empty. Shingles are told apart by 64 bits.
    """
    word, row = word_hashes(texts)
    rows = len(texts)
    counts = np.bincount(row, minlength=rows)
    begins = np.cumsum(counts) - counts
    value = word.copy()
    span = np.minimum(counts[row], k)  # words in the shingle that begins here
    for j in range(1, k):
        more = np.flatnonzero(span > j)
        more = more[more + j < len(word)]
        value[more] = mix(value[more] * np.uint64(31) + word[more + j])
    value = mix(value + span.astype(np.uint64))
    keep = np.arange(len(word)) - begins[row] <= counts[row] - span
    value, row = value[keep], row[keep]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.r_[0, np.cumsum(np.bincount(row[new], minlength=rows))]


def set_keys(values: np.ndarray, offsets: np.ndarray, half: int = 0) -> np.ndarray:
    """One of two independent 64-bit keys of each set, never 0; 0 for an empty one. Both together tell sets apart."""
    spread = mix(values ^ np.uint64(BASE)) if half == 0 else mix(mix(values) + np.uint64(BASE))
    sums = np.r_[np.uint64(0), np.cumsum(spread)]
    n = np.diff(offsets)
    keys = mix(sums[offsets[1:]] - sums[offsets[:-1]] + n.astype(np.uint64))
    return np.where(n > 0, np.maximum(keys, np.uint64(1)), np.uint64(0)).view(np.int64)
