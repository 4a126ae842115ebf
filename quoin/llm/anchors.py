"""Anchors: of every window of `length` bytes, the position of its smallest k-gram hash.

Equal windows choose the same relative position, so equal windows share an anchor's hash; a window whose anchor's
hash is found once only is not repeated anywhere. Several documents are hashed in one array.
"""

from __future__ import annotations

import numpy as np

#: A position within the bytes that are hashed together takes so many low bits.
CHUNK_BITS = 22
CHUNK = 1 << CHUNK_BITS

_rng = np.random.default_rng(20240607)
_table = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_odd = _rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(t: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram of t; k is a power of two."""
    h, m, step = _table[t], 1, 0
    while m < k:
        h = h[:-m] * _odd[step] + h[m:]
        m, step = 2 * m, step + 1
    h ^= h >> np.uint64(29)
    h *= _odd[7]
    h ^= h >> np.uint64(32)
    return h


def gram(length: int) -> int:
    """A power of two, at most a third of the length: 32 for 100."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    m, have = a, 1
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (w - have)], m[w - have :]) if have < w else m


def anchors(t: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """t: documents one after another, shorter than CHUNK together; ends: where each ends.

    (hash, first window, windows) of each run of windows within one document that share an anchor.
    """
    if len(t) < length:
        return (np.zeros(0, np.int64),) * 3
    h = gram_hashes(t, k)
    mask = np.uint64(CHUNK - 1)
    tagged = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    low = (sliding_min(tagged, length - k + 1) & mask).astype(np.int64)
    n = len(low)
    inside = np.ones(n, dtype=bool)
    for e in ends.tolist():
        inside[max(0, e - length + 1) : min(n, e)] = False
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    keep = inside[first]
    first, count = first[keep], count[keep]
    return h[low[first]].view(np.int64), first, count
