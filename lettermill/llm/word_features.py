"""Hashed features of distinct words: the word, affixes and byte n-grams, as rows of feature numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import text as T


def features(values: pa.Array, n_features: int, prefixes: tuple = (), suffixes: tuple = (), grams: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 to n_features - 1 (a power of two) of all words one after the other, and how many each word has."""
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    up = T.powers(len(data) + 1)
    sums = np.append(np.uint64(0), np.cumsum(T._tables()[0][data] * up[:-1]))
    base = int(up[1]) if len(up) > 1 else 1
    down = np.ones(len(data) + 1, np.uint64)
    down[1:] = np.cumprod(np.full(len(data), pow(base, -1, 1 << 64), np.uint64))

    def numbered(kind: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[begin]) * down[begin]
        return (T.mix(h + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(n_features - 1)).astype(np.int64)

    owners, found = [np.arange(n)], [numbered(1, offsets[:-1], offsets[1:])]
    for k in prefixes:
        own = np.flatnonzero(sizes >= k)
        owners.append(own)
        found.append(numbered(100 + k, offsets[own], offsets[own] + k))
    for k in suffixes:
        own = np.flatnonzero(sizes >= k)
        owners.append(own)
        found.append(numbered(200 + k, offsets[own + 1] - k, offsets[own + 1]))
    owner = np.repeat(np.arange(n), sizes)
    for k in grams:
        at = np.flatnonzero(np.arange(len(data)) + k <= offsets[1:][owner])
        owners.append(owner[at])
        found.append(numbered(300 + k, at, at + k))
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return found[order], np.bincount(owners, minlength=n)
