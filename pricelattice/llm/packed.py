"""Ascending keys with counts, packed into a few bytes each for a shuffle."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers, seven bits a byte, the lowest first; a byte below 128 ends one."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), dtype=np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    out = np.empty(int(size.sum()), dtype=np.uint8)
    at = np.cumsum(size) - size
    live = np.arange(len(v))
    k = 0
    while len(live):
        more = size[live] > k + 1
        out[at[live] + k] = (v[live] & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        v[live] >>= np.uint64(7)
        live = live[more]
        k += 1
    return out.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    """What :func:`pack` has packed, as 64-bit integers."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    last = data < 128
    if last.all():
        return data.astype(np.int64)
    starts = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def pack_keys(keys: np.ndarray) -> bytes:
    """Different keys in ascending order, by the gaps between them."""
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))
