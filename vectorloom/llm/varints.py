"""Sorted integers as variable-length gaps."""

from __future__ import annotations

import numpy as np


def pack_gaps(values: np.ndarray) -> bytes:
    """Sorted integers as variable-length gaps."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 10):
        more = gaps >> np.uint64(7 * k) != 0
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        last = size[has] == k + 1
        out[(ends - size)[has] + k] = ((gaps[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(last, 0, 128).astype(np.uint8)
    return out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts + 1
    gaps = np.zeros(len(ends), np.uint64)
    for k in range(int(size.max())):
        has = size > k
        gaps[has] |= (raw[starts[has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return np.cumsum(gaps, dtype=np.uint64)
