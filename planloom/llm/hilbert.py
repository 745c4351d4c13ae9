"""Hilbert curve keys of integer points, a whole batch at once."""

from __future__ import annotations

import numpy as np


def keys(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of points (n, dims), whole numbers below 2 ** bits.

    The transform of Skilling (2004): undo the excess work of the highest bits down, Gray encode, then interleave.
    """
    x = points.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        p = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = one << np.uint64(bits - 1)
    while q > one:
        t ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)
