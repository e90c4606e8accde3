"""Places on a Hilbert curve for many points at once, in numpy."""

from __future__ import annotations

import numpy as np


def hilbert_places(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the curve of each row of non-negative integers below 2^bits; rows x axes, axes * bits <= 63.

    Level by level from the coarsest: the bits of all axes give a corner of the cube, whose number in Gray code is the
    next digit, run through backwards where the coarser digits ended odd; the finer bits are then reflected or swapped
    as the curve turns in that corner.
    """
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    place = np.zeros(len(points), np.int64)
    backwards = np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1) if axes else ():
        finer = (np.int64(1) << np.int64(level)) - 1
        corner = (x >> level) & 1
        gray = np.zeros_like(place)
        for bit in corner:
            gray ^= bit
            place = (place << 1) | (gray ^ backwards)
        backwards ^= gray
        for axis in range(axes):
            swap = np.where(corner[axis] == 1, 0, (x[0] ^ x[axis]) & finer)
            x[0] ^= np.where(corner[axis] == 1, finer, swap)
            x[axis] ^= swap
    return place
