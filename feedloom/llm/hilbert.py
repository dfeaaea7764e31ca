"""Hilbert curve indices of points on a grid, for whole numpy arrays at once."""

from __future__ import annotations

import numpy as np


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of rows of cell numbers (each below 2**bits).

    The cell numbers are turned into the curve's axes bit plane by bit plane: where an axis has
    the plane's bit, the first axis is mirrored below it, elsewhere the two are exchanged. A Gray
    code over the axes and an interleaving of their bits follow. dims * bits is at most 62.
    """
    x = np.asarray(cells, np.int64).copy()
    rows, dims = x.shape
    if dims * bits > 62:
        raise ValueError("dims * bits is at most 62")
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for d in range(dims):
            mirrored = (x[:, d] >> plane & 1).astype(bool)
            swap = (x[:, 0] ^ x[:, d]) & low
            x[:, 0] ^= np.where(mirrored, low, swap)
            if d:
                x[:, d] ^= np.where(mirrored, 0, swap)
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(rows, np.int64)
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] >> plane & 1, (1 << plane) - 1, 0)
    x ^= turn[:, None]
    out = np.zeros(rows, np.int64)
    for plane in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | (x[:, d] >> plane & 1)
    return out
