"""Positions of points on a Hilbert curve, for many points at once."""

from __future__ import annotations


def hilbert_positions(cells, bits: int):
    """Position on the Hilbert curve of each row of ``cells`` (rows, dims), whole numbers below 2**bits.

    The cube of the leading bits is turned and mirrored into the curve's next cube, bit by bit, and the
    result is read in Gray order across the dimensions. dims * bits is at most 62.
    """
    import numpy as np

    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    dims = len(x)
    if dims * bits > 62:
        raise ValueError("dims * bits is more than 62")
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(dims):
            up = (x[i] >> level) & 1
            swap = np.where(up == 1, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up == 1, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> level) & 1 == 1, turn ^ ((1 << level) - 1), turn)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | (((x[i] ^ turn) >> level) & 1)
    return out
