"""Strassen's recursive multiplication of integer matrices, exact in 64 bits."""

from __future__ import annotations

import numpy as np

#: Blocks with a side of at most so many rows or columns are multiplied plainly.
LEAF = 32


def _even(block: np.ndarray) -> np.ndarray:
    """A block with zeros added where a side is odd."""
    rows, columns = block.shape
    return np.pad(block, ((0, rows % 2), (0, columns % 2))) if rows % 2 or columns % 2 else block


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by seven products of halves, which are only added and subtracted.

    Additions wrap modulo 2**64, so every entry whose true value fits 64 bits is exact, whatever the sums between.
    """
    rows, columns = a.shape[0], b.shape[1]
    if min(rows, a.shape[1], columns) <= leaf:
        return a @ b
    a, b = _even(a), _even(b)
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    m1 = multiply(a11 + a22, b11 + b22, leaf)
    m2 = multiply(a21 + a22, b11, leaf)
    m3 = multiply(a11, b12 - b22, leaf)
    m4 = multiply(a22, b21 - b11, leaf)
    m5 = multiply(a11 + a12, b22, leaf)
    m6 = multiply(a21 - a11, b11 + b12, leaf)
    m7 = multiply(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * k), np.int64)
    out[:i, :k] = m1 + m4 - m5 + m7
    out[:i, k:] = m3 + m5
    out[i:, :k] = m2 + m4
    out[i:, k:] = m1 - m2 + m3 + m6
    return out[:rows, :columns]
