"""Order statistics of sliding windows over an array, at a cost that does not depend on the windows' width."""

from __future__ import annotations

import numpy as np


class SlidingOrder:
    """Values by rank, one bit of the rank per level, with running counts of zero bits: the k-th smallest of any stretch takes
    one look-up per level, for all stretches at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.sorted, rank = np.unique(values, return_inverse=True)
        self.zeros: list[np.ndarray] = []
        for bit in reversed(range(max(len(self.sorted) - 1, 0).bit_length())):
            one = rank >> bit & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]).astype(np.int32))
            rank = np.concatenate([rank[one == 0], rank[one == 1]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest (from 0) of ``values[lo:hi]`` for each of the given stretches; not a number of an empty one."""
        full = hi > lo
        if not len(self.sorted):
            return np.full(len(lo), np.nan)
        lo, hi = np.where(full, lo, 0), np.where(full, hi, 1)
        k, rank = np.where(full, k, 0), np.zeros(len(lo), np.int64)
        for zeros in self.zeros:
            a, b = zeros[lo], zeros[hi]
            one = k >= b - a
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
            k = np.where(one, k - (b - a), k)
            rank = rank << 1 | one
        return np.where(full, self.sorted[rank], np.nan)

    def quantile(self, lo: np.ndarray, hi: np.ndarray, q: float) -> np.ndarray:
        """Interpolated quantile (linear rule) of each stretch."""
        at = q * (np.maximum(hi - lo, 1) - 1)
        a, b = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
        x, y = self.kth(lo, hi, a), self.kth(lo, hi, b)
        return np.where(a == b, x, (b - at) * x + (at - a) * y)
