"""A growing table from 64-bit hashes to integers, looked up for many hashes at once."""

from __future__ import annotations

import numpy as np


class Known:
    """Sorted hashes with `width` 32-bit values each: a large table, and a small one that takes what is new."""

    def __init__(self, width: int):
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.main = self.recent = (np.zeros(0, np.uint64), np.zeros((self.width, 0), np.int32))

    def __len__(self) -> int:
        return len(self.main[0]) + len(self.recent[0])

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """hashes that aren't known yet; values (width, n)."""
        self.recent = _merged(self.recent, (hashes, values.astype(np.int32)))
        if len(self.recent[0]) > max(100_000, len(self.main[0]) // 4):
            self.main = _merged(self.main, self.recent)
            self.recent = (np.zeros(0, np.uint64), np.zeros((self.width, 0), np.int32))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """(width, n) values, -1 where a hash isn't known."""
        out = np.full((self.width, len(hashes)), -1, dtype=np.int32)
        for keys, values in (self.main, self.recent):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                out[:, hit] = values[:, at[hit]]
        return out


def _merged(a, b):
    keys = np.concatenate((a[0], b[0]))
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate((a[1], b[1]), axis=1)[:, order]
