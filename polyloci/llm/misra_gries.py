"""Mergeable Misra-Gries summaries over whole-number keys, as sorted NumPy arrays."""

from __future__ import annotations

import numpy as np


def combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order, each once, with the sum of its counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def capacity(mass: int, least: int) -> int:
    """Counters that a summary of so much mass needs so that a key of `least` occurrences can't be lost: with c counters it
    loses at most mass / (c + 1) of any count, and that is below `least`."""
    return mass // max(least, 1) + 1


class Summary:
    """At most `size` counters after each compaction, whatever is merged in. `lost` bounds what any count lacks."""

    def __init__(self, size: int, pending: int = 1 << 20):
        self.size, self.pending = size, max(pending, size)
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.lost = 0
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._rows = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._rows += len(keys)
        if self._rows >= self.pending:
            self.compact()

    def compact(self) -> None:
        if not self._waiting:
            return
        parts = [(self.keys, self.counts), *self._waiting]
        self._waiting, self._rows = [], 0
        keys, counts = combined(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        if len(keys) > self.size:
            # Taking the (size + 1)-th largest count from all takes it from at least size + 1 counters.
            less = int(np.partition(counts, len(counts) - self.size - 1)[len(counts) - self.size - 1])
            left = counts > less
            keys, counts = keys[left], counts[left] - less
            self.lost += less
        self.keys, self.counts = keys, counts

    def at_least(self, least: int) -> np.ndarray:
        """The keys that may occur `least` times: none that does is missing."""
        self.compact()
        return self.keys[self.counts + self.lost >= least]
