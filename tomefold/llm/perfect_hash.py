"""Minimal perfect hash functions of sets of integer keys, in numpy.

Keys are hashed into a bit array a little larger than their number; those alone in their
place set its bit, the others go on to the next, smaller array.  The index of a key is the
number of set bits before its own, so n keys get the indexes 0 to n - 1.  A key outside
the set may land on a set bit: whoever looks up compares with the key kept at the index.
"""

from __future__ import annotations

import numpy as np

ROOM = 2.0


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = (keys + np.uint64(level + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """``sizes`` (bits of each level, multiples of 64), ``bits`` (the levels' words, one after another)."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = np.asarray(sizes, np.int64), np.asarray(bits, np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.bits).astype(np.int64))]
        self.first = np.r_[0, np.cumsum(self.sizes)]

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        """The function of distinct ``keys``."""
        left, sizes, words = np.asarray(keys).astype(np.uint64), [], []
        while len(left):
            size = 64 * -(-int(ROOM * len(left)) // 64)
            at = _place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            level = np.zeros(size, bool)
            level[at[alone]] = True
            sizes.append(size)
            words.append(np.packbits(level, bitorder="little").view("<u8"))
            left = left[~alone]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.empty(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 or any index for keys outside the set."""
        keys = np.asarray(keys).astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = self.first[level] + _place(keys[todo], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            value = self.bits[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = self.before[word[hit]] + below
            todo = todo[~hit]
        return out
