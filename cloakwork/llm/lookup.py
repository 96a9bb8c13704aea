"""Positions of 64-bit keys in bounded tables that are sent to executors."""

from __future__ import annotations

import numpy as np


class Lookup:
    """The positions of distinct 64-bit keys, by open addressing; vectorised both ways."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.int64)
        self.bits = max(4, int(1.4 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.int64)
        self.at = np.full(1 << self.bits, -1, np.int32)  # -1: a free slot
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            self.keys[slot[free]], self.at[slot[free]] = keys[left[free]], left[free]  # the last of those that want a slot has it
            lost = self.at[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key isn't there."""
        slot = self._slot(keys)
        at = self.at[slot]
        same = self.keys[slot] == keys
        found = np.where(same, at, -1)
        left = np.flatnonzero(~same & (at >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (1 << self.bits) - 1
            at = self.at[slot]
            same = (self.keys[slot] == keys[left]) & (at >= 0)
            found[left[same]] = at[same]
            on = ~same & (at >= 0)
            left, slot = left[on], slot[on]
        return found
