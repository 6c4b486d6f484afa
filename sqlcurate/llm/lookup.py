"""A read-only numpy hash table from 64-bit keys to row numbers, and bitmaps, for lookups of whole blocks at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def bits_at(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each place of a bitmap is set, lowest bit of a byte first; the bitmap stays packed."""
    return (packed[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


class Lookup:
    """Open addressing by the high bits of keys that are hashes already; half of the slots stay empty.

    Broadcast the keys and make the table in the task: it takes several times their room.
    """

    def __init__(self, keys: np.ndarray):
        keys = keys.view(U64)
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift = U64(64 - bits)
        home = (keys >> self.shift).astype(np.int64)
        order = np.argsort(home, kind="stable")
        step = np.arange(len(keys))
        slot = np.maximum.accumulate(home[order] - step) + step if len(keys) else home  # next free slot at or after home
        self.keys = np.zeros((1 << bits) + len(keys) + 1, U64)
        self.rows = np.full(len(self.keys), -1, np.int32)
        self.keys[slot], self.rows[slot] = keys[order], order

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        keys = keys.view(U64)
        out = np.full(len(keys), -1, np.int32)
        todo, slot = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(todo):
            row = self.rows[slot]
            same = (self.keys[slot] == keys[todo]) & (row >= 0)
            out[todo[same]] = row[same]
            on = (row >= 0) & ~same
            todo, slot = todo[on], slot[on] + 1
        return out
