"""A table of the distinct chunks that a task's worker has met: 64-bit chunk hash -> byte strings, kept flat in numpy.

Open addressing with linear probing; lookups and insertions take whole arrays. A worker keeps its table from task to task.
At `limit` entries it is emptied and grows anew, so its memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import common as c


class ChunkTable:
    def __init__(self, payloads: int, limit: int = 1_000_000):
        self.payloads, self.limit = payloads, limit
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.keys = np.zeros(1 << 15, np.uint64)
        self.slots = np.full(1 << 16, -1, np.int32)
        self.used = [0] * self.payloads
        self.bytes = [np.zeros(1 << 18, np.uint8) for _ in range(self.payloads)]
        self.at = [np.zeros((1 << 15) + 1, np.int64) for _ in range(self.payloads)]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        mask = len(self.slots) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        out = self.slots[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[np.maximum(out, 0)] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            found = self.slots[slot[open_]]
            out[open_] = found
            open_ = open_[(found >= 0) & (self.keys[np.maximum(found, 0)] != hashes[open_])]
        return out

    def add(self, hashes: np.ndarray, *payloads: list[bytes]) -> None:
        """Distinct hashes that are not in the table."""
        m = len(hashes)
        while self.n + m > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
            self.at = [np.concatenate([x, np.zeros(len(x) - 1, np.int64)]) for x in self.at]
        self.keys[self.n : self.n + m] = hashes
        for k, parts in enumerate(payloads):
            ends = self.used[k] + np.cumsum(np.fromiter(map(len, parts), np.int64, m))
            total = int(ends[-1]) if m else self.used[k]
            while total > len(self.bytes[k]):
                self.bytes[k] = np.concatenate([self.bytes[k], np.zeros_like(self.bytes[k])])
            self.bytes[k][self.used[k] : total] = np.frombuffer(b"".join(parts), np.uint8)
            self.at[k][self.n + 1 : self.n + m + 1] = ends
            self.used[k] = total
        new = np.arange(self.n, self.n + m)
        self.n += m
        if 2 * self.n > len(self.slots):
            size = len(self.slots)
            while 2 * self.n > size:
                size *= 2
            self.slots = np.full(size, -1, np.int32)
            new = np.arange(self.n)
        mask = len(self.slots) - 1
        slot = (self.keys[new] & np.uint64(mask)).astype(np.int64)
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]  # of several for a slot the last stays
            lost = self.slots[slot] != new
            new, slot = new[lost], (slot[lost] + 1) & mask

    def entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, make: Callable[[list[bytes]], tuple]) -> np.ndarray:
        """The entry of each chunk data[start:end]; the distinct new ones are given to `make` once."""
        if self.n > self.limit:
            self.clear()
        out = self.find(hashes)
        lack = np.flatnonzero(out < 0)
        if len(lack):
            fresh, first = np.unique(hashes[lack], return_index=True)
            own = lack[first]
            raw = data.tobytes()
            self.add(fresh, *make([raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]))
            out[lack] = self.find(hashes[lack])
        return out

    def lengths(self, k: int, entries: np.ndarray) -> np.ndarray:
        return self.at[k][entries + 1] - self.at[k][entries]

    def gather(self, k: int, entries: np.ndarray) -> np.ndarray:
        """The payload bytes of the entries, end to end."""
        return self.bytes[k][c.runs(self.at[k][entries], self.lengths(k, entries))]


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """One object for each key in a worker process."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]
