"""Matching blocks of many pairs of lines at once: the longest common block of each pair, then the same left and right of it.

Of equally long blocks the one that begins first in the first line counts, then the one that begins first in the second. A round takes all
ranges of all lines together: the longest length is found by halving, with hashes of windows that are looked up by range, so a
round costs its letters times the logarithm of their length, whatever the length of a line.

Short blocks are found by length instead, the longest first: in a range without a longer one, the blocks of a length are those that one walk from
left to right meets. A length asks only windows whose beginnings the other line has as well.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

U = np.uint64
# fixed values: an odd base and its inverse modulo 2^64, and a multiplier that spreads the numbers of ranges
BASE, INVERSE, SPREAD = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), 0xBF58476D1CE4E5B9


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * U(pow(base, k, 1 << 64))
        k *= 2
    return out


class Letters:
    """The letters of several lines end to end, with prefix sums for the hashes of their windows."""

    def __init__(self, lines: list[str]):
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
        self.letters = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.letters)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((self.letters.astype(U) + U(1)) * _powers(BASE, n), out=self.sums[1:])
        self.inverse = _powers(INVERSE, n + 1)

    def windows(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.inverse[at]


def _runs(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum()), dtype=np.int64) + np.repeat(low - (np.cumsum(n) - n), n)


def _keys(own: Letters, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, range and key (of its range and letters) of every window of a range's size inside it."""
    n = np.maximum(high - low - size + 1, 0)
    who = np.repeat(np.arange(len(low)), n)
    at = _runs(low, n)
    return at, who, _key(own, at, size[who], who)


def _key(own: Letters, at: np.ndarray, size: np.ndarray | int, who: np.ndarray) -> np.ndarray:
    return (own.windows(at, size) + who.astype(U)) * U(SPREAD) ^ (who.astype(U) << U(20))


def _maybe(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which keys may be among the others, by a table of their first bits: none of those that are is missed."""
    bits = U(64 - max(12, min(22, int(4 * len(others)).bit_length())))
    seen = np.zeros(1 << (64 - int(bits)), bool)
    seen[others >> bits] = True
    return seen[keys >> bits]


def _shared(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which keys are among the others."""
    if not len(keys) or not len(others):
        return np.zeros(len(keys), bool)
    # a table of bits by the keys' first ones leaves few to sort
    bits = 64 - max(12, min(22, int(4 * len(others)).bit_length()))
    seen = np.zeros(1 << (64 - bits), bool)
    seen[others >> U(bits)] = True
    maybe = np.flatnonzero(seen[keys >> U(bits)])
    asked = np.zeros(len(seen), bool)
    asked[keys[maybe] >> U(bits)] = True
    table = np.sort(others[asked[others >> U(bits)]])
    out = np.zeros(len(keys), bool)
    if len(maybe):
        own = keys[maybe]
        out[maybe] = table[np.minimum(np.searchsorted(table, own), len(table) - 1)] == own
    return out


def blocks(first: list[str], second: list[str], short: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """line, begin in the first, begin in the second, length of all matching blocks, in no order. short: blocks of at most so many letters are found
    by length."""
    a, b = Letters(first), Letters(second)
    line = np.arange(len(first))
    beginnings, longer = _beginnings(a, b, short) if short else ([], line)
    ranges = np.stack([line, a.at[:-1], a.at[1:], b.at[:-1], b.at[1:], np.diff(a.at)])[:, longer]  # no block is longer than the one beside it
    found = _rounds(a, b, ranges, short)
    if short:
        found += _by_length(a, b, np.concatenate([np.zeros((4, 0), np.int64), *found], 1), beginnings)
    empty = np.zeros((4, 0), np.int64)
    line, i, j, size = np.concatenate([empty, *found], 1)
    return line, i - a.at[line], j - b.at[line], size


def _rounds(a: Letters, b: Letters, ranges: np.ndarray, short: int) -> list[np.ndarray]:
    """Blocks of more than `short` letters: line, places among the letters of all lines, length."""
    found = []
    while ranges.shape[1]:
        line, alo, ahi, blo, bhi, most = ranges
        low, high = np.full(len(line), short, np.int64), np.minimum(np.minimum(ahi - alo, bhi - blo), most)
        while len(open_ := np.flatnonzero(low < high)):
            # most ranges have none
            middle = np.where((low[open_] == short) & (short > 0), short + 1, (low[open_] + high[open_] + 1) // 2)
            _, who, keys = _keys(a, alo[open_], ahi[open_], middle)
            _, _, others = _keys(b, blo[open_], bhi[open_], middle)
            hit = np.zeros(len(open_), bool)
            hit[who[_shared(keys, others)]] = True
            low[open_[hit]] = middle[hit]
            high[open_[~hit]] = middle[~hit] - 1
        own = np.flatnonzero(low > short)
        if not len(own):
            break
        line, alo, ahi, blo, bhi, _ = ranges[:, own]
        size = low[own]
        at, who, keys = _keys(a, alo, ahi, size)
        there, whose, others = _keys(b, blo, bhi, size)
        hit = np.flatnonzero(_shared(keys, others))
        _, one = np.unique(who[hit], return_index=True)  # of each range the first
        i, key = at[hit][one], keys[hit][one]
        same = np.flatnonzero(others == key[whose])
        _, one = np.unique(whose[same], return_index=True)
        j = there[same][one]
        found.append(np.stack([line, i, j, size]))
        sides = [np.stack([line, alo, i, blo, j, size]), np.stack([line, i + size, ahi, j + size, bhi, size])]
        ranges = np.concatenate(sides, 1)
        ranges = ranges[:, (ranges[1] < ranges[2]) & (ranges[3] < ranges[4])]
    return found


FIRST = 4  # windows of fewer letters are nearly all in the other line


def _beginnings(a: Letters, b: Letters, short: int) -> tuple[list[tuple[int, list[np.ndarray]]], np.ndarray]:
    """Lengths up to `short` with the places in both where windows of them begin that the other line may have, and the lines that may have longer ones. Windows of a length
    are asked only where those of the length before were found."""
    lines = [np.repeat(np.arange(len(x.at) - 1), np.diff(x.at)) for x in (a, b)]
    at = [np.arange(len(x.letters)) for x in (a, b)]
    out = [(size, at) for size in range(1, min(FIRST, short + 1))]
    for size in range(min(FIRST, short + 1), short + 2):
        at = [x[x + size <= own.at[who[x] + 1]] for own, who, x in zip((a, b), lines, at, strict=True)]
        keys, others = (_key(own, x, size, who[x]) for own, who, x in zip((a, b), lines, at, strict=True))
        at = [at[0][_maybe(keys, others)], at[1][_maybe(others, keys)]]
        if size <= short:
            out.append((size, at))
        if not len(at[0]) or not len(at[1]):
            return out, np.zeros(0, np.int64)
    return out, np.unique(lines[0][at[0]])


def _by_length(a: Letters, b: Letters, known: np.ndarray, beginnings: list[tuple[int, list[np.ndarray]]]) -> list[np.ndarray]:
    """Blocks of the lengths of `beginnings`, beside the known ones, longer ones. A letter's range is the number of lines and blocks that begin at
    it or before, which is the same in both lines; letters of blocks are taken."""
    both, ranges, free = (a, b), [], []
    for own in both:
        begins = np.zeros(len(own.letters) + 1, np.int32)
        np.add.at(begins, own.at[:-1], 1)
        ranges.append(begins)
        free.append(np.ones(len(own.letters), bool))
    found = []

    def take(line: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> None:
        for begins, open_, x in zip(ranges, free, (i, j), strict=True):
            begins[x] += 1
            open_[_runs(x, size)] = False

    take(*known)
    who: list[np.ndarray] = []
    for size, at in reversed(beginnings):
        who = who or [np.cumsum(begins[:-1]) for begins in ranges]
        # a window whose ends are free and in one range is so as a whole
        own = [x[open_[x]] for x, open_ in zip(at, free, strict=True)]
        own = [x[x + size <= len(open_)] for x, open_ in zip(own, free, strict=True)]
        own = [x[open_[x + size - 1] & (w[x] == w[x + size - 1])] for x, open_, w in zip(own, free, who, strict=True)]
        keys, others = (_key(letters, x, size, w[x]) for letters, x, w in zip(both, own, who, strict=True))
        one, two = _maybe(keys, others), _maybe(others, keys)
        own, keys, others = [own[0][one], own[1][two]], keys[one], others[two]
        order = np.argsort(others, kind="stable")
        others, there = others[order], own[1][order].tolist()
        low = np.searchsorted(others, keys)
        hit = np.flatnonzero(low < np.searchsorted(others, keys, "right"))
        if not len(hit):
            continue
        here, low, high = own[0][hit], low[hit], np.searchsorted(others, keys[hit], "right")
        i, j, now, past, beyond = [], [], -1, 0, 0
        for x, w, s, e in zip(here.tolist(), who[0][here].tolist(), low.tolist(), high.tolist(), strict=True):
            if w != now:
                now = w
            elif x < past:
                continue
            elif there[s] < beyond:
                s = bisect_left(there, beyond, s, e)
                if s == e:
                    continue
            i.append(x)
            j.append(there[s])
            past, beyond = x + size, there[s] + size
        i, j = np.array(i), np.array(j)
        line = np.searchsorted(a.at, i, "right") - 1
        found.append(np.stack([line, i, j, np.full(len(i), size)]))
        take(*found[-1])
        who = []
    return found
