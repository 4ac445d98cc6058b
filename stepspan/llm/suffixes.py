"""Suffix sort of short strings by hashes: numpy, for the strings that Spark brings together in one task."""

from __future__ import annotations

import numpy as np


class HashedStrings:
    """Rows of equal length, compared by polynomial hashes of their prefixes (modulo 2^64, each byte a random odd value)."""

    def __init__(self, rows: np.ndarray, seed: int = 0) -> None:
        random = np.random.default_rng(seed)
        n, self.length = rows.shape
        self.rows = rows
        value = random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = np.uint64(int(random.integers(0, 2**62)) * 4 + 3)
        self.prefix = np.zeros((self.length + 1, n), np.uint64)
        for j in range(self.length):
            self.prefix[j + 1] = self.prefix[j] * base + value[rows[:, j]]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of rows a and b, by binary search over lengths."""
        low = np.zeros(len(a), np.int64)
        high = np.full(len(a), self.length, np.int64)
        for _ in range(self.length.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.prefix[middle, a] == self.prefix[middle, b]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether row a comes before row b; ties where they are equal."""
        at = self.common(a, b)
        end = at == self.length
        at = np.minimum(at, self.length - 1)
        return np.where(end, ties, self.rows[a, at] < self.rows[b, at])


def _merge_sorted(s: HashedStrings, group: np.ndarray) -> np.ndarray:
    """Order of the rows by (group, row): bottom-up mergesort of all groups at once; each row finds its rank in the neighbouring
    run by binary search."""
    n = len(group)
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), g[1:] != g[:-1])))
    size = np.diff(np.append(first, n))
    start, size = np.repeat(first, size), np.repeat(size, size)
    place = np.arange(n) - start
    width, most = 1, int(size.max(initial=0))
    while width < most:
        run = place // width
        left = (run & 1) == 0
        low = np.where(left, (run + 1) * width, (run - 1) * width)
        act = np.flatnonzero((low < size) & (size > width))
        base, is_left = start[act], left[act]
        lo = base + low[act]
        hi = base + np.minimum(low[act] + width, size[act])
        sibling = lo.copy()
        mine = order[act]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            # a left row stands before equal rows of the right run, a right row after equal rows of the left run
            less = s.before(order[mid], mine[open_], ~is_left[open_])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        pair = base + (run[act] // 2) * 2 * width
        own = place[act] - run[act] * width
        to = pair + own + (lo - sibling)
        moved = order.copy()
        moved[to] = mine
        order = moved
        width *= 2
    return order


def sorted_with_common(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by group and row, length of the prefix each shares with the one before it, -1 at the start of a group).

    All neighbours are compared byte by byte afterwards; if a hash collision has led to a wrong order or length, another base
    is taken.
    """
    n, length = rows.shape
    for seed in range(100):
        s = HashedStrings(rows, seed)
        order = _merge_sorted(s, group)
        a, b = order[:-1], order[1:]
        hashed = s.common(a, b)
        differ = rows[a] != rows[b]
        some = differ.any(1)
        true = np.where(some, differ.argmax(1), length)
        at = np.minimum(true, length - 1)
        inside = group[a] == group[b]
        if (inside & ((hashed != true) | (some & (rows[a, at] > rows[b, at])))).any():
            continue
        return order, np.concatenate((np.full(min(n, 1), -1), np.where(inside, true, -1)))
    raise ValueError("no base tells the strings apart")
