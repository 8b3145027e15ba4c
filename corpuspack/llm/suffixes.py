"""Sorting suffixes by hashes: common extensions by binary search over prefix polynomial hashes, inside a mergesort."""

from __future__ import annotations

import numpy as np

from corpuspack.llm.shingles import _BASE, _INVERSE, powers


class Suffixes:
    """Byte strings, one after another in ``data``; string i has ``length[i]`` bytes from ``start[i]``."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = data, start, length
        longest = int(length.max(initial=0)) + 1
        self.down = powers(_INVERSE, longest)
        up = powers(_BASE, longest)
        total = int(length.sum())
        self.base = np.concatenate(([0], np.cumsum(length)))[:-1]
        inside = np.arange(total) - np.repeat(self.base, length)
        taken = np.repeat(start, length) + inside
        self.bytes = data[taken]
        self.sums = np.zeros(total + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[inside], out=self.sums[1:])

    def head(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the first n bytes of strings i; each string counts its powers from its own start."""
        return self.sums[self.base[i] + n] - self.sums[self.base[i]]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of strings i and j, by binary search over hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.head(i, middle) == self.head(j, middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether string i sorts before string j, or equals it where ``or_equal``."""
        n = self.common(i, j)
        end_i, end_j = n == self.length[i], n == self.length[j]
        last = len(self.bytes) - 1
        byte_i = self.bytes[np.minimum(self.base[i] + n, last)]
        byte_j = self.bytes[np.minimum(self.base[j] + n, last)]
        return np.where(end_i, ~end_j | or_equal, ~end_j & (byte_i < byte_j))

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, common): strings sorted within their groups, and the common prefix of each with the one before it.

        ``group`` rises. Bottom-up mergesort of all groups at once: each string finds its rank in the run it is
        merged with by binary search. Common prefixes of neighbours are then verified on bytes.
        """
        n = len(group)
        edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if n else np.zeros(1, np.int64)
        size = np.diff(edge)
        first = np.repeat(edge[:-1], size)
        count = np.repeat(size, size)
        order = np.arange(n)
        width = 1
        while width < size.max(initial=0):
            place = np.arange(n) - first
            moving = np.flatnonzero(count > width)
            run = place[moving] // width
            left = run % 2 == 0
            other = first[moving] + (run ^ 1) * width
            low = np.zeros(len(moving), np.int64)
            high = np.clip(first[moving] + count[moving] - other, 0, width)
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                mine, theirs = order[moving[open_]], order[other[open_] + middle]
                # of equal strings, those of the left run come first
                earlier = self.before(theirs, mine, ~left[open_])
                low[open_] = np.where(earlier, middle + 1, low[open_])
                high[open_] = np.where(earlier, high[open_], middle)
            target = first[moving] + (run - run % 2) * width + place[moving] % width + low
            merged = order.copy()
            merged[target] = order[moving]
            order = merged
            width *= 2
        common = np.full(n, -1, np.int64)
        inner = np.flatnonzero(np.arange(n) > first)
        common[inner] = self.common(order[inner - 1], order[inner])
        for wrong in self.collisions(order, inner, common, first):
            lo = wrong
            hi = lo + count[lo]
            order[lo:hi] = sorted(order[lo:hi], key=self.text)
            for at in range(lo + 1, hi):
                one, two = self.text(order[at - 1]), self.text(order[at])
                common[at] = next((x for x, (p, q) in enumerate(zip(one, two)) if p != q), min(len(one), len(two)))
        return order, common

    def text(self, i: int) -> bytes:
        return self.bytes[self.base[i] : self.base[i] + self.length[i]].tobytes()

    def collisions(self, order, inner, common, first) -> np.ndarray:
        """First places of groups in which neighbours' hashes agree where their bytes don't, or the order is wrong."""
        if not len(inner):
            return inner
        n = common[inner]
        i, j = order[inner - 1], order[inner]
        own = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = self.bytes[np.repeat(self.base[i], n) + own] != self.bytes[np.repeat(self.base[j], n) + own]
        bad = np.bincount(np.repeat(np.arange(len(inner)), n)[differs], minlength=len(inner)) > 0
        bad |= ~self.before(i, j, np.ones(len(i), bool))
        return np.unique(first[inner[bad]])
