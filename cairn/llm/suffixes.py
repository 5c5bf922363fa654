"""Sorting suffixes by hashes: prefix polynomial hashes, binary search, mergesort.

``PrefixHashes`` gives the hash of any substring in constant time, so the longest
common extension of two suffixes takes a binary search, and comparing them takes
one more byte. ``sort`` is a bottom-up mergesort whose merges run for all pairs of
runs at once: an element's place is its place in its own run plus the number of
elements of the other run before it, found by binary search. Neighbours'
extensions are checked against the bytes; on a collision the caller falls back.

Hashes are polynomials modulo 2**64 with an odd base, so one prefix array serves
substrings at any place by the inverse powers of the base.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((BASE, INVERSE)):
            _powers[k] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PrefixHashes:
    def __init__(self, data: np.ndarray):
        """Of bytes."""
        power, self._inverse = _tables(len(data) + 1)
        self.data = data
        self._sums = np.empty(len(data) + 1, np.uint64)
        self._sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self._sums[1:])

    def every(self, length: int) -> np.ndarray:
        """The hashes of all substrings of a length."""
        n = len(self.data) - length + 1
        return (self._sums[length:] - self._sums[:n]) * self._inverse[:n]

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self._sums[start + length] - self._sums[start]) * self._inverse[start]

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes, up to ``most``, the suffixes at a and b have in common: binary search over hashes."""
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            middle = (lo + hi + 1) >> 1
            same = self.of(a, middle) == self.of(b, middle)
            lo, hi = np.where(same, middle, lo), np.where(same, hi, middle - 1)
        return lo


class SuffixSort:
    """The order of suffixes (start, length) and the extension of each with the one before it."""

    def __init__(self, hashes: PrefixHashes, start: np.ndarray, length: np.ndarray):
        self.hashes, self.start, self.length = hashes, start, length
        self.order = self._sort()
        a, b = self.order[:-1], self.order[1:]
        self.extension = np.r_[np.zeros(min(1, len(start)), np.int64), self._extension(a, b)] if len(start) else np.zeros(0, np.int64)

    def _extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.hashes.extension(self.start[a], self.start[b], np.minimum(self.length[a], self.length[b]))

    def _before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b; equal ones go by number."""
        n = self._extension(a, b)
        ends_a, ends_b = n == self.length[a], n == self.length[b]
        last = len(self.hashes.data) - 1
        next_a = self.hashes.data[np.minimum(self.start[a] + n, last)]
        next_b = self.hashes.data[np.minimum(self.start[b] + n, last)]
        return np.where(ends_a | ends_b, np.where(ends_a & ends_b, a < b, ends_a), next_a < next_b)

    def _sort(self) -> np.ndarray:
        n, width = len(self.start), 1
        order = np.arange(n)
        while width < n:
            place = np.arange(n)
            run = place // width
            own = place - run * width
            other = np.minimum((run ^ 1) * width, n)
            size = np.minimum(other + width, n) - other
            lo, hi = np.zeros(n, np.int64), size.copy()
            while True:  # how many of the other run come before each element
                live = np.flatnonzero(lo < hi)
                if not len(live):
                    break
                middle = (lo[live] + hi[live]) >> 1
                before = self._before(order[other[live] + middle], order[live])
                lo[live] = np.where(before, middle + 1, lo[live])
                hi[live] = np.where(before, hi[live], middle)
            merged = np.empty_like(order)
            merged[(run // 2) * 2 * width + own + lo] = order
            order, width = merged, 2 * width
        return order

    def verified(self) -> bool:
        """Whether neighbours have as many bytes in common as their hashes say, and differ after them."""
        data, last = self.hashes.data, len(self.hashes.data) - 1
        a, b, n = self.start[self.order[:-1]], self.start[self.order[1:]], self.extension[1:]
        for k in range(0, len(n), 512):
            part = slice(k, k + 512)
            at = np.arange(int(n[part].sum())) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            if (data[np.repeat(a[part], n[part]) + at] != data[np.repeat(b[part], n[part]) + at]).any():
                return False
        open_end = n < np.minimum(self.length[self.order[:-1]], self.length[self.order[1:]])
        return not (open_end & (data[np.minimum(a + n, last)] == data[np.minimum(b + n, last)])).any()
