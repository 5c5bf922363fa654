"""A minimal perfect hash over 128-bit keys, with a fingerprint and a count per key.

Keys go to positions of ever smaller bit arrays, level by level: a key whose
position no other key of its level takes is settled there, the others go on to
the next level. The rank of a key's bit among all set bits is its index, so n
keys fill arrays of exactly n entries: one 32-bit fingerprint and one count.
Everything works on whole arrays of keys.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA = 2  # positions per key and level
LEVELS = 48
COUNT_MAX = np.iinfo(np.uint32).max


def _position(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1 + h2 * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
    return x % np.uint64(size)


def _fingerprint(h2: np.ndarray) -> np.ndarray:
    return (h2 >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    def __init__(self, sizes: list[int], bits: list[np.ndarray], rest: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray):
        self.sizes, self.bits, self.rest, self.fingerprints, self.counts = sizes, bits, rest, fingerprints, counts
        self._rank, base = [], 0
        for b in bits:
            ones = np.cumsum(b, dtype=np.int64)
            self._rank.append(ones + (base - 1))
            base += int(ones[-1]) if len(ones) else 0
        self._rest = {(int(a), int(b)): base + k for k, (a, b) in enumerate(rest)}

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> PerfectHash:
        """Over distinct keys (h1, h2)."""
        h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
        left = np.arange(len(h1))
        sizes, bits, settled = [], [], []
        while len(left) and len(sizes) < LEVELS:
            size = max(64, GAMMA * len(left))
            at = _position(h1[left], h2[left], len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            ok = alone[at]
            sizes.append(size)
            bits.append(alone)
            settled.append(left[ok][np.argsort(at[ok])])
            left = left[~ok]
        order = np.concatenate([*settled, left]).astype(np.int64) if len(h1) else np.zeros(0, np.int64)
        rest = np.stack([h1[left], h2[left]], axis=1) if len(left) else np.zeros((0, 2), np.uint64)
        return cls(sizes, bits, rest, _fingerprint(h2[order]), np.minimum(counts[order], COUNT_MAX).astype(np.uint32))

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for keys that can't be in the set."""
        h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _position(h1[left], h2[left], level, size).astype(np.int64)
            hit = self.bits[level][at]
            out[left[hit]] = self._rank[level][at[hit]]
            left = left[~hit]
        for k in left:
            out[k] = self._rest.get((int(h1[k]), int(h2[k])), -1)
        return out

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The count of each key; 0 where the fingerprint says that the key isn't in the set."""
        at = self.index(h1, h2)
        found = at >= 0
        found[found] = self.fingerprints[at[found]] == _fingerprint(h2.astype(np.uint64)[found])
        out = np.zeros(len(at), np.int64)
        out[found] = self.counts[at[found]]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<qq", len(self.sizes), len(self.rest)) + np.array(self.sizes, np.int64).tobytes() + struct.pack("<q", len(self.counts))
        return b"".join([head, *(np.packbits(b).tobytes() for b in self.bits), self.rest.tobytes(), self.fingerprints.tobytes(), self.counts.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        levels, n_rest = struct.unpack_from("<qq", data)
        sizes = np.frombuffer(data, np.int64, levels, 16).tolist()
        (n,) = struct.unpack_from("<q", data, at := 16 + 8 * levels)
        at += 8
        bits = []
        for size in sizes:
            packed = np.frombuffer(data, np.uint8, -(-size // 8), at)
            bits.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        rest = np.frombuffer(data, np.uint64, 2 * n_rest, at).reshape(-1, 2)
        at += rest.nbytes
        return cls(sizes, bits, rest, np.frombuffer(data, np.uint32, n, at), np.frombuffer(data, np.uint32, n, at + 4 * n))
