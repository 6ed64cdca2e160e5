"""A minimal perfect hash of a block of keys, with a fingerprint for each.

Keys are given as pairs of 64-bit hashes. In each level every key left takes a place in a bit
array of as many places as there are keys; those alone at theirs set its bit and are done, the
others go on to the next level. The slot of a key is the number of bits set before its own, so
the slots are 0 to n - 1 without a gap, at about three bits a key. A lookup tries the levels in
turn: 1.6 on average, whatever n is. A key that the block does not hold ends in some slot or in
none; the fingerprint stored for the slot tells it from the true one but for one in 2^32.
"""

from __future__ import annotations

import numpy as np

NONE = -1


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1 + h2 * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def fingerprints(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return ((h1 ^ (h2 >> np.uint64(7))) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        before = np.cumsum([0] + [int(bits.sum()) for bits in levels])
        self.size = int(before[-1])
        self.ranks = [b + np.cumsum(bits) - bits for b, bits in zip(before, levels)]

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        """Of distinct keys. Two keys of one pair of hashes are an error; that is as likely as
        equal hashes of 128 bits."""
        levels, left = [], np.arange(len(h1))
        while len(left):
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
            at = _places(h1[left], h2[left], len(levels), len(left))
            alone = np.bincount(at, minlength=len(left)) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key, or NONE where no level has it."""
        out, left = np.full(len(h1), NONE, np.int64), np.arange(len(h1))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            at = _places(h1[left], h2[left], level, len(bits))
            out[left[bits[at]]] = ranks[at[bits[at]]]
            left = left[~bits[at]]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4")
        return sizes.tobytes() + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        count = int(np.frombuffer(data, "<u4", 1)[0])
        at, levels = 4 * (count + 1), []
        for size in np.frombuffer(data, "<u4", count, 4).tolist():
            length = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, length, at), count=size).astype(bool))
            at += length
        return cls(levels)
