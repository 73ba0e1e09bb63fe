"""A minimal perfect hash over distinct 64-bit keys, built and probed with numpy.

Keys are placed level by level: at each level every remaining key picks a bit, and keys alone on their bit stay there;
the rest go to the next level. A key's index is the rank of its bit, so n keys use exactly the indexes 0 to n-1.
"""

from __future__ import annotations

import numpy as np

GAMMA = 1.6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The splitmix64 finaliser over key + seed step."""
    with np.errstate(over="ignore"):
        z = keys + _ODD * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits = sizes, bits
        ones = [np.concatenate(([0], np.cumsum(b))) for b in bits]
        starts = np.cumsum([0] + [int(o[-1]) for o in ones])
        self.ranks = [(o[:-1] + s).astype(np.int64) for o, s in zip(ones, starts, strict=False)]

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        keys, sizes, bits, level = keys.astype(np.uint64), [], [], 0
        if len(np.unique(keys)) < len(keys):
            raise ValueError("repeated keys have no perfect hash")
        while len(keys):
            size = max(1, int(len(keys) * GAMMA))
            at = (mix(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys, level = keys[~alone[at]], level + 1
        return cls(sizes, bits)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index; keys that were not built in get any index or -1, so the caller confirms by fingerprint."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks, strict=True)):
            at = (mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], "<i8").tobytes()
        return head + b"".join(np.packbits(b).tobytes() for b in self.bits)

    @classmethod
    def from_bytes(cls, data: bytes) -> "PerfectHash":
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = [int(x) for x in np.frombuffer(data, "<i8", n, 8)]
        at, bits = 8 * (n + 1), []
        for size in sizes:
            width = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(sizes, bits)
