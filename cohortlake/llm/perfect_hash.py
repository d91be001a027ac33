"""Minimal perfect hash over 64-bit keys: levels of bit arrays and a rank.

Level by level every key that is left hashes to a place in a bit array; places hit
by exactly one key are set and their keys done, the others go on to the next level.
The number of set bits before a key's place, over all levels, is its slot: slots run
from 0 to the number of keys without a gap. A lookup reads one bit for each level it
passes, fewer than two on average, whatever the number of keys.
"""

from __future__ import annotations

import struct

import numpy as np

from cohortlake.llm.textarrays import mix

GAMMA = 2
_HEAD = "<4sII"
_HEAD_BYTES = struct.calcsize(_HEAD)
_MAGIC = b"MPH1"


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys, 1000 + level) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """32 bits of a key, stored at its slot to tell other keys."""
    return (mix(keys, 7) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Built from distinct unsigned 64-bit keys, or read from its bytes."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.bits = np.concatenate(levels) if levels else np.zeros(0, dtype=bool)
        self.starts = np.cumsum([0, *[len(level) for level in levels]])
        self.ranks = np.zeros(len(self.bits) + 1, dtype=np.int64)
        np.cumsum(self.bits, out=self.ranks[1:])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left = keys.astype(np.uint64)
        levels: list[np.ndarray] = []
        while len(left):
            size = max(64, GAMMA * len(left))
            places = _places(left, len(levels), size)
            alone = np.bincount(places, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[places]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a key the hash was not built from may get any slot or -1."""
        keys = keys.astype(np.uint64)
        found = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for number, level in enumerate(self.levels):
            places = _places(keys[left], number, len(level))
            hit = level[places]
            found[left[hit]] = self.ranks[self.starts[number] + places[hit]]
            left = left[~hit]
        return found

    def to_bytes(self) -> bytes:
        sizes = np.array([len(level) for level in self.levels], dtype="<u8").tobytes()
        packed = b"".join(np.packbits(level, bitorder="little").tobytes() for level in self.levels)
        return struct.pack(_HEAD, _MAGIC, len(self.levels), len(packed)) + sizes + packed

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The hash at the start of ``raw`` and where it ends."""
        magic, count, length = struct.unpack_from(_HEAD, raw)
        if magic != _MAGIC:
            raise ValueError("not a perfect hash")
        sizes = np.frombuffer(raw, dtype="<u8", count=count, offset=_HEAD_BYTES)
        at = _HEAD_BYTES + 8 * count
        levels = []
        for size in sizes.tolist():
            width = -(-size // 8)
            packed = np.frombuffer(raw, dtype=np.uint8, count=width, offset=at)
            levels.append(np.unpackbits(packed, count=size, bitorder="little").astype(bool))
            at += width
        return cls(levels), _HEAD_BYTES + 8 * count + length
