"""Minimal perfect hash functions over sets of 64-bit keys.

A function is a series of bitmaps. On level l a key asks for one bit, by a hash seeded with l; bits that just one of the
keys asked for are set and these keys are done, the others go on to the next level. A key's index is the number of set
bits before its own, over all levels: 0 to n - 1, each once, in about three bits a key.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bits of a level for each key that reaches it.
GAMMA = 1.5
#: Keys that are left after so many levels are listed.
LEVELS = 40


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key (int64 or uint64), another one for each seed."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """The function of some distinct keys. Of any other key it gives an index that means nothing, or -1: callers verify."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest  # bitmaps of 64-bit words; sorted keys
        self.ranks, before = [], 0
        for words in levels:
            set_bits = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(before + np.cumsum(set_bits) - set_bits)
            before += int(set_bits.sum())
        self.in_levels = before
        self.n = before + len(rest)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < LEVELS:
            n_words = max(1, int(len(keys) * GAMMA) + 63 >> 6)
            at = (mixed(keys, len(levels)) % np.uint64(64 * n_words)).astype(np.int64)
            alone = np.bincount(at, minlength=64 * n_words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = mixed(keys[left], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word] >> bit & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[held]] = (ranks[word] + np.bitwise_count(below))[held]
            left = left[~held]
        if len(left) and len(self.rest):
            place = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            found = self.rest[place] == keys[left]
            out[left[found]] = self.in_levels + place[found]
        return out

    def to_bytes(self) -> bytes:
        """Little-endian: the number of levels, each level's words, the number of listed keys; then all of them."""
        head = struct.pack(f"<I{len(self.levels)}II", len(self.levels), *map(len, self.levels), len(self.rest))
        return head + b"".join(x.astype("<u8").tobytes() for x in self.levels) + self.rest.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", data)
        *sizes, n_rest = struct.unpack_from(f"<{n}II", data, 4)
        at, levels = 8 + 4 * n, []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        return cls(levels, np.frombuffer(data, "<i8", n_rest, at))
