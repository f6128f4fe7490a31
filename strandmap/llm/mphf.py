"""A minimal perfect hash of 64-bit keys: levels of bit arrays, each taking the keys that meet no other there."""

from __future__ import annotations

import numpy as np

from .textkernel import mix

GAMMA, MAX_LEVELS = 2.0, 64
SALT = np.uint64(0x2545F4914F6CDD1D)


def _slot(keys: np.ndarray, level: int, m: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys.view(np.uint64) ^ mix(np.full(1, level + 1, np.uint64) * SALT)) % np.uint64(m)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(mix(keys.view(np.uint64) + SALT)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Maps n distinct keys one to one to 0..n-1; other keys to -1 or to any slot (so slots carry fingerprints)."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, planes = np.asarray(keys, np.int64), [], []
        while len(left):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            m = int(np.ceil(GAMMA * len(left) / 64)) * 64
            at = _slot(left, len(sizes), m)
            alone = np.bincount(at, minlength=m) == 1
            planes.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(m)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(planes) if planes else np.zeros(0, np.uint64))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.int64)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(todo):
                break
            at = self.bases[level] + _slot(keys[todo], level, int(m))
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            w = self.bits[word]
            hit = (w >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(w & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.ranks[word] + below)[hit]
            todo = todo[~hit]
        return out
