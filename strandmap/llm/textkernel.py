"""Vectorised hashing of words and shingles over the byte buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; A-Z have those of a-z.
BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
STEP = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the rolling base and of its inverse, as many as the longest chunk so far asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (BASE, INVERSE))
        return self.up[:n], self.down


POWERS = Powers()


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    col = pc.fill_null(col, "") if col.null_count else col
    wide = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``size`` bytes (one document at least): first, end, bytes, offsets."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r"""Hash of every word (run of other than ``[\x20\x09-\x0D]``, A-Z lower-cased) and the words of each document."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs) - 1, np.int64)
    blank = BLANK[data]
    before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
    before[1:] = blank
    after[:n] = blank
    before[offs] = True
    after[offs] = True
    solid = ~blank
    first = np.flatnonzero(solid & before[:n])
    end = np.flatnonzero(solid & after[1:]) + 1
    up, down = POWERS.upto(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * up, out=total[1:])
    return mix((total[end] - total[first]) * down[first]), np.diff(np.searchsorted(first, offs))


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each document, its distinct shingle hashes in ascending order."""
    h, count = words(data, offs)
    n_docs = len(count)
    start = np.concatenate([[0], np.cumsum(count)])
    full = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        full += h[j : j + len(full)] * STEP[j]
    full = mix(full)
    out = []
    for d in range(n_docs):
        a, c = start[d], count[d]
        if c >= size:
            out.append(np.unique(full[a : a + c - size + 1]))
        elif c:
            out.append(mix((h[a : a + c] * STEP[:c]).sum(dtype=np.uint64, keepdims=True) + STEP[8 + c]))
        else:
            out.append(full[:0])
    return out
