"""Cuts texts into the pieces of a byte-level BPE's pre-tokenizer, for whole batches at a time.

The rule (fixed): contractions ('s 't 're 've 'm 'll 'd), then runs of letters, of numbers or of other signs, each with
one space before it if there is one, then white space, whose last character stands apart before anything else.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

from .textkernel import POWERS, mix

LETTER, NUMBER, SIGN, BLANK = range(4)
#: White_Space beyond ASCII; fixed values.
SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every code point, and two random values for each."""
    kinds = {"L": LETTER, "N": NUMBER}
    kind = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], SIGN) for c in range(sys.maxunicode + 1)), np.int8)
    kind[[*range(9, 14), 32, *SPACES]] = BLANK
    rng = np.random.default_rng(11)
    return kind, rng.integers(1, 2**64 - 1, len(kind), dtype=np.uint64), rng.integers(1, 2**64 - 1, len(kind), dtype=np.uint64)


def cut(points: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of all pieces of the texts that lie one after the other in ``points``."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = tables()[0][points]
    first = np.zeros(n + 1, bool)  # of a text
    first[offs] = True
    blank = kind == BLANK
    edge = first[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    # White space before something else in its text: its last character is a piece, or joins what follows if it is a space.
    ahead = np.zeros(n, bool)
    ahead[:-1] = blank[:-1] & ~blank[1:] & ~first[1:n]
    edge |= ahead
    joins = np.flatnonzero(ahead & (points == 32)) + 1
    edge[joins] = False
    # An apostrophe that begins a piece and stands alone among signs may open a contraction.
    quotes = np.flatnonzero((points == 39) & edge[:n])
    if len(quotes):
        at = lambda k: np.where(quotes + k < n, points[np.minimum(quotes + k, n - 1)], 0)
        inside = lambda k: (quotes + k < n) & ~first[np.minimum(quotes + k, n)]
        a, b = at(1), at(2)
        one = inside(1) & np.isin(a, [ord(c) for c in "stmd"])
        two = inside(1) & inside(2) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for q, size in ((quotes[one], 2), (quotes[two & ~one], 3)):
            edge[q + 1] = False
            after = q + size
            after = after[after < n]
            # What is left of the letters begins a piece; a space joined to the next run stays where it is.
            edge[after[kind[after] == LETTER]] = True
    return np.flatnonzero(edge)


def hashes(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each piece."""
    _, one, two = tables()
    n = len(points)
    up, down = POWERS.upto(n)
    ends = np.append(starts[1:], n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(one[points] * up, out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts])
    np.cumsum(two[points], out=total[1:])
    return h, total[ends] - total[starts]


class Table:
    """Open addressing over 64-bit hashes: numbers pieces in the order they are added."""

    def __init__(self, bits: int = 19):
        self.mask = (1 << bits) - 1
        self.key, self.check, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.size = 0

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if it isn't there."""
        out = np.full(len(h), -1, np.int32)
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        num = self.number[slot]
        hit = (num >= 0) & (self.key[slot] == h) & (self.check[slot] == check)
        out[hit] = num[hit]
        todo = np.flatnonzero((num >= 0) & ~hit)
        step = 1
        while len(todo):
            s = (slot[todo] + step) & self.mask
            num = self.number[s]
            hit = (num >= 0) & (self.key[s] == h[todo]) & (self.check[s] == check[todo])
            out[todo[hit]] = num[hit]
            todo = todo[(num >= 0) & ~hit]
            step += 1
        return out

    def add(self, h: np.ndarray, check: np.ndarray) -> None:
        """Adds distinct pieces that aren't there yet."""
        slot, todo = (h & np.uint64(self.mask)).astype(np.int64), np.arange(len(h))
        while len(todo):
            s = slot[todo]
            free = np.flatnonzero(self.number[s] < 0)
            _, winner = np.unique(s[free], return_index=True)
            won = free[winner]
            at, who = s[won], todo[won]
            self.key[at], self.check[at], self.number[at] = h[who], check[who], self.size + who
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo = todo[rest]
            slot[todo] = (slot[todo] + 1) & self.mask
        self.size += len(h)
