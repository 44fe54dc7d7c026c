"""Run-length index of a set of byte strings: Burrows-Wheeler runs with samples at their ends.

Suffixes are ordered as if each string ended in a separator of its own, smaller than any byte. The
Burrows-Wheeler transform of that order is kept as runs of equal symbols only. For the first and the last
suffix of a run the text position is sampled, with the length it shares with its neighbour outside the
run. Inside a run nothing has to be stored: of two neighbours with the same preceding byte, the suffixes
one byte earlier are neighbours too and share one byte more. So the length that a position shares with its
neighbour follows from the nearest sample before it, less the distance, and the matching statistics of
all positions are streamed from the samples in text order. In repetitive strings runs are few.

The order is built by doubling over packed ranks; strings may be up to LONGEST bytes.
"""

from __future__ import annotations

import numpy as np

FIRST, DOUBLINGS = 7, 7
LONGEST = FIRST << DOUBLINGS


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks of keys, equal for equal keys."""
    order = np.argsort(key)
    k = key[order]
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(np.r_[False, k[1:] != k[:-1]], dtype=np.int32)[: len(key)]
    return out


class RunIndex:
    """Runs of the transform, their sampled ends, and the lengths shared across run borders."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        if len(sizes) and sizes.max() > LONGEST:
            raise ValueError(f"strings are cut to {LONGEST} bytes before they are indexed")
        self.n = n = int(sizes.sum())
        self.starts = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(strings), np.uint8)
        rest = np.repeat(self.starts + sizes, sizes) - np.arange(n)
        first = np.zeros(n, bool)
        first[self.starts[sizes > 0]] = True
        ranks = self._ranks(text, rest)
        place = np.arange(n)
        order = np.argsort(ranks[-1].astype(np.int64) * max(n, 1) + place)
        before = np.where(first[order], -1, text[order - 1].astype(np.int64)) if n else np.empty(0, np.int64)
        border = np.ones(n + 1, bool)
        border[1:n] = (before[1:] != before[:-1]) | (before[1:] < 0)
        heads, tails = np.flatnonzero(border[:n]), np.flatnonzero(border[1:])
        self.symbols, self.lengths = before[heads], np.diff(np.r_[heads, n])
        shared = np.zeros(n + 1, np.int64)  # with the suffix before, at run borders only
        inner = heads[heads > 0]
        shared[inner] = self._shared(text, rest, ranks, order[inner - 1], order[inner])
        self.head_at, self.head_shares = order[heads], shared[heads]
        self.tail_at, self.tail_shares = order[tails], shared[tails + 1]

    @staticmethod
    def _ranks(text: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
        """Ranks of all suffixes by their first 7, 14, 28, ... bytes."""
        n = len(text)
        key, padded = np.zeros(n, np.int64), np.r_[text.astype(np.int64), np.zeros(FIRST, np.int64)]
        for k in range(FIRST):
            key = key << 8 | np.where(rest > k, padded[k : k + n], 0)
        out = [_dense(key << 4 | np.minimum(rest, FIRST))]
        for d in range(DOUBLINGS):
            h = FIRST << d
            if n == 0 or h >= rest.max():
                break
            r = out[-1].astype(np.int64)
            later = np.r_[r[h:], np.zeros(min(h, n), np.int64)] + 1
            out.append(_dense(r * (n + 1) + np.where(rest > h, later, 0)))
        return out

    @staticmethod
    def _shared(text, rest, ranks, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and at b have in common."""
        a, b, n = a.copy(), b.copy(), len(text)
        most = np.minimum(rest[a], rest[b])
        out = np.zeros(len(a), np.int64)
        for d in range(len(ranks) - 1, -1, -1):
            h = FIRST << d
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += np.where((most - out >= h) & (ranks[d][x] == ranks[d][y]), h, 0)
        alive = np.ones(len(a), bool)
        for _ in range(FIRST):
            alive &= (out < most) & (text[np.minimum(a + out, n - 1)] == text[np.minimum(b + out, n - 1)])
            out += alive
        return out

    def matching(self) -> np.ndarray:
        """For each position the longest match that starts there and anywhere else too."""
        out = np.zeros(self.n, np.int64)
        place = np.arange(self.n)
        for at, shares in ((self.head_at, self.head_shares), (self.tail_at, self.tail_shares)):
            value, last = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
            value[at], last[at] = shares, at
            last = np.maximum.accumulate(last)
            out = np.maximum(out, value[last] - (place - last))
        return out
