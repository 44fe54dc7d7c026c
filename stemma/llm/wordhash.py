"""Vectorised 64-bit hashes of the words and word windows of texts, for use inside tasks.

Texts are hashed in chunks of bounded size, so that a batch of long texts needs little memory beyond
the texts themselves. Equal words always get equal hashes; two different words or windows share one
with a probability of about 2**-64, which is far below the rate of disk or memory faults.
"""

from __future__ import annotations

import functools

import numpy as np

CHUNK_BYTES = 1 << 18

_U = np.uint64
_WINDOW = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.cache
def _alphabet(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: whether it separates words, and the random value it stands for.

    `space` splits at ASCII blanks only, `letters` also at every other ASCII byte that is no letter or
    digit. Both fold A-Z to a-z; bytes of other characters belong to words as they are.
    """
    sep = np.zeros(256, bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    if kind == "letters":
        keep = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
        sep[:] = [b not in keep for b in range(256)]
    fold = np.arange(256, dtype=np.uint64)
    fold[0x41:0x5B] += _U(0x20)
    return sep, _mix((fold + _U(1)) * _U(0xD6E8FEB86659FD93))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x2545F4914F6CDD1D, np.uint64))


def _hash_chunk(raw: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte position of each word of one chunk."""
    sep, value = _alphabet(kind)
    a = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(~sep[a])
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    length = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, length)
    top = 1 << max(6, int(length.max() - 1).bit_length())
    total = np.add.reduceat(value[a[at]] * _powers(top)[place], first)
    return _mix(total + length.astype(np.uint64)), at[first]


def word_hashes(texts: list[str | None], kind: str = "space") -> list[np.ndarray]:
    """One array of word hashes per text, in order; empty for null texts."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        raw, bounds, size = [], [0], 0
        while i < len(texts) and (not raw or size < CHUNK_BYTES):
            b = (texts[i] or "").encode("utf-8", "surrogatepass")
            raw += [b, b"\n"]
            size += len(b) + 1
            bounds.append(size)
            i += 1
        h, at = _hash_chunk(b"".join(raw), kind)
        cuts = np.searchsorted(at, bounds[1:-1])
        out += np.split(h, cuts)
    return out


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; the whole sequence if there are fewer; empty without words."""
    n = len(words)
    if not n:
        return words
    w = min(width, n)
    acc = np.zeros(n - w + 1, np.uint64)
    for k in range(w):
        acc = _mix((acc + words[k : n - w + 1 + k]) * _WINDOW)
    return acc if w == width else _mix(acc + _U(w))
