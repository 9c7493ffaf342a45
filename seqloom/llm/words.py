"""Vectorised words, word hashes and window hashes over byte buffers (numpy)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PIECE = 1 << 20
BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        have = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, U64)
            x[0] = 1
            have.append(np.multiply.accumulate(x))
        have = tuple(have)
        if size <= 4 * _PIECE:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def spans(buf: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row (and the end) the number of words before it."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    ws = white[buf]
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = ws[:-1]
    inner = off[(off > 0) & (off < n)]
    edge[inner] = True
    starts = np.flatnonzero(edge & ~ws)
    edge[-1] = True
    edge[:-1] = ws[1:]
    edge[inner - 1] = True
    ends = np.flatnonzero(edge & ~ws) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A mixed 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + _PIECE, "right")))
        b = int(ends[j - 1])
        up, down = powers(b - a + 1, BASES[which])
        sums = np.zeros(b - a + 1, U64)
        np.cumsum((buf[a:b].astype(U64) + U64(1)) * up[:-1], out=sums[1:])
        s = starts[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[s]) * down[s]
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive word hashes (rows' borders not regarded)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    up, down = powers(len(words) + 1, BASES[which])
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:n])


def sliding(x: np.ndarray, size: int, op=np.minimum) -> np.ndarray:
    """op over every run of ``size`` values, by doubling."""
    n = len(x) - size + 1
    if n <= 0:
        return x[:0]
    width = 1
    while 2 * width <= size:
        x = op(x[:-width], x[width:])
        width *= 2
    return op(x[:n], x[size - width : size - width + n])
