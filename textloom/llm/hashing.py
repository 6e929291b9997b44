"""Vectorised polynomial prefix hashes over bytes and words (numpy, 64-bit wrap-around arithmetic)."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE_BYTES = 0x9E3779B97F4A7C15
BASE_WORDS = 0xD6E8FEB86659FD93
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Low bits of an order that give way to a place: the same ones in every batch, so that texts cut alike everywhere.
PLACE_BITS = 28

_random = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte; FOLDED has one value for A-Z and a-z.
VALUES = _random.integers(1, 2**64, 256, dtype=np.uint64)
FOLDED = VALUES.copy()
FOLDED[65:91] = VALUES[97:123]

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, U(base & (2**64 - 1)))
        have[0] = 1
        have = np.cumprod(have)
        if size <= 1 << 21:  # longer ones are made anew, so that one huge text doesn't stay in memory
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64 bits."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """P with P[i] = sum of values[j] * base ** j for j < i."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def windows(p: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of `width` values, from their prefix hashes p."""
    n = len(p) - 1
    if n < width:
        return np.zeros(0, np.uint64)
    return (p[width:] - p[:-width]) * powers(inverse(base), n - width + 1)


def words(data: np.ndarray, offsets: np.ndarray, values: np.ndarray = VALUES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined without a gap: starts and ends of words (no word crosses a text's end), their hashes, and the number of words before each text."""
    black = ~WHITE[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, black[:-1]
        after[-1], after[:-1] = False, black[1:]
        edges = offsets[1:-1]
        before[edges[edges < len(data)]] = False
        after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(black & ~before)
    ends = np.flatnonzero(black & ~after) + 1
    p = prefix(values[data], BASE_BYTES)
    h = mix((p[ends] - p[starts]) * powers(inverse(BASE_BYTES), max(1, len(data)))[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    return starts, ends, h, np.searchsorted(starts, offsets)


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the first place of its least one by the high bits.

    The low bits carry the place, so that one minimum does both; what decides depends on the run's values alone.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = PLACE_BITS
    if len(values) >> bits:  # a longer text in pieces that overlap
        step = (1 << bits) - width
        return np.concatenate([sliding_first_min(values[a : a + step + width - 1], width) + a for a in range(0, n, step)])
    low = ((values >> U(bits)) << U(bits)) | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have < width:
        shift = min(have, width - have)
        low = np.minimum(low[:-shift], low[shift:])
        have += shift
    return (low[:n] & U((1 << bits) - 1)).astype(np.int64)
