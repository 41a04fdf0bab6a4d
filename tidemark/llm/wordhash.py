"""64-bit hashes of the words of a text, all at once in numpy, and mixing of hashes."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_BLOCK = 1 << 12
_factors = np.zeros(0, U)


def _factor(n: int) -> np.ndarray:
    """A random 64-bit factor for each place in a word, the same in every task."""
    global _factors
    if len(_factors) < n:
        _factors = np.concatenate([np.random.default_rng([20_240_917, i]).integers(0, 1 << 64, _BLOCK, dtype=U, endpoint=False) for i in range(-(-n // _BLOCK))])
    return _factors


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word ``[^\\x20\\x09-\\x0D]+``."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_WHITE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(data: bytes, at: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A hash of each word's bytes; equal words have equal hashes wherever they stand.

    The sum of (byte + 1) * factor of its place: multilinear hashing modulo 2**64, where any two words, whatever their structure, agree
    with a probability of 2**-55 at most over the choice of factors.
    """
    first, end = at or spans(data)
    if not len(first):
        return np.zeros(0, U)
    size = end - first
    starts = np.cumsum(size) - size
    total = int(starts[-1] + size[-1])
    solid = np.frombuffer(data, np.uint8)
    if total < len(data):
        solid = solid[~_WHITE[solid]]
    place = np.arange(total) - np.repeat(starts, size)
    return mix(np.add.reduceat((solid.astype(U) + U(1)) * _factor(int(size.max()))[place], starts, dtype=U))


def rolled(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    base = _BASE if not salt else mix(np.array([salt], U))[0] | U(1)
    inverse = U(pow(int(base), -1, 1 << 64))
    up, down = np.full(len(h) + 1, base, U), np.full(len(h) + 1, inverse, U)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    x = mix(h + U(salt)) if salt else h
    sums = np.concatenate([np.zeros(1, U), np.cumsum(x * up[:-1], dtype=U)])
    return mix((sums[width:] - sums[:-width]) * down[: n] + U(width))
