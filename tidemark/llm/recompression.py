"""Locally consistent parsing of a word sequence by recompression, and seeds for its windows.

Each round names runs of equal symbols and then pairs of a left-class and a right-class symbol. A name is a
hash of what it stands for, and the classes are hash bits, so every task names alike without talking to another, and
equal stretches of words get equal symbols except near their ends. How near is tracked: each symbol
carries the span of words that decided it. A symbol whose span lies within a window is the same in every copy of that
window. The *seed* of a window is its highest such symbol (of equal ones, by name, then
the first); consecutive windows with one seed form a *block*. A block is named by its seed and the words
that all windows with this seed have, so a window's copies are in blocks of its block's name. Names only propose: what is
equal is decided on the words' bytes.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.wordhash import U, mix, rolled

FAR = 1 << 40
ROUNDS = 4


def _round(name: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: runs, then pairs. ``lo``/``hi``: the words that decided a symbol, beyond the text at its ends."""
    n = len(name)
    start = np.ones(n, bool)
    start[1:] = name[1:] != name[:-1]
    first = np.flatnonzero(start)
    size = np.diff(np.append(first, n))
    last = first + size - 1
    # That a run ends where it does is known from the symbols beside it.
    low = np.where(first > 0, lo[np.maximum(first - 1, 0)], -FAR)
    high = np.where(last < n - 1, hi[np.minimum(last + 1, n - 1)], FAR)
    name = np.where(size > 1, mix(name[first] * U(5) + size.astype(U)), name[first])
    n = len(name)
    left = (mix(name + U(salt)) >> U(63)).astype(bool)
    pair = np.zeros(n, bool)
    pair[:-1] = left[:-1] & ~left[1:]
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    before, after = np.append(-FAR, low[:-1]), np.append(high[1:], FAR)
    new_lo = np.where(~left & ~second, before, low)  # a right-class symbol stays alone for what is before it
    new_hi = np.where(left, after, high)  # as a pair's first it takes its second; alone, for what is after it
    joined = name.copy()
    at = np.flatnonzero(pair)
    joined[at] = mix(name[at] * U(3) + mix(name[at + 1]) + U(salt))
    keep = ~second
    return joined[keep], new_lo[keep], new_hi[keep]


def ranks(h: np.ndarray, span: int) -> np.ndarray:
    """For each word, the highest symbol decided by words from there on, at most ``span``: level and name in one number."""
    n = len(h)
    out = mix(h) >> U(4)
    name, lo, hi = h, np.arange(n), np.arange(1, n + 1)
    for level in range(1, ROUNDS + 1):
        name, lo, hi = _round(name, lo, hi, 0x51ED27 * level)
        sure = np.flatnonzero((lo >= 0) & (hi <= n) & (hi - lo <= span))
        if not len(sure):
            break
        np.maximum.at(out, lo[sure], (name[sure] >> U(4)) | U(level << 60))
    return out


def blocks(h: np.ndarray, window: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, name and end (of its words) of each block. Windows 0..n-window are each in one block."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    span = window // 2 + 1
    width = window - span + 1  # where in a window a seed may start
    r = ranks(h, span)
    at, best, have = np.arange(n), r, 1
    while have < width:
        step = min(have, width - have)
        other = best[step:]
        take = other > best[: len(other)]
        at = np.where(take, at[step:], at[: len(other)])
        best = np.where(take, other, best[: len(other)])
        have += step
    at = at[: n - window + 1]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    seed = at[first]
    end = np.append(first[1:], len(at)) - 1 + window
    return first, mix(r[seed] ^ rolled(h, span)[seed]), end
