"""Vectorised word hashing.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR, so
word boundaries in UTF-8 equal those of ``[^\\x20\\x09-\\x0D]+`` over code points.
Each word gets a 64-bit polynomial hash over random byte values, finished with a
bijective mixer; n-gram hashes combine the words' hashes with odd multipliers.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Longest stretch of bytes hashed at once; longer texts go in pieces cut at white space.
PIECE = 1 << 20


def mix(x: np.ndarray | int) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, U)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random words that depend on the seed only."""
    with np.errstate(over="ignore"):
        return mix(U(seed) + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = U(0xD6E8FEB86659FD93)
_P_INV = U(pow(int(_P), -1, 1 << 64))
_TAB = stream(11, 256) | U(1)
_TAB[SPACE] = 0
_TAB_LOWER = _TAB.copy()
_TAB_LOWER[65:91] = _TAB[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length() if n > 1 else 1)
        with np.errstate(over="ignore"):
            have = np.ones(size, U)
            have[1:2] = base
            done = 2
            while done < size:
                step = min(done, size - done)
                have[done : done + step] = have[:step] * (have[done - 1] * base)
                done += step
        _powers[int(base)] = have
    return have[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte start of each word, and for each text the index of its first word (one more entry at the end)."""
    solid = ~space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


def _hash_piece(data: np.ndarray, starts: np.ndarray, tab: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(tab[data] * powers(_P, len(data)), starts)
        return mix(sums * powers(_P_INV, len(data))[starts])


def byte_table(lower: bool = False, space: np.ndarray = SPACE, digits: bool = True) -> np.ndarray:
    """A value for each byte; digits=False: all digits alike."""
    tab = (_TAB_LOWER if lower else _TAB).copy()
    if not digits:
        tab[48:58] = tab[48]
    tab[space] = 0
    return tab


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, tab: np.ndarray | None = None, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, word range of each text (as in word_spans), byte start of each word."""
    starts, ranges = word_spans(data, offsets, space)
    tab = (_TAB_LOWER if lower else _TAB) if tab is None else tab
    if not len(starts):
        return np.zeros(0, U), ranges, starts
    if len(data) <= PIECE:
        return _hash_piece(data, starts, tab), ranges, starts
    out, at = [], 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
        stop = starts[end] if end < len(starts) else len(data)
        out.append(_hash_piece(data[starts[at] : stop], starts[at:end] - starts[at], tab))
        at = end
    return np.concatenate(out), ranges, starts


def grams(words: np.ndarray, n: int, seed: int = 1, keep: list[int] | None = None) -> np.ndarray:
    """Hash of each run of n words (as if texts were one); keep: positions that count, all by default."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    coefficients = stream(1000 + seed, n) | U(1)
    total = np.zeros(m, U)
    with np.errstate(over="ignore"):
        for j in range(n) if keep is None else keep:
            total += words[j : j + m] * coefficients[j]
    return mix(total)


def gram_starts(ranges: np.ndarray, n: int) -> np.ndarray:
    """True at each position where a run of n words stays inside its text."""
    total = int(ranges[-1])
    ok = np.zeros(max(total - n + 1, 0), bool)
    if not len(ok):
        return ok
    change = np.zeros(len(ok) + 1, np.int32)
    lo, hi = ranges[:-1], ranges[1:] - n + 1
    has = hi > lo
    np.add.at(change, lo[has], 1)
    np.add.at(change, hi[has], -1)
    np.cumsum(change[:-1], out=change[:-1])
    return change[:-1] > 0
