"""Vectorised hashing of words and word sequences straight from UTF-8 buffers (numpy, no object per word).

Hashes have 64 bits; two different words or shingles share one with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Powers for runs of up to this many bytes are kept (8 MB); those for longer ones are made anew.
_KEPT_POWERS = 1 << 19
_powers: list[np.ndarray] = []


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values; ``salt`` picks one of many."""
    x = x + U((salt * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _KEPT_POWERS:
        return _powers_of(_BASE, n), _powers_of(_INVERSE, n)
    if not _powers:
        _powers.extend(_powers_of(base, _KEPT_POWERS) for base in (_BASE, _INVERSE))
    return _powers[0][:n], _powers[1][:n]


def _powers_of(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[0] = 1
    return np.multiply.accumulate(p, out=p)


def byte_values(lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower`` A-Z count as a-z."""
    v = mix(np.arange(1, 257, dtype=U), 77)
    if lower:
        v[65:91] = v[97:123]
    return v


def separators(codes: list[int]) -> np.ndarray:
    """Lookup table that is False at the given byte values and True elsewhere."""
    table = np.ones(256, bool)
    table[codes] = False
    return table


#: Words are runs of anything but space and the five ASCII controls 9 to 13.
PLAIN_WORDS = separators([32, *range(9, 14)])
#: Words are runs of ASCII letters, digits and all bytes of other characters.
ALNUM_WORDS = separators([b for b in range(128) if not chr(b).isalnum()])


def spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each text (one more entry than texts); no word crosses texts."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[raw]
    full = offsets[:-1] < offsets[1:]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][full]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One hash per span, by differences of a running polynomial hash."""
    return hashes_between(running(values[raw]), starts, ends)


def running(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hash of a sequence, for ``hashes_between``."""
    forth, back = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * forth[:-1], out=total[1:])
    return total, back


def hashes_between(run: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per part of the sequence, whatever its place."""
    total, back = run
    return mix((total[ends] - total[starts]) * back[starts], 3)


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i..i+k-1 for every i from 0 to len-k (positions that cross texts must be left out by the caller)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = mix(words[:n], k)
    for j in range(1, k):
        h = mix(h * U(0x9FB21C651E98DF25) + words[j : j + n], 11 + j)
    return h


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, end to end, and their boundaries; fewer than k words make one shingle."""
    n_texts, lengths = len(first) - 1, np.diff(first)
    every = sequence_hashes(words, k)
    counts = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(bounds[-1], U)
    for i in range(n_texts):
        lo, hi, a, n = bounds[i], bounds[i + 1], first[i], lengths[i]
        if n >= k:
            part = out[lo:hi]
            part[:] = every[a : a + n - k + 1]
            part.sort()
        elif n:
            out[lo] = sequence_hashes(words[a : a + n], int(n))[0]
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][counts > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[bounds]
