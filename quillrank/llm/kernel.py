"""Vectorised hashing of words and lines straight from Arrow's byte buffers.

A span's hash is a polynomial over random 64-bit codes of its bytes, taken
from one running sum, so no Python object is made for a word.  Spans are equal
if their bytes are (with A-Z lower-cased where asked); different spans get
equal hashes with a chance of about 2**-60 a pair.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C13  # 3 modulo 4: differences of powers lose one bit only
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(1 << 62, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODES, LOWER_CODES = _CODES, _CODES[LOWER]

ROLL = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACE
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, letters, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64."""
    have = _powers.get(str(base))
    if have is None or len(have) <= n:
        size = max(1 << 21, 1 << int(n + 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        k = 1
        with np.errstate(over="ignore"):
            while k < size:
                have[k : 2 * k] = have[:k] * np.uint64(pow(base, k, 1 << 64))
                k *= 2
        _powers[str(base)] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (a bijection)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    n = len(raw)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(codes[raw] * _power(_BASE, n)[:n], out=total[1:])
        h = (total[ends] - total[starts]) * _power(_INVERSE, n)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes within rows, and how many each row has."""
    n = len(raw)
    flag = np.zeros(n + 2, bool)
    flag[1:-1] = is_word[raw]
    inner = flag[1:-1]
    first = inner & ~flag[:-2]
    last = inner & ~flag[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inner[edges]
    last[edges - 1] = inner[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of each row (split at \\n; an empty row is one empty line), and how many."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    counts = np.diff(np.searchsorted(breaks, offsets)) + 1
    return starts, ends, counts


def stripped(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without [\\x20\\x09-\\x0D] at both ends; a span of nothing else becomes empty."""
    solid = np.flatnonzero(NOT_SPACE[raw])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = a < b
    s, e = starts.copy(), starts.copy()
    s[full], e[full] = solid[a[full]], solid[b[full] - 1] + 1
    return s, e


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * ROLL + words[j : j + size]
    return mix(out)
