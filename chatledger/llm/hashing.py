"""Hashes of words, of runs of words or bytes, and of windows, computed for many texts at once with numpy.

Runs are hashed as polynomials modulo 2**64 over random 64-bit codes, from running sums, so any run costs the same.
"""

from __future__ import annotations

import numpy as np

from chatledger.llm.common import odd_bytes

_CODES = odd_bytes(11, 256)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, count: int) -> np.ndarray:
    """1, base, base**2, ...; kept and grown as longer texts come."""
    own = _powers.get(int(base))
    if own is None or len(own) < count:
        own = np.full(max(count, 1 << 16), base, np.uint64)
        own[0] = 1
        _powers[int(base)] = own = np.multiply.accumulate(own)
    return own[:count]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def sums(codes: np.ndarray) -> np.ndarray:
    """Running sums from which ``run_hash`` tells any run of ``codes``."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power(_BASE, len(codes)), out=out[1:])
    return out


def run_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run [start, end); equal runs at different places have equal hashes."""
    size = np.asarray(end - start, np.uint64)
    return mix((running[end] - running[start]) * _power(_INVERSE, len(running))[start] + size * _CODES[1])


def grams(running: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k``."""
    n = len(running) - k
    return mix((running[k:] - running[:-k]) * _power(_INVERSE, n)) if n > 0 else np.zeros(0, np.uint64)


def byte_codes(flat: np.ndarray) -> np.ndarray:
    """A random number for every byte."""
    return _CODES[flat]


def lower(flat: np.ndarray) -> np.ndarray:
    """A to Z in lower case; all else unchanged."""
    return _LOWER[flat]


def find_words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in texts that lie one after the other, and how many words lie before each text
    (and in all): words never reach from one text into the next. ``offsets`` count from the first byte of ``flat``."""
    inside = ~_SPACE[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    return run_hash(sums(byte_codes(flat)), starts, ends)
