"""Words of many texts as flat numpy arrays.

A stretch of texts is one byte buffer; words are runs of non-blank bytes, and
each has a 64-bit hash made from its bytes, all without a loop over texts.
Hashes are fixed by ``SEED`` and alike on every machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEED = 90210
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(SEED)
BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)]
SPREAD = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= MIX[0]
    x ^= x >> np.uint64(33)
    x *= MIX[1]
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    buffer: bytes
    start: np.ndarray  #: of each word in the buffer
    end: np.ndarray
    first: np.ndarray  #: words of text i are first[i]:first[i + 1]
    hash: np.ndarray


def flat_words(texts: list[bytes], lower: bool = False) -> Words:
    """The words of the texts; ``lower`` folds A to Z first."""
    buffer = b"\n".join(texts) + b"\n"
    if lower:
        buffer = buffer.lower()
    flat = np.frombuffer(buffer, np.uint8)
    blank = BLANK[flat]
    start = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    end = np.flatnonzero(blank & ~np.append(True, blank[:-1]))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, bounds)
    if not len(start):
        return Words(buffer, start, end, first, np.empty(0, np.uint64))
    place = np.arange(len(flat)) - np.repeat(np.append(0, start), np.diff(np.append(np.append(0, start), len(flat))))
    powers = STEP ** np.arange(int(place.max()) + 1, dtype=np.uint64)
    value = np.where(blank, np.uint64(0), BYTE[flat] * powers[place])
    return Words(buffer, start, end, first, mix64(np.add.reduceat(value, start) + (end - start).astype(np.uint64)))


def joined_hashes(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of words that lie end to end: word i is flat[ends[i]:ends[i + 1]]. The same as of ``flat_words``."""
    size = np.diff(ends)
    if not len(size):
        return np.empty(0, np.uint64)
    value = (STEP ** np.arange(int(size.max()), dtype=np.uint64)).take(np.arange(len(flat)) - np.repeat(ends[:-1], size))
    value *= BYTE.take(flat)
    return mix64(np.add.reduceat(value, ends[:-1]) + size.astype(np.uint64))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each place on (fewer places than words by size - 1)."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size if n else 0):
        out += hashes[k : k + n] * SPREAD[k]
    return mix64(out)
