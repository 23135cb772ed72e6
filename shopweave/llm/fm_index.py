"""A text index for batched phrase search: suffix order, Burrows-Wheeler transform, wavelet matrix, sampled places.

Symbols are integers; 0 separates stretches, and no phrase holds it. Separators count as
different from each other, by place, so a comparison of suffixes ends with its stretch. All steps
work on whole numpy arrays: a search takes all phrases back by one symbol at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Every so many symbols a place is kept; finding a place walks back that far at most.
EVERY = 16
#: Occurrences that are located at once.
LOCATED = 1 << 20


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of ``text`` by ascending suffix, by doubling: only suffixes that still tie are sorted again. The text ends with 0."""
    n, zero = len(text), text == 0
    key = np.where(zero, np.cumsum(zero), np.count_nonzero(zero) + text.astype(np.int64))
    rank, order, slots, h = np.empty(n, np.int64), np.empty(n, np.int64), np.arange(n), 0
    at = slots
    while len(slots):
        if h:
            at = order[slots]
            key = rank[at] * (n + 1) + rank[at + h]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        first = np.append(True, key[1:] != key[:-1])
        rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        slots = slots[~(first & np.append(first[1:], True))]
        h = 2 * h or 1
    return order


class Bits:
    """A bit array with the number of set bits before any place; 64 bits take 12 bytes."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, bool)
        padded[: len(bits)] = bits
        self.cells = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.cells), dtype=np.int64)).astype(np.int32)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.cells[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0

    def rank(self, at: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.cells[at >> 6] & below)


class WaveletMatrix:
    """Symbols by their bits, highest first; a level keeps the order of the one above, zeros before ones."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(width - 1, -1, -1):
            bits = (symbols >> shift) & 1 > 0
            self.levels.append((shift, Bits(bits), int(np.count_nonzero(~bits))))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def places(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """Where each place of ``at`` comes to on the lowest level, if the symbol's bits are followed."""
        out = list(at)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 > 0
            for k, x in enumerate(out):
                ones = bits.rank(x)
                out[k] = np.where(one, zeros + ones, x - ones)
        return out

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, its place on the lowest level)."""
        symbol = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at


class FMIndex:
    """Index of a text of symbols below ``n_symbols`` that begins and ends with 0."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        order = suffix_order(text)
        before = text[order - 1]
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=n_symbols)))
        self.tree = WaveletMatrix(before, max(1, int(n_symbols - 1).bit_length()))
        (self.lowest,) = self.tree.places(np.arange(n_symbols), np.zeros(n_symbols, np.int64))
        kept = (before == 0) | (order % EVERY == 0)
        self.kept, self.place = Bits(kept), order[kept].astype(np.int32)

    def search(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each phrase ``symbols[start : start + length]``; equal if it has no occurrence."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.first[-1])
        live = np.arange(len(start))
        for k in range(1, int(length.max(initial=0)) + 1):
            live = live[(low[live] < high[live]) & (length[live] >= k)]
            s = symbols[start[live] + length[live] - k].astype(np.int64)
            a, b = self.tree.places(s, low[live], high[live])
            low[live], high[live] = self.first[s] + a - self.lowest[s], self.first[s] + b - self.lowest[s]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row, by steps back to a kept one."""
        rows, out, steps, live = rows.copy(), np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(live):
            held = self.kept.get(rows)
            out[live[held]] = self.place[self.kept.rank(rows[held])] + steps
            live, rows = live[~held], rows[~held]
            symbol, at = self.tree.access(rows)
            rows, steps = self.first[symbol] + at - self.lowest[symbol], steps + 1
        return out

    def occurrences(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, place) of every occurrence, by bounded lots."""
        low, high = self.search(symbols, start, length)
        found = np.flatnonzero(high > low)
        ends = np.cumsum(high[found] - low[found])
        for at in range(0, int(ends[-1]) if len(ends) else 0, LOCATED):
            nth = np.arange(at, min(at + LOCATED, ends[-1]))
            which = np.searchsorted(ends, nth, "right")
            yield found[which], self.locate(high[found[which]] - ends[which] + nth)
