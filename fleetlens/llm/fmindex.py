"""FM-index over an integer text: suffix array by prefix doubling, wavelet matrix over the
Burrows-Wheeler transform (packed bits with block counts), sampled suffix positions.

The text is a sequence of strings over symbols >= 1, each closed by the terminator 0. Terminators
are distinct from one another (ordered by position), so no match crosses a string's end. All
queries are vectorised over many patterns at once.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; only suffixes still tied are sorted again."""
    n = len(sym)
    ends = np.flatnonzero(sym == 0)
    key = sym.astype(np.int64) + (len(ends) - 1)
    key[ends] = np.arange(len(ends))
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    slots, step = np.arange(n), 0
    pos, skey = sa, key[sa]
    while len(slots):
        first = np.ones(len(slots), bool)
        first[1:] = skey[1:] != skey[:-1]
        rank[pos] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        last = np.ones(len(slots), bool)
        last[:-1] = first[1:]
        tied = ~(first & last)
        slots, step = slots[tied], max(1, step * 2)
        pos = sa[slots]
        if len(pos):
            # a tied suffix has no terminator in its first `step` symbols, so pos + step exists
            skey = rank[pos] * n + rank[pos + step]
            order = np.argsort(skey, kind="stable")
            pos, skey = pos[order], skey[order]
            sa[slots] = pos
    return sa


class _Bits:
    """Packed bit vector with a count per 64-bit block."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.counts = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.counts[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        block = i >> 6
        mask = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.counts[block] + np.bitwise_count(self.words[block] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(U64)) & U64(1)).astype(np.int64)


class FMIndex:
    def __init__(self, sym: np.ndarray, sample: int = 8):
        self.n = n = len(sym)
        sa = suffix_array(sym)
        sigma = int(sym.max()) + 1 if n else 1
        self.levels = max(1, int(sigma - 1).bit_length())
        row = sym[sa - 1].astype(np.int64)  # sa == 0 wraps to the last terminator
        self.bits: list[tuple[int, _Bits, int]] = []
        for level in range(self.levels - 1, -1, -1):
            b = ((row >> level) & 1).astype(bool)
            self.bits.append((level, _Bits(b), int(n - b.sum())))
            row = np.concatenate([row[~b], row[b]])
        below = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(sym, minlength=sigma), out=below[1:])
        symbols = np.arange(sigma)
        self.shift = below[:-1] - self._descend(symbols, np.zeros(sigma, np.int64))
        # positions that end a walk of locate(): every `sample`-th one and every string start
        kept = (sa % sample == 0) | (sym[sa - 1] == 0)
        self.marked, self.positions = _Bits(kept), sa[kept]

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.bits:
            ones = bits.rank(i)
            i = np.where((c >> level) & 1, zeros + ones, i - ones)
        return i

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Rows before the suffixes c + S, for S's rank i."""
        return self.shift[c] + self._descend(c, i)

    def search(self, symbol_at, count: int, length: int, least: int = 1):
        """Backward search of ``count`` patterns of ``length`` symbols at once.

        ``symbol_at(j, which)`` gives symbol j of the patterns ``which``. A pattern is given up
        as soon as its interval holds under ``least`` suffixes. Returns (which, low, high).
        """
        which = np.arange(count)
        low, high = np.zeros(count, np.int64), np.full(count, self.n, np.int64)
        for j in range(length - 1, -1, -1):
            c = symbol_at(j, which)
            known = c < len(self.shift)  # the text may lack the largest symbols
            if not known.all():
                which, low, high, c = which[known], low[known], high[known], c[known]
            low, high = self.step(c, low), self.step(c, high)
            alive = high - low >= least
            which, low, high = which[alive], low[alive], high[alive]
            if not len(which):
                break
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row, by walking back to a sampled position."""
        out = np.empty(len(rows), np.int64)
        todo, at, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.marked.get(at).astype(bool)
            out[todo[hit]] = self.positions[self.marked.rank(at[hit])] + walked
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                at = self._previous(at)
            walked += 1
        return out

    def _previous(self, i: np.ndarray) -> np.ndarray:
        c, j = np.zeros(len(i), np.int64), i
        for level, bits, zeros in self.bits:
            b = bits.get(j)
            ones = bits.rank(j)
            c |= b << level
            j = np.where(b, zeros + ones, j - ones)
        return self.shift[c] + j


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows of the intervals, and the number of the interval each belongs to."""
    width = high - low
    owner = np.repeat(np.arange(len(low)), width)
    first = np.cumsum(width) - width
    return np.arange(int(width.sum())) - first[owner] + low[owner], owner
