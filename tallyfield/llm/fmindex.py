"""A compressed FM-index: the Burrows-Wheeler transform in a wavelet matrix of packed bits.

All searches are vectorised: many patterns take one backward step at a time.
"""

from __future__ import annotations

import numpy as np

from tallyfield.llm.suffixes import suffix_array


class PackedBits:
    """A bit vector with rank in constant time: 64-bit words and the count before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.pad(packed, (0, -len(packed) % 8 + 8))
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]))]).astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FmIndex:
    """Index of sequences over symbols 1, 2, ...; matches never cross sequences."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray, counts: np.ndarray | None = None):
        """``sequences`` lie side by side, ``lengths`` says how long each is, ``counts`` how often each
        stands in the collection (once)."""
        n = len(lengths)
        counts = np.ones(n, np.int64) if counts is None else counts
        ends = np.cumsum(lengths) + np.arange(n)  # places of the separators
        text = np.zeros(len(sequences) + n, np.int64)
        own = np.ones(len(text), bool)
        own[ends] = False
        text[own] = sequences
        # for sorting, each separator is a symbol of its own below all others
        apart = text + n - 1
        apart[ends] = np.arange(n)
        sa, _ = suffix_array(apart, np.zeros(len(apart), np.int8))
        bwt = text[sa - 1]
        of = np.repeat(np.arange(n), lengths + 1)
        self.weight = np.concatenate([[0], np.cumsum(counts[of[sa]])])
        self.symbols = int(text.max()) + 1 if len(text) else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.levels = []
        level = bwt
        for bit in range(max(1, int(self.symbols - 1).bit_length()) - 1, -1, -1):
            ones = (level >> bit & 1).astype(bool)
            zeros = int(len(level) - ones.sum())
            self.levels.append((bit, PackedBits(ones), zeros))
            level = np.concatenate([level[~ones], level[ones]])
        self.start = self._walk(np.arange(self.symbols), np.zeros(self.symbols, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            r = bits.rank(i).astype(np.int64)
            i = np.where(c >> bit & 1, zeros + r, i - r)
        return i

    def count(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Occurrences in the collection of what the intervals stand for."""
        return self.weight[hi] - self.weight[lo]

    def begin(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of single symbols."""
        return self.first[c], self.first[c + 1]

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol to the left."""
        both = self._walk(np.concatenate([c, c]), np.concatenate([lo, hi]))
        base = self.first[c] - self.start[c]
        return base + both[: len(c)], base + both[len(c) :]


def repeated_windows(index: FmIndex, sequences: np.ndarray, begins: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """For each sequence, bit j is set if its ``width`` symbols from j on stand in the collection twice or more.

    Matching statistics by backward search: first of the whole sequence; where that fails, window by
    window from the left. A search that fails at a place rules out all windows from there back to
    the window's start, so the next window begins right after it. Sequences have at most 63 windows.
    """
    out = np.zeros(len(lengths), np.uint64)
    windows = lengths - width + 1
    live = np.flatnonzero(windows > 0)
    # the whole sequence at once
    at = begins[live] + lengths[live] - 1
    stop = begins[live]
    lo, hi = index.begin(sequences[at])
    while len(live):
        fine = index.count(lo, hi) >= 2
        done = fine & (at == stop)
        whole = live[done]
        out[whole] = (np.uint64(1) << windows[whole].astype(np.uint64)) - np.uint64(1)
        go = fine & ~done
        live, at, stop, lo, hi = live[go], at[go] - 1, stop[go], lo[go], hi[go]
        if len(live):
            lo, hi = index.extend(sequences[at], lo, hi)
    # the rest, window by window
    live = np.flatnonzero((windows > 0) & (out == 0))
    j = np.zeros(len(live), np.int64)
    at = begins[live] + width - 1
    lo, hi = index.begin(sequences[at])
    while len(live):
        place = at - begins[live]
        fail = index.count(lo, hi) < 2
        hit = ~fail & (place == j)
        out[live[hit]] |= np.uint64(1) << j[hit].astype(np.uint64)
        fresh = fail | hit
        j = np.where(fail, place + 1, np.where(hit, j + 1, j))
        keep = j < windows[live]
        live, j, at, lo, hi, fresh = live[keep], j[keep], at[keep], lo[keep], hi[keep], fresh[keep]
        if not len(live):
            break
        at = np.where(fresh, begins[live] + j + width - 1, at - 1)
        c = sequences[at]
        b0, b1 = index.begin(c)
        go = np.flatnonzero(~fresh)
        if len(go):
            b0[go], b1[go] = index.extend(c[go], lo[go], hi[go])
        lo, hi = b0, b1
    return out
