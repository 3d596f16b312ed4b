"""Suffix arrays by prefix doubling, vectorised."""

from __future__ import annotations

import numpy as np


def suffix_array(words: np.ndarray, doc: np.ndarray, keep_levels: bool = False):
    """Suffix array of ``words`` and, where wanted, the ranks by the first 1, 2, 4, ... words.

    ``doc`` is the non-decreasing document of each word; suffixes end with their document, and the
    suffixes of a document stand before those of the next.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64), []
    end = np.searchsorted(doc, doc, side="right")
    _, rank, size = np.unique(doc.astype(np.int64) * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    # a rank is the number of smaller suffixes, so that a class keeps room for its members
    rank = (np.cumsum(size) - size)[rank]
    small = np.int32 if n < 1 << 31 else np.int64
    levels, width = [rank.astype(small)] if keep_levels else [], 1
    while True:
        left = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(left):
            break
        nxt = left + width
        second = np.where(nxt < end[left], rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[left] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key, first = key[order], rank[left][order]
        at = np.arange(len(left))
        group = np.maximum.accumulate(np.where(np.append(True, first[1:] != first[:-1]), at, 0))
        here = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), at, 0))
        rank = rank.copy()
        rank[left[order]] = first + here - group
        if keep_levels:
            levels.append(rank.astype(small))
        width *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, levels


def suffix_lcp(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and the common prefix of each entry with the one before; entries of different
    documents share nothing. Common prefixes are read off the doubling ranks from the top down."""
    sa, levels = suffix_array(words, doc, keep_levels=True)
    n = len(words)
    if n == 0:
        return sa, sa
    end = np.searchsorted(doc, doc, side="right")
    lcp = np.zeros(n, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    total = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r = levels[level]
        ok = (a < end[sa[:-1]]) & (b < end[sa[1:]])
        same = ok & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
        step = same.astype(np.int64) << level
        total += step
        a += step
        b += step
    lcp[1:] = total
    return sa, lcp
