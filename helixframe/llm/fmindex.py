"""An FM-index over a sequence of small integers, in numpy.

0 separates: every 0 counts as a symbol of its own, so no match and no comparison of suffixes crosses one. Ranks come
from a wavelet matrix. Suffix positions are kept for every eighth place and for the start of each run, so that a walk
back from any other place meets one before it meets a 0.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; after the first sort only suffixes that still tie are sorted. The last symbol must be 0."""
    n, zero = len(seq), seq == 0
    zeros = int(zero.sum())
    key = np.where(zero, np.cumsum(zero) - 1, zeros + seq.astype(np.int64))
    order = np.argsort(key, kind="stable")
    starts = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    size, tied = 1, np.flatnonzero(~(starts & np.concatenate([starts[1:], [True]])))
    while len(tied):
        at = order[tied]
        key = rank[at] * n + rank[at + size]
        by = np.argsort(key, kind="stable")
        order[tied], key = at[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        size *= 2
    return order


class FMIndex:
    """find() gives the places of patterns in `seq`; symbols are 0 <= s < n_symbols."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        sa = suffix_array(seq)
        bwt = seq[sa - 1].astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))])
        keep = (sa % SAMPLE == 0) | (bwt == 0)
        self.kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])
        self.places = sa[keep].astype(np.int32)
        self.levels = []
        for bit in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]), len(bwt) - int(ones.sum())))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])

    def _rank(self, symbols: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each place."""
        start, at = np.zeros(len(symbols), np.int64), list(at)
        for bit, ones, zeros in self.levels:
            up = (symbols >> bit & 1).astype(bool)
            move = lambda x, up=up, ones=ones, zeros=zeros: np.where(up, zeros + ones[x], x - ones[x])
            start, at = move(start), [move(x) for x in at]
        return [x - start for x in at]

    def _symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for bit, ones, zeros in self.levels:
            up = ones[at + 1] > ones[at]
            out |= up.astype(np.int64) << bit
            at = np.where(up, zeros + ones[at], at - ones[at])
        return out

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of patterns of one length: (pattern, first row, row after the last) of those that occur."""
        which = np.arange(len(patterns))
        lo, hi = self.first[patterns[:, -1]], self.first[patterns[:, -1] + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            alive = hi > lo
            which, lo, hi = which[alive], lo[alive], hi[alive]
            if not len(which):
                break
            c = patterns[which, k].astype(np.int64)
            lo, hi = self._rank(c, lo, hi)
            lo, hi = self.first[c] + lo, self.first[c] + hi
        alive = hi > lo
        return which[alive], lo[alive], hi[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence of each row of the index."""
        out, todo, rows, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.kept[rows + 1] > self.kept[rows]
            out[todo[hit]] = self.places[self.kept[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            c = self._symbol(rows)
            rows, steps = self.first[c] + self._rank(c, rows)[0], steps + 1
        return out

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, place) of every occurrence of patterns of one length."""
        which, lo, hi = self.ranges(patterns)
        n = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)
        return np.repeat(which, n), self.locate(rows)
