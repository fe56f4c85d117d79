"""Suffix arrays of a group of runs, all of it array operations: order, longest common prefixes, nearest smaller values.

A suffix begins at some unit of a run and ends where the run does; runs never continue into each other.
"""

from __future__ import annotations

import numpy as np

from tesserae.llm import common

#: Bytes that the first step packs into one number, nine bits each.
PACKED = 7


class Suffixes:
    """The suffixes of runs that begin at `starts`, in lexicographic order (equal ones by place), and their LCP array.

    order: indices into starts; lcp[i]: units that the i-th suffix in order shares with the one before it (0 for i = 0)."""

    def __init__(self, codes: np.ndarray, first: np.ndarray, starts: np.ndarray):
        self.codes, self.starts = codes, starts
        sizes = np.diff(first)
        self.left = np.repeat(first[1:], sizes) - np.arange(len(codes))  # units up to the end of the run
        self._rank(int(sizes.max(initial=1)))
        own = self.ranks[-1][starts]
        self.order = np.argsort(own, kind="stable")
        self.lcp = np.zeros(len(starts), np.int64)
        at = starts[self.order]
        self.lcp[1:] = self.common_prefix(at[:-1], at[1:])

    def _rank(self, longest: int) -> None:
        """Ranks of all suffixes by their first 1, 3, 9, ... units (7, 21, ... bytes); 0 stands for what lies beyond a run."""
        if self.codes.dtype == np.uint8:
            wide = np.concatenate((self.codes.astype(np.uint64) + np.uint64(1), np.zeros(PACKED, np.uint64)))
            packed = np.zeros(len(self.codes), np.uint64)
            for j in range(PACKED):
                packed = (packed << np.uint64(9)) | np.where(self.left > j, wide[j : j + len(packed)], np.uint64(0))
            rank, span = packed, PACKED
        else:
            rank, span = self.codes, 1
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint32) + np.uint32(1)
        self.ranks, self.spans = [rank], [span]
        self.times = 3 if len(rank) < (1 << 21) - 1 else 2  # ranks that fit into one number
        shift = np.uint64(21 if self.times == 3 else 32)
        while span < longest:
            joined = rank.astype(np.uint64)
            for k in range(1, self.times):
                joined <<= shift
                more = np.flatnonzero(self.left > k * span)
                joined[more] |= rank[more + k * span]
            rank = np.unique(joined, return_inverse=True)[1].astype(np.uint32) + np.uint32(1)
            span *= self.times
            self.ranks.append(rank)
            self.spans.append(span)

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of pairs of suffixes, by descent through the ranks."""
        out = np.zeros(len(a), np.int64)
        room = np.minimum(self.left[a], self.left[b])
        for rank, span in zip(self.ranks[::-1], self.spans[::-1], strict=True):
            for _ in range(self.times - 1):  # once more would have been a match of the longer span
                some = np.flatnonzero(room - out >= span)
                some = some[rank[a[some] + out[some]] == rank[b[some] + out[some]]]
                out[some] += span
        for _ in range(PACKED - 1 if self.spans[0] > 1 else 0):
            some = np.flatnonzero(room > out)
            some = some[self.codes[a[some] + out[some]] == self.codes[b[some] + out[some]]]
            if not len(some):
                break
            out[some] += 1
        return out


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, place) of every suffix of `width` units or more."""
    n = np.maximum(np.diff(first) - width + 1, 0)
    return np.repeat(np.arange(len(n)), n), common.ragged(first[:-1], n)


def minima(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """Minima of every 1, 2, 4, ... consecutive values, up to `longest`."""
    out, span = [x], 1
    while span * 2 <= min(longest, len(x)):
        out.append(np.minimum(out[-1][:-span], out[-1][span:]))
        span *= 2
    return out


def range_min(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the ranges from a to b, b not included; none is empty."""
    level = np.frexp((b - a).astype(float))[1] - 1
    out = np.zeros(len(a), tables[0].dtype)
    for k in np.unique(level).tolist():
        some = level == k
        out[some] = np.minimum(tables[k][a[some]], tables[k][b[some] - (1 << k)])
    return out


def nearest_smaller(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the nearest smaller ones before and after it, no further than its own range from low to high (not
    included); -1 where there is none. Jumps over stretches of values as large halve in length."""
    tables = minima(x, int((high - low).max(initial=1)))
    before, after = np.arange(len(x)), np.arange(len(x)) + 1  # bounds of what is known not to be smaller
    for k in range(len(tables) - 1, -1, -1):
        span, t = 1 << k, tables[k]
        some = np.flatnonzero(before - span >= low)
        some = some[t[before[some] - span] >= x[some]]
        before[some] -= span
        some = np.flatnonzero(after + span <= high)
        some = some[t[after[some]] >= x[some]]
        after[some] += span
    return np.where(before > low, before - 1, -1), np.where(after < high, after, -1)


def deep_nodes(lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree's internal nodes right below `depth`, as ranges of the suffix order: (from, to, their own depth).

    They are the maximal ranges whose neighbours share `depth` units or more."""
    deep = np.concatenate(([False], lcp[1:] >= depth, [False])) if len(lcp) else np.zeros(1, bool)
    begin = np.flatnonzero(deep[1:] & ~deep[:-1])
    end = np.flatnonzero(~deep[1:] & deep[:-1]) + 1
    if not len(begin):
        return begin, end, begin
    inner = np.flatnonzero(deep[:-1])
    return begin, end, np.minimum.reduceat(lcp[inner], np.searchsorted(inner, begin + 1))


def internal_nodes(lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All internal nodes of the suffix tree of at least this depth: (from, to, their own depth)."""
    deep = np.flatnonzero(lcp >= depth)
    if not len(deep):
        return (np.zeros(0, np.int64),) * 3
    n = np.full(len(lcp), len(lcp))
    before, after = nearest_smaller(lcp, np.zeros(len(lcp), np.int64), n)
    nodes = np.unique(np.stack((before[deep], np.where(after[deep] < 0, len(lcp), after[deep]), lcp[deep])), axis=1)
    return nodes[0], nodes[1], nodes[2]
