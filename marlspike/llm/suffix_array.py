"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classified as smaller (S) or larger (L) than their successor. Substrings
between leftmost S suffixes are sorted by induction and named; the string of names is
sorted by recursion; the order of those suffixes then induces that of all others.

Induction goes by sections instead of single suffixes. A suffix belongs to the
section of its first character, its successor's first character and its successor's
type; sections lie in suffix order, and the order within one is that of the
successors. So whole buckets whose sources are complete are filled at once.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """True for S suffixes. ``s`` ends with a character smaller than all others."""
    n = len(s)
    up = np.zeros(n, bool)
    up[:-1] = s[:-1] < s[1:]
    differs = np.ones(n, bool)
    differs[:-1] = s[:-1] != s[1:]
    at = np.where(differs, np.arange(n), n)
    decides = np.minimum.accumulate(at[::-1])[::-1]
    up[-1] = True
    return up[decides]


class _Sections:
    """Sections of all suffixes of one type: where each begins, and how far it is filled."""

    def __init__(self, s: np.ndarray, small: np.ndarray, of_small: bool):
        n = len(s)
        pos = np.flatnonzero(small[:-1] if of_small else ~small[:-1])
        sigma = int(s.max()) + 1
        key = (s[pos].astype(np.int64) * sigma + s[pos + 1]) * 2 + small[pos + 1]
        self.keys, number, self.counts = np.unique(key, return_inverse=True, return_counts=True)
        self.number = np.full(n, -1, np.int64)
        self.number[pos] = number
        self.starts = np.cumsum(self.counts) - self.counts
        self.order = np.zeros(len(pos), np.int64)
        self.first = self.keys // (2 * sigma)
        second = self.keys // 2 % sigma
        self.same_type = (self.keys % 2 == 1) == of_small
        self.own = self.same_type & (second == self.first)
        self.bucket_of, self.bucket_starts = np.unique(self.first, return_index=True)
        self.bucket = np.repeat(np.arange(len(self.bucket_of)), np.diff(np.append(self.bucket_starts, len(self.keys))))
        outer = self.same_type & ~self.own
        self.waits = np.bincount(self.bucket, weights=np.where(outer, self.counts, 0), minlength=len(self.bucket_of)).astype(np.int64)
        self.filled = np.zeros(len(self.keys), np.int64)
        self.of_small = of_small

    def put(self, pos: np.ndarray) -> np.ndarray:
        """Append suffixes, given in the order of their successors, to their sections; returns the sections."""
        number = self.number[pos]
        by = np.argsort(number, kind="stable")
        number, pos = number[by], pos[by]
        new = np.ones(len(number), bool)
        new[1:] = number[1:] != number[:-1]
        heads = np.flatnonzero(new)
        lengths = np.diff(np.append(heads, len(number)))
        rank = np.arange(len(number)) - np.repeat(heads, lengths)
        sections = number[heads]
        at = self.starts[sections] + self.filled[sections]
        if self.of_small:
            # of one bucket's suffixes, those found later begin with a longer run and are smaller
            back = self.starts[sections] + self.counts[sections] - self.filled[sections] - lengths
            at = np.where(self.same_type[sections], back, at)
        self.order[np.repeat(at, lengths) + rank] = pos
        self.filled[sections] += lengths
        return np.stack((sections, lengths))

    def fill(self, seeds: np.ndarray) -> np.ndarray:
        """The sorted suffixes of this type, from those of the other type in order."""
        before = seeds[seeds > 0] - 1
        before = before[self.number[before] >= 0]
        if len(before):
            self.put(before)
        ready = np.flatnonzero(self.waits == 0)
        section_stops = np.append(self.bucket_starts, len(self.keys))
        while len(ready):
            first, last = section_stops[ready], section_stops[ready + 1]
            if self.of_small:
                first = first + self.own[first]
            else:
                last = last - self.own[last - 1]
            low = np.append(self.starts, len(self.order))[first]
            length = np.append(self.starts, len(self.order))[last] - low
            total = int(length.sum())
            front = self.order[np.repeat(low - (np.cumsum(length) - length), length) + np.arange(total)]
            touched = []
            while len(front):
                before = front[front > 0] - 1
                before = before[self.number[before] >= 0]
                if not len(before):
                    break
                sections, lengths = self.put(before)
                outer = ~self.own[sections]
                buckets = self.bucket[sections[outer]]
                if len(buckets):
                    np.subtract.at(self.waits, buckets, lengths[outer])
                    touched.append(buckets)
                front = before[self.own[self.number[before]]]
            ready = np.unique(np.concatenate(touched)) if touched else np.zeros(0, np.int64)
            ready = ready[self.waits[ready] == 0]
        return self.order


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L suffixes and S suffixes in order, from the leftmost S suffixes in order."""
    large = _Sections(s, small, False).fill(seeds)
    return large, _Sections(s, small, True).fill(large)


def _merge(s: np.ndarray, large: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Of each first character, its L suffixes and then its S suffixes; the last suffix comes first."""
    both = np.concatenate(([len(s) - 1], large, rest))
    return both[np.argsort(s[both], kind="stable")]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``s`` in order. ``s`` holds integers from 0 and ends with its only 0."""
    n = len(s)
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    small = classify(s)
    leftmost = np.zeros(n, bool)
    leftmost[1:] = small[1:] & ~small[:-1]
    text_order = np.flatnonzero(leftmost)
    if len(text_order) > 1:
        _, rest = _induce(s, small, text_order[np.argsort(s[text_order], kind="stable")])
        ranked = np.concatenate(([n - 1], rest[leftmost[rest]]))
        names = _name(s, ranked, text_order)
        if names.max() + 1 < len(names):
            text_order = text_order[suffix_array(names)]
        else:
            text_order = ranked
    large, rest = _induce(s, small, text_order)
    return _merge(s, large, rest)


def _name(s: np.ndarray, ranked: np.ndarray, text_order: np.ndarray) -> np.ndarray:
    """The rank of each substring from one leftmost S suffix to the next, in text order; equal ones share it."""
    stop = np.zeros(len(s), np.int64)
    stop[text_order[:-1]] = text_order[1:] + 1
    stop[text_order[-1]] = text_order[-1] + 1
    length = stop[ranked] - ranked
    same = np.zeros(len(ranked), bool)
    same[1:] = length[1:] == length[:-1]
    k = np.flatnonzero(same)
    if len(k):
        n = length[k]
        heads = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(heads, n)
        differs = s[np.repeat(ranked[k], n) + step] != s[np.repeat(ranked[k - 1], n) + step]
        same[k] = ~np.logical_or.reduceat(differs, heads)
    names = np.zeros(len(s), np.int64)
    names[ranked] = np.cumsum(~same) - 1
    return names[text_order]


def permuted_prefixes(s: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each suffix in text order, how much it shares with the one before it in suffix order, up to ``limit``.

    A value is one less than its left neighbour's where both suffixes extend to the left
    by the same character; only the others are found by comparing.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    plain = np.ones(n, bool)
    inner = np.flatnonzero(before[1:] > 0) + 1
    plain[inner] = (s[inner - 1] != s[before[inner] - 1]) | (before[inner - 1] != before[inner] - 1)
    shared = np.zeros(n, np.int64)
    k = np.flatnonzero(plain & (before >= 0))
    padded = np.concatenate((s, np.full(8, -1, s.dtype)))
    open_, a, b, done = k, k, before[k], 0
    # the full lengths are needed where neighbours count down from them
    while len(open_):
        ok = (a + done < n) & (b + done < n)
        same = np.zeros(len(open_), bool)
        same[ok] = padded[a[ok] + done] == padded[b[ok] + done]
        shared[open_[~same]] = done
        open_, a, b = open_[same], a[same], b[same]
        done += 1
        if done >= 4 * limit:
            shared[open_] = done
            break
    last = np.maximum.accumulate(np.where(plain, np.arange(n), 0))
    return np.minimum(np.maximum(shared[last] - (np.arange(n) - last), 0), limit)
