"""Suffix arrays by induced sorting, and permuted common prefixes, over integer arrays.

Suffixes are classified as smaller or larger than their successor; the leftmost smaller ones are sorted by inducing,
their substrings are named, and where names repeat the string of names is sorted by the same function. From the sorted
leftmost smaller suffixes the whole array is induced in two linear sweeps.

A sweep runs over the array in blocks. A block may end only before the first place that one of its own entries fills, so
that all entries of a block are known when it is worked; then its inductions go to their buckets in one numpy step.
"""

from __future__ import annotations

import numpy as np

#: Entries of the array that a sweep tries to work at a time.
LONGEST_BLOCK = 1 << 15


def types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor (true also for the last one, the sentinel)."""
    n = len(t)
    small = np.empty(n, bool)
    small[-1] = True
    step = t[1:] != t[:-1]
    less = np.flatnonzero(step)
    # The next place at or after i where the character changes decides; every place but the sentinel has one.
    ahead = less[np.searchsorted(less, np.arange(n - 1))]
    small[:-1] = t[ahead] < t[ahead + 1]
    return small


def _ranks(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry, how many equal ones precede it; and the distinct values with their counts."""
    order = np.argsort(c, kind="stable")
    s = c[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(s)))
    rank = np.empty(len(s), np.int64)
    rank[order] = np.arange(len(s)) - np.repeat(first, size)
    return rank, s[first], size


def _sweep(sa: np.ndarray, t: np.ndarray, wanted: np.ndarray, place: np.ndarray, step: int) -> None:
    """Induces the predecessors that are wanted, left to right (step 1) from bucket heads or right to left (step -1) from tails.

    place is moved along; sa has -1 where nothing is known.
    """
    n = len(sa)
    at, length = (0, 64) if step > 0 else (n - 1, 64)
    while 0 <= at < n:
        end = min(at + length, n) if step > 0 else max(at - length, -1)
        block = sa[at:end] if step > 0 else sa[end + 1 : at + 1][::-1]
        where = np.flatnonzero(block > 0)
        p = block[where] - 1
        ok = wanted[p]
        where, p = where[ok], p[ok]
        cut = abs(end - at)
        if len(p):
            c = t[p]
            rank, values, size = _ranks(c)
            to = place[c] + step * rank
            ahead = (to - at) * step  # as a distance inside the block
            nearest = int(ahead.min())
            if nearest < cut:
                cut = nearest
                m = int(np.searchsorted(where, cut))
                p, to, c = p[:m], to[:m], c[:m]
                if m:
                    np.add.at(place, c, step)
                length = max(2 * cut, 64)
            else:
                place[values] += step * size
                length = min(2 * length, LONGEST_BLOCK)
            sa[to] = p
        else:
            length = min(2 * length, LONGEST_BLOCK)
        at += step * cut


def _induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array that a given order of the leftmost smaller suffixes leads to."""
    sa = np.full(len(t), -1, np.int64)
    c = t[lms[::-1]]
    rank, _, _ = _ranks(c)
    sa[ends[c] - 1 - rank] = lms[::-1]
    _sweep(sa, t, ~small, starts.copy(), 1)
    # The smaller suffixes are placed anew, from the right.
    filled = sa >= 0
    drop = np.zeros(len(sa), bool)
    drop[filled] = small[sa[filled]]
    drop[0] = False  # the sentinel
    sa[drop] = -1
    _sweep(sa, t, small, ends - 1, -1)
    return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the substrings from one leftmost smaller place to the next, in their order; equal ones share one."""
    length = np.empty(len(t), np.int64)
    length[lms] = np.append(np.diff(lms), 0) + 1
    a, b = order[:-1], order[1:]
    equal = length[a] == length[b]
    live = np.flatnonzero(equal)
    k = 0
    while len(live):
        live = live[length[a[live]] > k]
        same = t[a[live] + k] == t[b[live] + k]
        equal[live[~same]] = False
        live = live[same]
        k += 1
    name = np.concatenate([[0], np.cumsum(~equal)])
    out = np.empty(len(t), np.int64)
    out[order] = name
    return out[lms], int(name[-1]) + 1


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of t in order. t: integers from 0 on whose last one, 0, occurs once."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    count = np.bincount(t)
    ends = np.cumsum(count)
    starts = ends - count
    sa = _induced(t, small, lms, starts, ends)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    names, distinct = _names(t, lms, order)
    if distinct < len(lms):
        order = lms[suffix_array(names)]
    elif distinct == len(lms):
        order = np.empty(len(lms), np.int64)
        order[names] = lms
    return _induced(t, small, order, starts, ends)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted: for each place of t, the common prefix of its suffix and the one before it in the array, up to most. The first suffix has 0.

    Places are compared in text order, eight characters a step.
    """
    n = len(t)
    before = np.full(n, n, np.int64)
    before[sa[1:]] = sa[:-1]
    # A padding that no suffix shares with another: comparisons never run past the end.
    padded = np.concatenate([t.astype(np.int32), -1 - np.arange(most + 8, dtype=np.int32)])
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before < n)
    k = 0
    while len(live) and k < most:
        i, j = live + k, before[live] + k
        run = np.zeros(len(live), np.int64)
        on = np.ones(len(live), bool)
        for s in range(8):
            on &= padded[i + s] == padded[j + s]
            run += on
        out[live] += run
        live = live[run == 8]
        k += 8
    return np.minimum(out, most)
