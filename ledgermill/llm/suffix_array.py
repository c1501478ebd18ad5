"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The induction goes bucket by bucket: whatever the suffixes of one bucket induce
is placed in one step, since it lands in buckets still to come; suffixes that
land in the bucket itself (runs of one character, of any length) are placed in
one step before. So a text takes two steps per character of its alphabet, each
linear.
"""

from __future__ import annotations

import numpy as np

#: Strings are compared together up to so many characters, the longer ones then one by one.
NEAR = 256


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S). The last character is the least and occurs once."""
    ends = np.flatnonzero(np.r_[s[1:] != s[:-1], True])
    smaller = np.r_[s[ends[:-1]] < s[ends[:-1] + 1], True]
    return np.repeat(smaller, np.diff(np.r_[-1, ends]))


def _chained(suffixes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What suffixes of one bucket induce within it: of each, the `before` equal characters to its left, nearest first, and in the order of the suffixes among equally near ones."""
    r = before[suffixes]
    total = int(r.sum())
    if not total:
        return suffixes[:0]
    which = np.repeat(np.arange(len(r)), r)
    step = np.arange(1, total + 1) - np.repeat(np.cumsum(r) - r, r)
    o = np.argsort(step, kind="stable")
    return (suffixes[which[o]] - step[o]).astype(suffixes.dtype)


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from the given order of the leftmost S suffixes. size: of each character's bucket."""
    n, k = len(s), len(size)
    sa = np.full(n, -1, np.int32)
    end = np.cumsum(size)
    begin = end - size
    larges = np.bincount(s[~small], minlength=k)
    starts = np.r_[True, s[1:] != s[:-1]]
    at = np.arange(n, dtype=np.int32)
    before = at - np.maximum.accumulate(np.where(starts, at, 0))  # equal characters to the left
    # The leftmost S suffixes go to the ends of their buckets, in order.
    c = s[lms]
    given = np.bincount(c, minlength=k)
    order = np.argsort(c, kind="stable")
    first = np.cumsum(given) - given
    sa[end[c[order]] - given[c[order]] + (np.arange(len(lms)) - first[c[order]])] = lms[order]
    used = np.flatnonzero(size)
    head = begin.copy()
    for x in used:
        more = _chained(sa[begin[x] : head[x]], before)
        sa[head[x] : head[x] + len(more)] = more
        head[x] += len(more)
        p = np.concatenate([sa[begin[x] : head[x]], sa[end[x] - given[x] : end[x]]])
        p = p[p > 0] - 1
        p = p[s[p] > x]
        if len(p):
            c = s[p]
            o = np.argsort(c, kind="stable")
            c, count = c[o], np.bincount(c, minlength=k)
            sa[head[c] + np.arange(len(c)) - (np.cumsum(count) - count)[c]] = p[o]
            head += count
    tail = end.copy()
    for x in used[::-1]:
        more = _chained(sa[tail[x] : end[x]][::-1], before)
        sa[tail[x] - len(more) : tail[x]] = more[::-1]
        tail[x] -= len(more)
        p = np.concatenate([sa[tail[x] : end[x]][::-1], sa[begin[x] : begin[x] + larges[x]][::-1]])
        p = p[p > 0] - 1
        p = p[s[p] < x]
        if len(p):
            c = s[p]
            o = np.argsort(c, kind="stable")
            c, count = c[o], np.bincount(c, minlength=k)
            sa[tail[c] - 1 - (np.arange(len(c)) - (np.cumsum(count) - count)[c])] = p[o]
            tail -= count
    sa[0] = n - 1  # nothing induces the last character
    return sa


def _ranks_by_doubling(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a text whose alphabet may be as large as itself. Its last name is the least and occurs once."""
    n = len(names)
    order = np.argsort(names, kind="stable").astype(np.int64)
    sorted_names = names[order]
    new = np.r_[True, sorted_names[1:] != sorted_names[:-1]]
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(new)
    rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
    k = 1
    while True:
        # Only suffixes that still tie are sorted again.
        sizes = np.diff(np.r_[start, n])
        tied = np.repeat(sizes > 1, sizes)
        if not tied.any():
            return order
        at = np.flatnonzero(tied)
        idx = order[at]
        after = np.where(idx + k < n, rank[np.minimum(idx + k, n - 1)], -1)
        o = np.argsort(rank[idx] * (n + 1) + after + 1, kind="stable")
        idx, after = idx[o], after[o]
        order[at] = idx
        own = rank[idx]
        fresh = np.r_[True, (own[1:] != own[:-1]) | (after[1:] != after[:-1])]
        new = np.ones(n, bool)
        new[at] = fresh
        start = np.flatnonzero(new)
        rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
        k *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of an array of characters over 0 (small numbers). A least character is put at the end; its suffix is left out of the result."""
    s = np.r_[text.astype(np.uint16) + 1, np.uint16(0)]
    n = len(s)
    if n == 1:
        return np.empty(0, np.int32)
    size = np.bincount(s)
    small = _types(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        sa = _induce(s, small, lms, size)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        # Names: the same for equal substrings from one leftmost S suffix to the next.
        length = np.zeros(n, np.int32)
        length[lms] = np.r_[np.diff(lms) + 1, 1]
        a, b = ordered[:-1], ordered[1:]
        same = length[a] == length[b]
        at, k = np.flatnonzero(same), 0
        while len(at) and k < NEAR:
            x, y = a[at], b[at]
            equal = s[x + k] == s[y + k]
            same[at[~equal]] = False
            k += 1
            at = at[equal & (length[x] > k)]
        for i, x, y in zip(at.tolist(), a[at].tolist(), b[at].tolist(), strict=True):
            same[i] = s[x : x + length[x]].tobytes() == s[y : y + length[x]].tobytes()
        name = np.zeros(n, np.int64)
        name[ordered] = np.cumsum(np.r_[0, ~same])
        names = name[lms]
        lms = lms[_ranks_by_doubling(names)] if len(np.unique(names)) < len(names) else ordered
    return _induce(s, small, lms.astype(np.int32), size)[1:]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix, by ever longer pieces."""
    n, at, piece = min(len(a), len(b)), 0, NEAR
    while at < n:
        x, y = a[at : min(n, at + piece)], b[at : min(n, at + piece)]
        differ = x != y
        if differ.any():
            return at + int(differ.argmax())
        at += len(x)
        piece *= 2
    return n


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the length of its suffix's common prefix with the suffix before it in order (0 for the first).

    Where the characters before both are equal too, it is one less than the position's before; only the others are compared.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    inner = (before > 0) & (at > 0)
    inner[inner] = text[at[inner] - 1] == text[before[inner] - 1]
    start = np.flatnonzero(~inner)
    start = start[before[start] >= 0]
    out = np.zeros(n, np.int64)
    active, k = start, 0
    while len(active) and k < NEAR:
        i, j = active + k, before[active] + k
        ok = (i < n) & (j < n)
        ok[ok] = text[i[ok]] == text[j[ok]]
        active = active[ok]
        k += 1
        out[active] = k
    for i in active.tolist():
        out[i] = k + _common(text[i + k :], text[before[i] + k :])
    own = np.maximum.accumulate(np.where(inner, -1, at))
    return np.maximum(out[own] - (at - own), 0)
