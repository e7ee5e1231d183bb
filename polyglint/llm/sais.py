"""Suffix arrays by induced sorting, in whole-array steps.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; leftmost-smaller (LMS) suffixes start a
run of S. LMS substrings are sorted by one induction and named; if names repeat, the string of names, a third as long or
less, is sorted recursively (here by doubling ranks, as its alphabet is too large for buckets); a second induction from
the sorted LMS suffixes gives the whole array in linear time. A bucket is induced in rounds: all of its known suffixes
give their left neighbours at once, and those that fall into the same bucket make up the next round.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is S; the last one, a sentinel, is."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    nxt = np.full(n, n - 1)
    nxt[differs] = differs
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]  # the next place whose right neighbour differs
    s = np.ones(n, bool)
    inner = nxt < n - 1
    s[inner] = t[nxt[inner]] < t[nxt[inner] + 1]
    return s


class _Buckets:
    def __init__(self, size: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(size)]

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for k, part in zip(keys[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
            self.parts[k].append(part)

    def take(self, k: int) -> np.ndarray:
        part, self.parts[k] = self.parts[k], []
        return np.concatenate(part) if part else np.zeros(0, np.int64)


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that the order of the LMS suffixes induces."""
    keys = t.astype(np.uint16)
    starts, larger, smaller = _Buckets(size), _Buckets(size), _Buckets(size)
    starts.add(keys[lms], lms)
    ls: list[np.ndarray] = []
    for c in range(size):
        done = []
        new = larger.take(c)
        while len(new):
            done.append(new)
            left = new[new > 0] - 1
            left = left[~s[left]]
            same = t[left] == c
            larger.add(keys[left[~same]], left[~same])
            new = left[same]
        ls.append(np.concatenate(done) if done else np.zeros(0, np.int64))
        own = starts.take(c)
        left = own[own > 0] - 1
        left = left[~s[left]]
        larger.add(keys[left], left)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * size
    for c in range(size - 1, -1, -1):
        done = []
        new = smaller.take(c)  # from the bucket's end towards its start
        if c == 0:
            new = np.array([len(t) - 1])
        while len(new):
            done.append(new)
            left = new[new > 0] - 1
            left = left[s[left]]
            same = t[left] == c
            smaller.add(keys[left[~same]], left[~same])
            new = left[same]
        down = ls[c][::-1]
        left = down[down > 0] - 1
        left = left[s[left]]
        smaller.add(keys[left], left)
        out[c] = np.concatenate([ls[c], *[x[::-1] for x in reversed(done)]])
    return np.concatenate(out)


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of LMS substrings that are given in sorted order; equal ones share a name. By text place of lms."""
    end = np.append(lms[1:], lms[-1])
    length = np.zeros(len(t), np.int64)
    length[lms] = end - lms + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    open_ = np.flatnonzero(same)
    step = 0
    while len(open_):
        more = step < length[a[open_]]
        open_ = open_[more]
        if not len(open_):
            break
        equal = t[a[open_] + step] == t[b[open_] + step]
        same[open_[~equal]] = False
        open_ = open_[equal]
        step += 1
    rank = np.concatenate([[0], np.cumsum(~same)])
    by_place = np.zeros(len(t), np.int64)
    by_place[order] = rank
    return by_place[lms]


def _double(names: np.ndarray, depth: int) -> np.ndarray:
    """Places in suffix order: by doubling the compared length until ranks differ, or depth names are compared."""
    rank, k, n = names.astype(np.int64), 1, len(names)
    order = np.argsort(rank)
    while k < depth and k < n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        k *= 2
    return order


def suffix_array(t: np.ndarray, size: int, depth: int = 1 << 62) -> np.ndarray:
    """t: integers in 1..size-1 before a last 0. Suffixes that agree on the first depth characters may stand in any order."""
    t = np.asarray(t, np.int64)
    if len(t) == 1:
        return np.zeros(1, np.int64)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if not len(lms):
        lms = np.array([len(t) - 1])
    first = _induce(t, s, lms, size)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    names = _names(t, lms, order)
    if len(names) > 1 and names.max() < len(names) - 1:
        order = lms[_double(names, depth)]
    return _induce(t, s, order, size)


def _packed(t: np.ndarray, beyond: int) -> np.ndarray:
    """At each place, four characters from there on in 16 bits each, the first one lowest."""
    x = np.concatenate([t.astype(np.uint64), np.full(3, beyond, np.uint64)])
    n = len(t)
    return x[:n] | x[1 : n + 1] << np.uint64(16) | x[2 : n + 2] << np.uint64(32) | x[3 : n + 3] << np.uint64(48)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted: by text place, the common prefix with the suffix before it in the array, up to `most`.

    Known lengths bound their right neighbours' (PLCP[i + 1] >= PLCP[i] - 1): places are done in strides, and each
    starts from what the nearest done place on its left leaves over. Four characters are compared at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    # behind the text the two sides differ
    here = np.concatenate([_packed(t, 0xFFFF), np.full(most + 4, (1 << 64) - 1, np.uint64)])
    there = np.concatenate([_packed(t, 0xFFFE), np.full(most + 4, (1 << 64) - 2, np.uint64)])
    low = np.uint64(0xFFFF)
    for stride, from_ in ((16, None), (4, 16), (1, 4)):
        places = np.arange(0, n, stride)
        if from_:
            places = places[places % from_ != 0]
            known = np.maximum(out[places - places % from_] - places % from_, 0)
        else:
            known = np.zeros(len(places), np.int64)
        other = before[places]
        has = other >= 0
        places, other, known = places[has], other[has], known[has]
        while len(places):
            x = here[places + known] ^ there[other + known]
            same = x == 0
            stop = ~same
            d = x[stop]
            more = ((d & low) == 0).astype(np.int64)
            more += more * ((d >> np.uint64(16) & low) == 0)
            more += (more == 2) * ((d >> np.uint64(32) & low) == 0)
            out[places[stop]] = np.minimum(known[stop] + more, most)
            places, other, known = places[same], other[same], known[same] + 4
            full = known >= most
            if full.any():
                out[places[full]] = most
                places, other, known = places[~full], other[~full], known[~full]
    return out
