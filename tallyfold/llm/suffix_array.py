"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as S or L type; the leftmost S-type (LMS) substrings are sorted
by one induction and named, and the shortened string of names is sorted by doubling, which
looks again only at names that tie: a name that occurs once already tells its suffix
apart. Induction is done bucket by bucket: what a bucket's suffixes induce is one vector
operation, and runs of one symbol inside a bucket take one more for each symbol of the run.
"""

from __future__ import annotations

import numpy as np


def s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end of the text is smaller than any byte."""
    n = len(t)
    if not n:
        return np.zeros(0, bool)
    rises = np.zeros(n, np.int8)
    rises[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    rises[-1] = -1
    at = np.where(rises != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return rises[nearest] > 0


def words(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; zeros follow the text."""
    padded = np.concatenate((t, np.zeros(16, t.dtype)))
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), (len(t) + 8,), (t.itemsize,), writeable=False)


def equal_symbols(w: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, width: int = 1) -> np.ndarray:
    """Equal symbols of `width` bytes from the places a and b on, up to the end of the text."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    most = n - np.maximum(a, b)
    step, shift = 0, 2 + width  # 8 bits in a byte, one or two bytes in a symbol
    while len(live):
        x = w[a[live] + step] ^ w[b[live] + step]
        same = x == 0
        x = x[~same]
        out[live[~same]] = step + (np.log2((x & (~x + np.uint64(1))).astype(np.float64)).astype(np.int64) >> shift)
        live = live[same]
        step += 8 // width
        ended = step >= most[live]
        out[live[ended]] = most[live[ended]]
        live = live[~ended]
    return np.minimum(out, most)


class _Buckets:
    """The suffixes of one text by their first symbol, which is below `size`."""

    def __init__(self, t: np.ndarray, size: int) -> None:
        self.t, self.n, self.size, self.s = t, len(t), size, s_types(t)
        counts = np.bincount(t, minlength=size)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.symbols = np.flatnonzero(counts)
        before = np.zeros(self.n, bool)
        before[1:] = ~self.s[:-1]
        self.lms = np.flatnonzero(self.s & before).astype(np.int32)

    def _deal(self, sa: np.ndarray, j: np.ndarray, heads: np.ndarray, way: int) -> None:
        """Append the suffixes j, in their order, to their buckets: rightwards from heads (way 1) or leftwards (-1)."""
        first = self.t[j]
        order = np.argsort(first, kind="stable")
        first = first[order]
        counts = np.bincount(first, minlength=self.size)
        rank = np.arange(len(j)) - (np.cumsum(counts) - counts)[first]
        sa[heads[first] + rank if way > 0 else heads[first] - 1 - rank] = j[order]
        heads += way * counts

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, sorted from LMS suffixes in sorted order."""
        t, s, sa = self.t, self.s, np.full(self.n, -1, np.int32)
        firsts = t[lms]
        counts = np.bincount(firsts, minlength=self.size)
        lms_ends = np.cumsum(counts)
        grouped = lms[np.argsort(firsts, kind="stable")]
        heads = self.starts.copy()
        self._deal(sa, np.array([self.n - 1], np.int32), heads, 1)
        for c in self.symbols:
            low = self.starts[c]
            while low < heads[c]:
                low, part = heads[c], sa[low : heads[c]]
                j = part[part > 0] - 1
                self._deal(sa, j[~s[j]], heads, 1)
            self._deal(sa, grouped[lms_ends[c] - counts[c] : lms_ends[c]] - 1, heads, 1)
        large_ends, heads = heads, self.ends.copy()
        for c in self.symbols[::-1]:
            high = self.ends[c]
            while high > heads[c]:
                high, part = heads[c], sa[heads[c] : high][::-1]
                j = part[part > 0] - 1
                self._deal(sa, j[s[j]], heads, -1)
            part = sa[self.starts[c] : large_ends[c]][::-1]
            j = part[part > 0] - 1
            self._deal(sa, j[s[j]], heads, -1)
        return sa


def _order_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the string of LMS names, by doubling: a rank is that of a suffix's first `step` names, and only tied ones are sorted again."""
    n = len(names)
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]
    live, step = np.flatnonzero(counts[names] > 1), 1
    while len(live):
        after = live + step
        key = rank[live] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key)
        live, key = live[order], key[order]
        old, at = rank[live], np.arange(len(live))
        new, group = np.ones(len(live), bool), np.ones(len(live), bool)
        new[1:], group[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
        rank[live] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        live = live[~(new & np.append(new[1:], True))]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(t: np.ndarray, size: int = 256, joined: bool = False) -> np.ndarray:
    """Places of the suffixes of t, bytes or 16-bit symbols below `size`, in ascending order; an end is smaller than any symbol.

    joined: t holds texts with a 0 behind each and none inside, and what follows a 0 does
    not count: suffixes that are equal up to their 0 come in any order.
    """
    if len(t) < 2:
        return np.arange(len(t), dtype=np.int32)
    b = _Buckets(t, size)
    lms = b.lms
    if len(lms) > 1:
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        guess = b.induce(lms)
        guess = guess[is_lms[guess]]  # LMS substrings, sorted
        length = np.zeros(len(t), np.int64)
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = len(t) + 1 - lms[-1]  # it takes in the end, as no other does
        a, c = guess[:-1].astype(np.int64), guess[1:].astype(np.int64)
        same = length[a] == length[c]
        if joined:  # an LMS substring that takes in a 0 (each 0 is an LMS place) needs no further order
            last = np.zeros(len(t), bool)
            last[lms] = (t[lms] == 0) | (t[np.append(lms[1:], len(t) - 1)] == 0)
            same &= ~last[a]
        same[same] = equal_symbols(words(t), len(t), a[same], c[same], t.itemsize) >= length[a[same]]
        names = np.zeros(len(t), np.int64)
        names[guess] = np.concatenate(([0], np.cumsum(~same)))
        lms = lms[_order_names(names[lms])] if same.any() else guess
    return b.induce(lms)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place the symbols its suffix shares with the one before it in the array.

    A place whose left neighbour also matches its partner's has one symbol less than that
    neighbour; only the others are compared.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    phi = np.zeros(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    first = sa[0]
    alone = np.ones(n, bool)
    at = np.arange(1, n)
    alone[1:] = (phi[1:] == 0) | (t[:-1] != t[phi[1:] - 1])
    # the neighbour's partner must be this partner's neighbour, or its own value says nothing about this one
    alone[1:] |= phi[at - 1] != phi[at] - 1
    alone[first] = True
    if first + 1 < n:
        alone[first + 1] = True
    places = np.flatnonzero(alone)
    found = equal_symbols(words(t), n, places, phi[places], t.itemsize)
    found[places == first] = 0
    last = np.maximum.accumulate(np.where(alone, np.arange(n), 0))
    value = np.zeros(n, np.int64)
    value[places] = found
    return np.maximum(value[last] - (np.arange(n) - last), 0)
