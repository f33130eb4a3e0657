"""A hierarchical index over 64-bit fingerprints in Gray order, in numpy.

Fingerprints that follow each other by Gray rank differ in few bits. FAN of them make a
node, FAN nodes make a node above, up to the roots; a node holds a mask and a pattern:
the bits that all of its members share and that no node above holds already. A query
goes down from the roots and adds up the differences in each node's bits; where the sum
exceeds the radius, the whole group below is left out. At the bottom the sum is the
Hamming distance itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Members of a node, and queries that go down at once.
FAN, QUERIES = 8, 1 << 13
#: Pairs of a query and a node that are held at once, about.
FRONTIER = 1 << 21
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray code."""
    x = x.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """The index of distinct fingerprints that are sorted by root group, then by Gray rank; a node never spans two root groups."""

    def __init__(self, words: np.ndarray, group: np.ndarray) -> None:
        self.words, self.n = words, len(words)
        #: For each level, from the bottom: masks and patterns of the nodes, first child of each node (and the end).
        masks, values = [np.full(self.n, _ALL)], [words.astype(np.uint64)]
        self.children: list[np.ndarray] = []
        while True:
            n = len(group)
            starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, n))
            if not n or sizes.max() == 1:
                break
            within = np.arange(n) - np.repeat(starts, sizes)
            heads = np.flatnonzero(within % FAN == 0)
            mask, value = masks[-1], values[-1]
            ones, zeros = np.bitwise_and.reduceat(value & mask, heads), np.bitwise_and.reduceat(~value & mask, heads)
            masks.append(ones | zeros)
            values.append(ones)
            self.children.append(np.append(heads, n))
            group = group[heads]
        self.group = group
        # what a node above holds is taken out of the nodes below
        self.masks, self.values = [], values
        for level, mask in enumerate(masks):
            if level < len(self.children):
                first = self.children[level]
                mask = mask & ~np.repeat(masks[level + 1], np.diff(first))
            self.masks.append(mask)

    def _down(self, query: np.ndarray, level: int, node: np.ndarray, spent: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while True:
            spent = spent + np.bitwise_count((self.words[query] ^ self.values[level][node]) & self.masks[level][node])
            near = spent <= radius
            query, node, spent = query[near], node[near], spent[near]
            if not level:
                yield query, node
                return
            if len(query) > FRONTIER // FAN and len(query) > 1:
                half = len(query) // 2
                for part in (slice(half), slice(half, None)):
                    yield from self._children(query[part], level, node[part], spent[part], radius)
                return
            query, level, node, spent = self._step(query, level, node, spent)

    def _step(self, query, level, node, spent):
        first = self.children[level - 1]
        count = first[node + 1] - first[node]
        ends = np.cumsum(count)
        child = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[node] - (ends - count), count)
        return np.repeat(query, count), level - 1, child, np.repeat(spent, count)

    def _children(self, query, level, node, spent, radius):
        query, level, node, spent = self._step(query, level, node, spent)
        yield from self._down(query, level, node, spent, radius)

    def near_pairs(self, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i < j, of fingerprints of one root group that differ in at most `radius` bits; `root` is each one's root."""
        for at in range(0, self.n, QUERIES):
            query = np.arange(at, min(self.n, at + QUERIES))
            for i, j in self._down(query, len(self.children), root[query], np.zeros(len(query), np.int64), radius):
                later = i < j
                yield i[later], j[later]
