"""Voronoi regions of shingle sets around pivots, under the Jaccard distance d.

A set belongs to the region of its nearest pivot, if that is within RADIUS, and else to
the outer region. A linked set is at most REACH away. By the triangle inequality a set
whose nearest pivot is at distance h can only link into the region of another pivot at
h + 2 * REACH or less, and into the outer region only if h is above RADIUS - REACH: it
is replicated there. As RADIUS + 2 * REACH is below 1, all these pivots share a shingle
with the set, so that an index from shingles to pivots finds every distance that counts.
Any two linked sets of a region meet in one of its parts; regions that stay large are
divided again around pivots of their own.

Pivots are taken where many sets share the smallest shingle of an order, and lie APART
from each other: drawn at random, they would be at distance 1 from nearly all sets.
Their number and the sum of their sizes are bounded, which bounds their broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.shingles import mixed

#: Largest distance of a link, and of a set from the pivot of its region.
REACH, RADIUS = 0.2, 0.5
#: Pivots of one round at most, and their shingles in sum; how far pivots of a region are apart.
PIVOTS, PIVOT_SHINGLES, APART = 2048, 1 << 20, 0.9
#: Classes that share the smallest shingle from which on one becomes a pivot; classes of a region that is divided again; rounds.
CROWD, REGION, DEPTH = 8, 1000, 2
#: The region of all sets.
ROOT = 0
#: Bits of the table that tells quickly that a shingle is in no pivot.
_BITS = 24
_SLACK = 1e-9
_U = np.uint64


def part_of(region: int, pivot: int) -> int:
    """The name of a pivot's part of a region; pivot 0 stands for the outer one."""
    return int(mixed(np.array([region & (2**64 - 1)], _U) * _U(0x9E3779B97F4A7C15) + mixed(np.array([pivot & (2**64 - 1)], _U) + _U(1)))[:1].view(np.int64)[0])


class Pivots:
    """The sets of the pivots of some regions, and an index from shingles to them."""

    def __init__(self, names: Sequence[int], regions: Sequence[int], sets: Sequence[np.ndarray]) -> None:
        self.names, self.regions = list(names), list(regions)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        keys = np.concatenate([np.zeros(0, _U), *sets])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
        self.keys, self.heads, self.ends = ranked[heads], heads, np.append(heads[1:], len(ranked))
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.keys >> _U(64 - _BITS)).astype(np.int64)] = True
        self.split = set(self.regions)

    def shared(self, sets: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of sets, of pivots and the shingles that they share, where there are any; by set."""
        every, of = np.concatenate([np.zeros(0, _U), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        maybe = np.flatnonzero(self.seen[(every >> _U(64 - _BITS)).astype(np.int64)])
        every, of = every[maybe], of[maybe]
        at = np.searchsorted(self.keys, every)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == every) if len(self.keys) else np.zeros(0, np.int64)
        at, of = at[hit], of[hit]
        first, n = self.heads[at], self.ends[at] - self.heads[at]
        ends = np.cumsum(n)
        flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)
        pairs, both = np.unique(np.repeat(of, n) * len(self.sizes) + self.owner[flat], return_counts=True)
        return pairs // max(1, len(self.sizes)), pairs % max(1, len(self.sizes)), both

    def divide(self, sets: Sequence[np.ndarray], regions: Sequence[Sequence[tuple[int, float]]]) -> tuple[list[list[tuple[int, float]]], list[list[int]]]:
        """For each set its regions (with the distance from the pivot) after the division, its own one first, and the names of pivots that it links with."""
        rows, pivots, both = self.shared(sets)
        size = np.array([len(s) for s in sets], np.int64)
        either = self.sizes[pivots] + size[rows] - both
        d, links = 1 - both / np.maximum(either, 1), 100 * both >= 80 * either
        at = np.searchsorted(rows, np.arange(len(sets) + 1))
        found, linked = [], []
        for i, own in enumerate(regions):
            part = slice(at[i], at[i + 1])
            near = list(zip(d[part].tolist(), pivots[part].tolist(), strict=True))
            linked.append([self.names[p] for p in pivots[part][links[part]]])
            out: dict[int, float] = {}
            for region, old in own:
                if region not in self.split:
                    out[region] = old
                    continue
                mine = [(x, p) for x, p in near if self.regions[p] == region]
                home, nearest = min(mine) if mine else (1.0, 0)
                if home <= RADIUS:
                    out.setdefault(part_of(region, self.names[nearest]), home)
                    out.update((part_of(region, self.names[p]), x) for x, p in mine if x <= home + 2 * REACH + _SLACK)
                if home > RADIUS - REACH - _SLACK:
                    out[part_of(region, 0)] = 0.0
            found.append(list(out.items()))
        return found, linked


def thin(names: Sequence[int], regions: Sequence[int], sets: Sequence[np.ndarray]) -> list[int]:
    """Places of pivots that are APART from all those kept before them in their region."""
    rows, other, both = Pivots(names, regions, sets).shared(sets)
    size = np.array([len(s) for s in sets], np.int64)
    close = 1 - both / np.maximum(size[rows] + size[other] - both, 1) < APART
    near: dict[int, list[int]] = {}
    for i, j in zip(rows[close].tolist(), other[close].tolist(), strict=True):
        near.setdefault(i, []).append(j)
    kept: set[int] = set()
    for i in range(len(sets)):
        if not any(j in kept and regions[j] == regions[i] for j in near.get(i, ())):
            kept.add(i)
    return sorted(kept)


def candidates(members: DataFrame, orders: int, seed: int) -> list[tuple[int, int]]:
    """(class, region) of possible pivots, the most crowded first: at most PIVOTS, of PIVOT_SHINGLES in sum.

    members: c, n, part, m0, m1, ... and regions (r, d) of every class.
    """
    rows = members.select("c", "n", "part", *(f"m{i}" for i in range(orders)), F.explode("regions.r").alias("region"))
    large = rows.groupBy("region").agg(F.count("*").alias("size"), F.min("part").alias("low"), F.max("part").alias("high")).where((F.col("size") > REGION) & (F.col("low") < F.col("high"))).select("region")
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"m{i}").alias("m")) for i in range(orders)))).alias("first")
    crowds = rows.join(large, "region").select("region", sides, "c", "n", "part").groupBy("region", "first")
    rank = F.xxhash64(F.lit(seed), "c")
    found = crowds.agg(F.count("*").alias("k"), F.min("part").alias("low"), F.max("part").alias("high"), F.min_by("c", rank).alias("c"), F.min_by("n", rank).alias("n"))
    top = found.where((F.col("k") >= CROWD) & (F.col("low") < F.col("high"))).orderBy(F.desc("k"), "c", "region").limit(PIVOTS).collect()
    out: dict[tuple[int, int], int] = {}
    for r in top:
        if (r["c"], r["region"]) not in out and sum(out.values()) + r["n"] <= PIVOT_SHINGLES:
            out[r["c"], r["region"]] = r["n"]
    return list(out)


REGIONS = "array<struct<r: long, d: float>>"


def regions_of(sets: Sequence[np.ndarray], rounds: Sequence[Pivots]) -> tuple[list[list[tuple[int, float]]], list[list[int]]]:
    """The regions of each set after all rounds, and the pivots of the last round that it links with. They follow from the set and the pivots alone, so they are never sent along with a text."""
    regions: list[list[tuple[int, float]]] = [[(ROOT, 0.0)] for _ in sets]
    links: list[list[int]] = [[] for _ in sets]
    for pivots in rounds:
        regions, links = pivots.divide(sets, regions)
    return regions, links


def region_column(found: Sequence[Sequence[tuple[int, float]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("r", pa.int64()), ("d", pa.float32())]))
    return pa.array([[{"r": r, "d": d} for r, d in x] for x in found], kind)
