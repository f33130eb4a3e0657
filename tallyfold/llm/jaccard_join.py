"""N-gram Jaccard join in the metric space of shingle sets, exactly.

Two documents link when 100 * intersection >= 80 * union of their sets of five-word
shingles: a Jaccard distance of at most 0.2, which is a metric. Equal sets are one class.

First every crowd of classes that share the smallest shingle of an order is compared with
one of its members, which gathers whole groups of near copies in one component with a
number of comparisons linear in them. Then pivots create Voronoi regions (`voronoi.py`): a class goes to the region of its nearest
pivot, or to the outer region, and is replicated into all others that the triangle
inequality does not exclude; links with pivots are found on the way. Regions that stay
large and hold crowds of several components are divided again around pivots of their own.

Each region then joins by itself and exactly. Let a set's boundary be its first
n // 5 + 1 shingles in one global order: of linked sets neither has more than n // 5
shingles that the other lacks, so both hold a common shingle in their boundaries.
Shingles of very many boundaries come last in the order. Classes of one region meet
under such a shingle if they are of different components and within the windows of the
triangle inequality: on their distances from the region's pivot, on the sizes, on the
shingles that both boundaries hold, and on the counts in 256 shingle classes, which
bound the symmetric difference from below. What is left is compared exactly. The
components are those of all links.

Cases: null texts and texts without words have empty sets and link with nothing;
repeated rows are copies; a null doc_id counts as the largest; an empty table gives an
empty result; further columns are kept by `one_of_each`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import voronoi
from tallyfold.llm.common import cut, discard, groups_for, map_arrow, narrow, release, small_batches, text_bytes
from tallyfold.llm.components import joined
from tallyfold.llm.shingles import mixed, shingle_sets

#: Least similarity in hundredths.
SIMILAR = 80
#: Orders of the shingles under which crowds are sought, and rounds in which they are compared with one member.
ORDERS, ROUNDS = 4, 3
#: Fixed masks of the orders.
MASKS = tuple(np.uint64(m) for m in (0, 0x1234567890ABCDEF, 0x5BD1E9955BD1E995, 0xA7D4EB2F165667C5))
#: A shingle of more classes than this is common; and common ones are at most so many, which bounds their broadcast.
COMMON, MOST_COMMON = 8, 1 << 24
#: Shingle classes whose counts bound the symmetric difference.
CLASSES = 256
#: Classes that one copy of a pivot is compared with; pairs of one group of comparisons; input bytes of a shard.
PER_PIVOT, PER_GROUP, SHARD_BYTES = 200, 2000, 8 << 20
#: Classes under one shingle up to which all their pairs are looked at in one vector operation.
SMALL_REGION = 64
#: How far the distances of linked sets from one pivot differ at most, with room for rounding.
WINDOW = voronoi.REACH + 1e-5
#: 64-bit names that several classes may share; random names of 10^10 classes share about three.
CLASHES = 10_000
_LAST = (1 << 63) - 1
_NARROW = "ord long, n int, c long, c2 long, " + ", ".join(f"m{k} long" for k in range(ORDERS)) + ", counts binary, t long, t2 long"
_U = np.uint64


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set."""
    if not len(s):
        return 0, 0
    return tuple(int(x) for x in np.array([np.add.reduce(mixed(s + _U(1))), np.bitwise_xor.reduce(mixed(s ^ _U(0x5851F42D4C957F2D)))]).view(np.int64))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets are similar enough."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)) or not len(a):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def _read(docs: DataFrame) -> DataFrame:
    """Per row the size and name of its set, its first shingle in each order, its counts in CLASSES classes, and a hash t of its text."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(text_bytes(batch.column("text")))
        names = [fingerprint(s) for s in sets]
        firsts = [pa.array(np.array([(s ^ m).min() if len(s) else 0 for s in sets], np.uint64).view(np.int64)) for m in MASKS]
        counts = [_counts(s).tobytes() for s in sets]
        columns = [batch.column("ord"), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(x, pa.int64()) for x in zip(*names, strict=True)), *firsts, pa.array(counts, pa.binary()), batch.column("t"), batch.column("t2")]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _NARROW.split(", ")])

    return map_arrow(_ordered(docs), each, _NARROW)


def _ordered(docs: DataFrame, *columns: str) -> DataFrame:
    """ord (the id, null last), the text and its two hashes: together they name a row, but for repeated ones."""
    text = F.col("text").cast("string")
    return docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"), text.alias("text"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("t2"))


def _verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link; texts: c and text of every class. Many a may share one b."""
    pairs = cut(pairs)
    n = pairs.count()
    if not n:
        return pairs.select("a", "b")
    heavy = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_PIVOT).alias("parts")).where("parts > 1")
    groups = max(8, n // PER_GROUP)
    dealt = pairs.join(narrow(heavy), "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))))
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("b", "part"), F.lit(groups)))
    roles = dealt.select("group", F.col("a").alias("c"), "b").unionByName(dealt.select("group", F.col("b").alias("c"), "b").distinct())
    met = texts.join(narrow(cut(roles)), "c").select("group", "c", "b", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("b", "ascending"), ("c", "ascending")])
        names, pivots, found = table["c"].to_pylist(), table["b"].to_pylist(), set()
        sets = shingle_sets(text_bytes(table["text"]))
        own = {b: s for b, c, s in zip(pivots, names, sets, strict=True) if b == c}
        for b, c, s in zip(pivots, names, sets, strict=True):
            if c != b and b in own and linked(s, own[b]):
                found.add((c, b))
        rows = sorted(found)
        return pa.table({"a": pa.array([x for x, _ in rows], pa.int64()), "b": pa.array([x for _, x in rows], pa.int64())})

    out = cut(met.groupBy("group").applyInArrow(run, "a long, b long"))
    discard(pairs)
    return out


def _labelled(classes: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The classes with the component of each under the links so far."""
    classes = classes.drop("part")
    if parts is None:
        return classes.withColumn("part", F.col("c"))
    return classes.join(narrow(parts), F.col("c") == F.col("node"), "left").withColumn("part", F.coalesce("component", "c")).drop("node", "component")


def _crowds(classes: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of classes with one member of each of their crowds, where a crowd is of several components."""
    orders = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"m{i}").alias("m")) for i in range(ORDERS)))).alias("crowd")
    members = classes.select("c", "n", "part", orders)
    first = F.struct(F.xxhash64(F.lit(k), "c").alias("rank"), "c", "n", "part")
    heads = members.groupBy("crowd").agg(F.min(first).alias("p"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    heads = cut(heads.select("crowd", F.col("p.c").alias("b"), F.col("p.n").alias("nb"), F.col("p.part").alias("pb")))
    met = members.join(narrow(heads), "crowd").where("part <> pb and 5 * least(n, nb) >= 4 * greatest(n, nb)")
    return met.select(F.col("c").alias("a"), "b").distinct()


def _pivots(texts: DataFrame, members: DataFrame, seed: int) -> voronoi.Pivots | None:
    """Pivots of the regions that are divided next, or None. What comes to the driver is bounded by voronoi.PIVOTS and PIVOT_SHINGLES."""
    chosen = voronoi.candidates(members, ORDERS, seed)
    if not chosen:
        return None
    names = texts.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(c for c, _ in chosen)], "c long")

    def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "keys"])

    found = map_arrow(texts.join(F.broadcast(names), "c").select("text", "c"), send, "c long, keys binary").dropDuplicates(["c"]).collect()
    sets = {r["c"]: np.frombuffer(r["keys"], np.uint64) for r in found}
    kept = voronoi.thin([c for c, _ in chosen], [r for _, r in chosen], [sets[c] for c, _ in chosen])
    return voronoi.Pivots([chosen[i][0] for i in kept], [chosen[i][1] for i in kept], [sets[chosen[i][0]] for i in kept])


def _divided(texts: DataFrame, rounds: list[voronoi.Pivots]) -> tuple[DataFrame, DataFrame]:
    """The regions of all classes, and the links (a, b) with the pivots of the last round."""
    held = texts.sparkSession.sparkContext.broadcast(rounds)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        regions, links = voronoi.regions_of(shingle_sets(text_bytes(batch.column("text"))), held.value)
        yield pa.RecordBatch.from_arrays([batch.column("c"), voronoi.region_column(regions), pa.array(links, pa.list_(pa.int64()))], names=["c", "regions", "near"])

    found = cut(map_arrow(texts.select("text", "c"), each, f"c long, regions {voronoi.REGIONS}, near array<long>"))
    return found.select("c", "regions").dropDuplicates(["c"]), cut(found.select(F.col("c").alias("a"), F.explode("near").alias("b")).where("a <> b"))


def _codes(keys: np.ndarray, shards: int) -> np.ndarray:
    """A shingle's shard and 40 bits of its hash. Two shingles of one code are common or not together, so the order stays one order."""
    m = mixed(keys)
    return ((m % _U(shards)) << _U(40)) | (m >> _U(24))


def _is_common(keys: np.ndarray, common: np.ndarray, shards: int) -> np.ndarray:
    if not len(common) or not len(keys):
        return np.zeros(len(keys), bool)
    codes = _codes(keys, shards)
    return common[np.minimum(np.searchsorted(common, codes), len(common) - 1)] == codes


def _boundary(s: np.ndarray, common: np.ndarray, shards: int) -> np.ndarray:
    """The first n // 5 + 1 shingles; common ones come last."""
    n = len(s) // 5 + 1
    is_common = _is_common(s, common, shards)
    return np.concatenate((s[~is_common], s[is_common]))[:n] if is_common.any() else s[:n]


def _more_than(least: int):
    def run(table: pa.Table) -> pa.Table:
        raw = np.concatenate([np.frombuffer(b, np.uint8).reshape(-1, 5) for b in table["codes"].to_pylist()])
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        codes, n = np.unique(wide.view(np.uint64)[:, 0], return_counts=True)
        common = codes[n > least] | (_U(table["shard"][0].as_py()) << _U(40))
        return pa.table({"codes": pa.array([common.tobytes()], pa.binary())})

    return run


def _common_shingles(texts: DataFrame, shards: int, total: int) -> np.ndarray:
    """Codes of the shingles of very many classes, in ascending order; at most MOST_COMMON: `total` is the size of all sets."""
    least = max(COMMON, total // MOST_COMMON)

    def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes = np.sort(_codes(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(text_bytes(batch.column("text")))]), shards))
        at = np.searchsorted(codes, np.arange(shards + 1, dtype=np.uint64) << _U(40))
        short = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 8)[:, :5])
        rows = [(s, short[at[s] : at[s + 1]].tobytes()) for s in range(shards) if at[s] < at[s + 1]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "codes"])

    found = map_arrow(texts.select("text"), send, "shard long, codes binary").groupBy("shard").applyInArrow(_more_than(least), "codes binary").collect()
    release(texts.sparkSession)
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["codes"], np.uint64) for r in found)]))


def region_pairs(keys: np.ndarray, n: np.ndarray, part: np.ndarray, d: np.ndarray, away: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places with equal keys, different parts, and sizes and distances d from the pivot within their windows.

    away: 0 for a class in its own region, else the name of that region; two classes away
    from one region of their own meet there and not here.
    """
    order = np.lexsort((n, keys))
    k, m, p, d, w = keys[order], n[order], part[order], d[order], away[order]
    heads = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(k)))
    several = np.minimum.reduceat(p, heads) != np.maximum.reduceat(p, heads) if len(heads) else np.zeros(0, bool)
    live = np.flatnonzero(np.repeat(several & (sizes <= SMALL_REGION), sizes))
    step = 1
    while len(live):
        live = live[live + step < len(k)]
        live = live[(k[live] == k[live + step]) & (5 * m[live] >= 4 * m[live + step])]
        met = live[(p[live] != p[live + step]) & (np.abs(d[live] - d[live + step]) <= WINDOW) & ((w[live] == 0) | (w[live] != w[live + step]))]
        if len(met):
            yield order[met], order[met + step]
        step += 1
    for at, size in zip(heads[several & (sizes > SMALL_REGION)], sizes[several & (sizes > SMALL_REGION)], strict=True):
        q, mm, dd, ww = (x[at : at + size] for x in (p, m, d, w))
        values, counts = np.unique(q, return_counts=True)
        main = values[counts.argmax()]
        for i in np.flatnonzero(q != main).tolist():  # each meets the main component, and the others behind it
            low, high = np.searchsorted(mm, [-(-4 * mm[i] // 5), 5 * mm[i] // 4 + 1])
            j = np.arange(low, high)
            j = j[((q[j] == main) | ((q[j] != q[i]) & (j > i))) & (np.abs(dd[j] - dd[i]) <= WINDOW) & ((ww[i] == 0) | (ww[j] != ww[i]))]
            if len(j):
                yield order[np.full(len(j), at + i)], order[at + j]


_ENTRIES = "shard long, keys binary, rows binary, c binary, region binary, away binary, d binary, n binary, part binary, counts binary"
_PAIRS = "a long, na int, b long, nb int, region long, shared int"


def _counts(s: np.ndarray) -> np.ndarray:
    """Shingles of the set in each of CLASSES classes, at most 255."""
    return np.minimum(np.bincount((mixed(s) >> _U(56)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8)


def crowded_pairs(keys: np.ndarray, rows: np.ndarray, n: np.ndarray, part: np.ndarray, counts: np.ndarray, d: np.ndarray, away: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of classes of different parts that share a common shingle, with the shingles shared, within all windows.

    The classes of the largest part come last and are only met, never walked; a class
    counts its partners over its shingles' lists, so nothing is sorted or held by pair.
    """
    size = np.unique(part, return_inverse=True, return_counts=True)
    order = np.lexsort((part, size[2][size[1]]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_key = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], keys[by_key][1:] != keys[by_key][:-1])))
    ends = np.append(heads[1:], len(keys))
    lists = place[rows[by_key]]
    several = np.minimum.reduceat(part[order][lists], heads) != np.maximum.reduceat(part[order][lists], heads)
    of_key = np.repeat(np.arange(len(heads)), ends - heads)
    by_row = np.argsort(lists, kind="stable")
    row_at = np.searchsorted(lists[by_row], np.arange(len(order) + 1))
    m, p, c, d, w = n[order].astype(np.int64), part[order], counts[order].astype(np.int16), d[order], away[order]
    for i in range(len(order)):
        if p[i] == p[-1]:
            break
        own = of_key[by_row[row_at[i] : row_at[i + 1]]]
        own = own[several[own]]
        if not len(own):
            continue
        shared = np.bincount(np.concatenate([lists[heads[k] : ends[k]] for k in own]), minlength=len(order))
        j = i + 1 + np.flatnonzero(shared[i + 1 :])
        j = j[(p[j] != p[i]) & (np.abs(d[j] - d[i]) <= WINDOW) & ((w[i] == 0) | (w[j] != w[i])) & (5 * np.minimum(m[j], m[i]) >= 4 * np.maximum(m[j], m[i]))]
        j = j[9 * np.abs(c[j] - c[i]).sum(axis=1, dtype=np.int64) <= m[j] + m[i]]
        if len(j):
            yield order[np.full(len(j), i)], order[j], shared[j]


def _entries(sets: list[np.ndarray], parts: list[np.ndarray], regions: list[list[tuple[int, float]]]) -> tuple[np.ndarray, ...]:
    """For each set in each of its regions, an entry: the set's place, the region, its own region if that is another (else 0), the distance; and for each boundary shingle its entry, itself, and its key in the region."""
    places = np.array([i for i, x in enumerate(regions) for _ in x], np.int64)
    names = np.array([r for x in regions for r, _ in x], np.int64)
    away = np.array([0 if r == x[0][0] else x[0][0] for x in regions for r, _ in x], np.int64)
    distances = np.array([d for x in regions for _, d in x], np.float32)
    salt = np.where(names == voronoi.ROOT, _U(0), mixed(names.view(_U) + _U(1)))
    rows = np.repeat(np.arange(len(places)), [len(parts[i]) for i in places])
    raw = np.concatenate([np.zeros(0, _U), *(parts[i] for i in places)])
    return places, names, away, distances, rows, raw, mixed(raw ^ salt[rows])


def _exact_pairs(texts: DataFrame, shards: int, common: np.ndarray, rounds: list[voronoi.Pivots]) -> DataFrame:
    """Pairs of classes of one region and different components that share a shingle of their boundaries.

    Common shingles go to shards of their own, with the class counts of their sets.
    """
    held = texts.sparkSession.sparkContext.broadcast((common, rounds))
    crowded = max(1, shards // 8)

    def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(text_bytes(batch.column("text")))
        c, part = (batch.column(x).to_numpy() for x in ("c", "part"))
        common, rounds = held.value
        parts = [_boundary(s, common, shards) for s in sets]
        place, region, away, d, rows, raw, keys = _entries(sets, parts, voronoi.regions_of(sets, rounds)[0])
        n = np.array([len(s) for s in sets], np.int32)
        is_common = _is_common(raw, common, shards)
        shard = np.where(is_common, shards + (keys % _U(crowded)).astype(np.int64), (keys % _U(shards)).astype(np.int64))
        order = np.argsort(shard, kind="stable")
        at = np.searchsorted(shard[order], np.arange(shards + crowded + 1))
        out: list[list] = [[] for _ in range(10)]
        for s in np.flatnonzero(np.diff(at)).tolist():
            own = order[at[s] : at[s + 1]]
            used, local = np.unique(rows[own], return_inverse=True)
            mine = place[used]
            counts = zlib.compress(b"".join(_counts(sets[r]).tobytes() for r in mine), 1) if s >= shards else b""
            held_by = (c[mine], region[used], away[used], d[used], n[mine], part[mine])
            for column, x in zip(out, (s, keys[own].tobytes(), local.astype(np.uint32).tobytes(), *(x.tobytes() for x in held_by), counts), strict=True):
                column.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=[x.split()[0] for x in _ENTRIES.split(", ")])

    def meet(table: pa.Table) -> pa.Table:
        kinds = (("keys", np.uint64), ("rows", np.uint32), ("c", np.int64), ("region", np.int64), ("away", np.int64), ("d", np.float32), ("n", np.int32), ("part", np.int64))
        col = {x: [np.frombuffer(b, k) for b in table[x].to_pylist()] for x, k in kinds}
        shift = np.cumsum([0, *(len(x) for x in col["c"][:-1])])
        rows = np.concatenate([r.astype(np.int64) + s for r, s in zip(col["rows"], shift, strict=True)])
        keys, c, region, away, d, n, part = (np.concatenate(col[x]) for x in ("keys", "c", "region", "away", "d", "n", "part"))
        # a class may stand in several rows: one place for each of its regions
        _, lead, same = np.unique(c.view(_U) ^ mixed(region.view(_U)), return_index=True, return_inverse=True)
        if table["shard"][0].as_py() >= shards:
            counts = np.frombuffer(b"".join(zlib.decompress(b) for b in table["counts"].to_pylist()), np.uint8).reshape(-1, CLASSES)
            entries = np.unique(np.column_stack((keys, same[rows].astype(np.uint64))), axis=0)
            found = list(crowded_pairs(entries[:, 0], entries[:, 1].astype(np.int64), n[lead], part[lead], counts[lead], d[lead], away[lead]))
            a, b, times = (lead[np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)])] if k < 2 else np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))
        else:
            rows = lead[same[rows]]
            codes, times, waiting, total = np.zeros(0, np.int64), np.zeros(0, np.int64), [], len(c)

            def gather() -> None:
                nonlocal codes, times, waiting
                every = np.concatenate([codes, *waiting])
                weight = np.concatenate([times, np.ones(len(every) - len(codes), np.int64)])
                codes, at = np.unique(every, return_inverse=True)
                times, waiting = np.bincount(at, weight, len(codes)).astype(np.int64), []

            for i, j in region_pairs(keys, n[rows].astype(np.int64), part[rows], d[rows], away[rows]):
                x, y = rows[i], rows[j]
                waiting.append(np.minimum(x, y) * total + np.maximum(x, y))
                if sum(map(len, waiting)) > 1 << 21:
                    gather()
            gather()
            a, b = codes // total, codes % total
        turn = c[a] > c[b]  # a pair has one form in all shards
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        return pa.table({"a": c[a], "na": n[a], "b": c[b], "nb": n[b], "region": region[a], "shared": times.astype(np.int32)})

    return map_arrow(texts.select("text", "c", "part"), send, _ENTRIES).groupBy("shard").applyInArrow(meet, _PAIRS)


def _within_windows(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that may link by what their boundaries and their class counts tell.

    Of sets of sizes na and nb that link, the symmetric difference D has 9 * D <= na + nb;
    so a lacks at most ((na + nb) / 9 + na - nb) / 2 of its own shingles in b. The set
    whose boundary ends first shares the rest of its boundary with the other's boundary.
    And D is at least the distance of the class counts.
    """
    counts = classes.select("c", "counts")
    least = lambda m, k: F.floor(F.col(m) / 5) + 1 - F.floor((F.col(m) + F.col(k) + 9 * (F.col(m) - F.col(k))) / 18)
    one = lambda x: F.min(x).alias(x)
    pairs = pairs.groupBy("a", "b", "region").agg(*map(one, ("na", "nb")), F.sum("shared").alias("shared"))
    pairs = pairs.where(F.col("shared") >= F.least(least("na", "nb"), least("nb", "na"))).select("a", "b", "na", "nb").distinct()
    rows = pairs.join(counts.select(F.col("c").alias("a"), F.col("counts").alias("x")), "a").join(counts.select(F.col("c").alias("b"), F.col("counts").alias("y")), "b")

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int64) for k in ("x", "y"))
        room = 9 * np.abs(x - y).sum(axis=1) <= batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
        yield batch.filter(pa.array(room)).select(["a", "b"])

    return map_arrow(rows.select("a", "na", "x", "b", "nb", "y"), each, "a long, b long")


def _parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The narrow rows of docs, and for the classes that have copies or links (c, c2): the least id reachable, `least`."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = cut(_read(docs))
    same = [F.first(x).alias(x) for x in (*(f"m{k}" for k in range(ORDERS)), "counts")]
    classes = cut(rows.where("n > 0").groupBy("c", "c2", "n").agg(F.min("ord").alias("ord"), F.min_by(F.struct("t", "t2"), "ord").alias("name"), F.count("*").alias("copies"), *same))
    clashes = frozenset(r["c"] for r in classes.groupBy("c").count().where("count > 1").limit(CLASHES + 1).collect())
    if len(clashes) > CLASHES:
        raise ValueError("too many sets share a hash")
    classes = classes.select("*", "name.t", "name.t2").drop("name")
    if clashes:
        name = F.when(F.col("c").isin(list(clashes)), F.col("c").bitwiseXOR(F.col("c2"))).otherwise(F.col("c"))
        rows, classes = rows.withColumn("c", name), classes.withColumn("c", name)
    total = classes.agg(F.sum("n")).first()[0] or 0
    # one row's text of each class, written once: all passes read it as it is
    texts = cut(_ordered(docs).join(narrow(classes.select("c", "ord", "t", "t2")), ["ord", "t", "t2"]).select("c", "text"))
    release(spark)
    whole = F.array(F.struct(F.lit(voronoi.ROOT).cast("long").alias("r"), F.lit(0.0).cast("float").alias("d")))
    members, rounds, parts = classes.select("c", "n", *(f"m{k}" for k in range(ORDERS)), whole.alias("regions")), [], None
    for k in range(ROUNDS):
        parts = joined(parts, _verify(texts, _crowds(_labelled(members, parts), k)))
        release(spark)
    for k in range(voronoi.DEPTH):
        pivots = _pivots(texts, _labelled(members, parts), k)
        if pivots is None:
            break
        rounds.append(pivots)
        regions, found = _divided(texts, rounds)
        members = members.drop("regions").join(regions, "c")
        parts = joined(parts, found)
        release(spark)
    shards = groups_for(docs, SHARD_BYTES)
    common = _common_shingles(texts, shards, total)
    parted = texts.join(narrow(parts), F.col("c") == F.col("node"), "left").select("c", "text", F.coalesce("component", "c").alias("part"))
    pairs = cut(_exact_pairs(parted, shards, common, rounds))
    release(spark)
    within = cut(_within_windows(pairs, classes))
    discard(pairs)
    release(spark)
    parts = joined(parts, _verify(texts, within))
    discard(texts, within)
    parts = _labelled(classes, parts)
    least = parts.groupBy("part").agg(F.min("ord").alias("least"), F.sum("copies").alias("rows")).where("rows > 1")
    return rows, cut(parts.join(least, "part").select("c", "c2", "part", "least"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    rows, parts = _parts(docs)
    found = rows.select("ord", "n", "c", "c2").join(narrow(parts), ["c", "c2"], "left")
    real = lambda x: F.when(F.col(x) < _LAST, F.col(x))
    own = F.when(F.col("n") > 0, F.coalesce("least", "ord")).otherwise(F.col("ord"))
    return found.withColumn("own", own).select(real("ord").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), real("own").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, but of each component one row: the first by doc_id (null last) and a hash of the text. Rows without shingles stay."""
    rows, parts = _parts(docs)
    row = ["ord", "t", "t2"]
    members = cut(rows.where("n > 0").join(narrow(parts), ["c", "c2"]).groupBy("part", *row).agg(F.count("*").alias("times")))
    firsts = members.groupBy("part").agg(F.min(F.struct("ord", "t", "t2")).alias("first"))
    fates = cut(members.join(firsts, "part").select(*row, (F.struct(*row) == F.col("first")).alias("stays"), "times"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")
    kept = _ordered(whole, "row").drop("text")
    repeated = fates.where("stays and times > 1").select(*row)
    single = kept.join(narrow(fates.where("not stays or times > 1").select(*row)), row, "left_anti").select("row")
    # repeated rows differ in other columns at most: the first that is written stays
    one = cut(kept.join(narrow(repeated), row).withColumn("i", F.monotonically_increasing_id()))
    first = cut(one.groupBy(*row).agg(F.min("i").alias("i")))
    one = one.join(narrow(first), [*row, "i"]).select("row")
    return single.unionByName(one).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
