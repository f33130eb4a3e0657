"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel edit distance.

Texts are lower-cased and runs of white space are one space. An item of m bytes may
differ by m * `share` edits; it is cut into one piece more than that, so one piece of
any match is free of edits. Documents are scanned once for all pieces (Aho-Corasick);
each hit is verified in a window around it.

The automaton is broadcast: benchmark texts are measured first and split into slices of
at most SLICE_BYTES, each with a scan of its own.

Cases: null and empty texts match nothing; items that are null, or empty after
normalisation, are left out; equal items and repeated documents are reported each
(a row for each row of the documents and item id); long texts are searched whole; empty tables give an empty result; further columns of the
documents are kept by `drop_contaminated`.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import map_arrow, small_batches, text_bytes

#: Edits that a match may have, as a share of the item's bytes; the shortest piece that is searched.
SHARE, LEAST_PIECE = 0.05, 8
#: Benchmark bytes of one broadcast automaton.
SLICE_BYTES = 16 << 20
#: Bytes of windows whose distances a worker remembers, about.
CACHE_BYTES = 32 << 20
SCHEMA = "doc_id long, item_id long, distance long, start long, end long"


def normalise(raw: bytes) -> bytes:
    return b" ".join(raw.lower().split())


def budget(m: int, share: float = SHARE) -> int:
    """Edits allowed in an item of m bytes: its share, but every piece keeps LEAST_PIECE bytes."""
    return max(0, min(int(m * share), m // LEAST_PIECE - 1))


def pigeonhole(item: bytes, edits: int) -> list[tuple[int, bytes]]:
    """`edits` + 1 pieces of nearly equal length, each with its place."""
    m, k = len(item), edits + 1
    return [(j * m // k, item[j * m // k : (j + 1) * m // k]) for j in range(k)]


def myers(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of `item` to any substring of `text`, and the first place where such a substring ends."""
    m, mask, top = len(item), (1 << len(item)) - 1, 1 << (len(item) - 1)
    equal: dict[int, int] = {}
    for i, c in enumerate(item):
        equal[c] = equal.get(c, 0) | 1 << i
    plus, minus, now, best, end = mask, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = equal.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(zero | plus), plus & zero
        now += bool(up & top) - bool(down & top)
        up, down = (up << 1) & mask, (down << 1) & mask
        plus, minus = (down | ~(zero | up)) & mask, up & zero
        if now < best:
            best, end = now, at
    return best, end


class Searcher:
    """All pieces of some items, and the items."""

    def __init__(self, items: list[tuple[int, bytes]], share: float = SHARE) -> None:
        import ahocorasick

        self.items, places = items, {}
        for n, (_, item) in enumerate(items):
            for start, piece in pigeonhole(item, budget(len(item), share)):
                places.setdefault(piece.decode("latin-1"), []).append((n, start))
        self.share, self.automaton = share, ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), tuple(found)))
        if places:
            self.automaton.make_automaton()
        self.cache: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        self.cached = 0

    def _match(self, n: int, window: bytes) -> tuple[int, int, int]:
        """Least distance, and where the first substring of the window that has it begins and ends."""
        if (found := self.cache.get((n, window))) is None:
            if self.cached > CACHE_BYTES:
                self.cache.clear()
                self.cached = 0
            item = self.items[n][1]
            distance, end = myers(item, window)
            start = 0
            if distance <= budget(len(item), self.share):  # no such substring ends earlier, so read backwards it begins here
                start = end - myers(item[::-1], window[:end][::-1])[1]
            found = self.cache[n, window] = (distance, start, end)
            self.cached += len(window) + 200
        return found

    def find(self, raw: bytes) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start and end of the window's match in the normalised text) of each item found, the best match of each."""
        text = normalise(raw)
        if not text or not len(self.automaton):
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, found) in self.automaton.iter(text.decode("latin-1")):
            for n, start in found:
                m = len(self.items[n][1])
                e, begin = budget(m, self.share), last + 1 - size - start
                low, high = max(0, begin - e), min(len(text), begin + m + e)
                held = windows.setdefault(n, [])
                if held and low <= held[-1][1]:  # hits of one match lie close together
                    held[-1] = (min(low, held[-1][0]), max(high, held[-1][1]))
                else:
                    held.append((low, high))
        best: dict[int, tuple[int, int, int]] = {}
        for n, spans in windows.items():
            item_id, item = self.items[n]
            for low, high in spans:
                distance, start, end = self._match(n, text[low:high])
                if distance <= budget(len(item), self.share):
                    got = (distance, low + start, low + end)
                    best[item_id] = min(best.get(item_id, got), got)
        return [(k, *v) for k, v in sorted(best.items())]


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items, normalised, in slices of about SLICE_BYTES at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-2 * total // SLICE_BYTES))
    for i in range(slices):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i).collect()
        found = sorted({(r["item_id"], normalise(r["text"].encode())) for r in rows})
        yield [(k, t) for k, t in found if t]


def _searcher(broadcast, key: str) -> Searcher:
    """The searcher of a broadcast slice, built once in a worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Searcher(*pickle.loads(broadcast.value))
    return _BUILT[key]


_BUILT: dict[str, Searcher] = {}


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """A row for each document and benchmark item that it holds, up to the item's edits."""
    spark = docs.sparkSession
    small_batches(spark)
    out = None
    for items in _slices(benchmark):
        held, key = spark.sparkContext.broadcast(pickle.dumps((items, share))), uuid.uuid4().hex

        def each(batch: pa.RecordBatch, held=held, key=key) -> Iterator[pa.RecordBatch]:
            own = _searcher(held, key)
            rows = [(d, *x) for d, raw in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True) for x in own.find(raw)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "distance", "start", "end"])

        found = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no item."""
    spark = docs.sparkSession
    small_batches(spark)
    for items in _slices(benchmark):
        held, key = spark.sparkContext.broadcast(pickle.dumps((items, share))), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = _searcher(held, key)
                    yield batch.filter(pa.array([not own.find(raw) for raw in text_bytes(batch.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
