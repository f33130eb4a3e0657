"""SimHash near-duplicates: fingerprints of word shingles, linked by an index in Gray order.

A fingerprint bit is set where it is set in over half of the hashes of a text's 3-word
shingles, repeats included. Distinct fingerprints are written once. Two that differ in
RADIUS bits at most have one of RADIUS + 1 pieces of bits in common; so each goes to one
cell for each piece. A cell of over CELL fingerprints is cut again by the bits that its
pieces leave, until it is small: no cell is dropped or cut short. In a shard of cells
the fingerprints are sorted by cell and by Gray rank, and a hierarchical index finds
all links of the shard (gray_index.py); a spanning forest of these leaves the shard, and
a distributed union-find joins the forests.

Cases: null and empty texts, and texts of blanks alone, have fingerprint zero and are
linked like any other; a null doc_id counts as the largest and is null where a component
holds no other; repeated rows each get their row; texts of any length are hashed whole,
CHUNK shingles at a time; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import cut, discard, map_arrow, narrow, small_batches, text_bytes
from tallyfold.llm.components import components
from tallyfold.llm.gray_index import GrayIndex, gray_rank

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a cell that are indexed together, and of a shard of cells, about.
CELL, SHARD = 1 << 16, 1 << 18
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = bytes(32 if c in b" \t\n\v\f\r" else c for c in range(256))
_LAST = np.iinfo(np.int64).max


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number."""
    import xxhash

    words = [w for w in text.translate(_LOWER).translate(_BLANK).split(b" ") if w]
    if not words:
        return 0
    total, ones = max(1, len(words) - SHINGLE + 1), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        part = words[at : at + min(CHUNK, total - at) + SHINGLE - 1]
        shingles = [b" ".join(x) for x in zip(*(part[k:] for k in range(SHINGLE)), strict=False)] if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f) of every row; f is the fingerprint's 64 bits as a signed number."""
    small_batches(docs.sparkSession)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.array([fingerprint(t) for t in text_bytes(batch.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "f"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), each, "doc_id long, f long")


def _pieces(free: list[int]) -> list[list[int]]:
    """RADIUS + 1 runs of the free bits, of about one length."""
    cuts = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [free[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    """The signed number with these bits."""
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def _cells(level: DataFrame, paths: dict[int, list[int]]) -> tuple[DataFrame, dict[int, list[int]]]:
    """The rows (f, path) of `level` in their next cells (f, path, cell), and for each new path the bits that it leaves.

    A path numbers the pieces chosen so far. Equal fingerprints in the bits of a path make one cell; `cell` is its hash.
    """
    wider: dict[int, list[int]] = {}
    chosen = F.lit(None)
    for path, free in paths.items():
        options = []
        for k, piece in enumerate(_pieces(free)):
            new = path * (RADIUS + 1) + k + 1
            wider[new] = [b for b in free if b not in piece]
            fixed = _mask([b for b in range(64) if b not in wider[new]])
            options.append(F.struct(F.lit(new).alias("path"), F.lit(fixed).cast("long").alias("mask")))
        chosen = F.when(F.col("path") == path, F.array(*options)).otherwise(chosen)
    spread = level.select("f", F.explode(chosen).alias("next"))
    return spread.select("f", "next.path", F.xxhash64("next.path", F.col("f").bitwiseAND(F.col("next.mask"))).alias("cell")), wider


def _links_of_shard(table: pa.Table) -> pa.Table:
    """A spanning forest (a, b) of the links in each cell of a shard."""
    cell, words = table["cell"].to_numpy(), table["f"].to_numpy().view(np.uint64)
    order = np.lexsort((gray_rank(words), cell))
    cell, words = cell[order], words[order]
    index = GrayIndex(words, cell)
    root = np.searchsorted(index.group, cell)
    least = np.arange(len(words))
    for i, j in index.near_pairs(root, RADIUS):
        _unite(least, i, j)
    least = _roots(least)
    far = np.flatnonzero(least != np.arange(len(words)))
    signed = words.view(np.int64)
    return pa.table({"a": signed[far], "b": signed[least[far]]})


def _roots(least: np.ndarray) -> np.ndarray:
    while True:
        above = least[least]
        if (above == least).all():
            return least
        least = above


def _unite(least: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j, all pairs at once; a tree's root is its smallest place."""
    while len(i):
        least[:] = _roots(least)
        a, b = least[i], least[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints `f` that keep together all that differ in RADIUS bits at most; `distinct` has each once."""
    level, paths, links = distinct.select("f", F.lit(0).alias("path")), {0: list(range(64))}, None
    held: list[DataFrame] = []
    while paths:
        spread, paths = _cells(level, paths)
        spread = cut(spread)
        sizes = cut(spread.groupBy("path", "cell").agg(F.count("*").alias("members")).where("members > 1"))
        held += [spread, sizes]
        total = sizes.where(F.col("members") <= CELL).agg(F.sum("members")).first()[0] or 0
        shards = max(1, -(-total // SHARD))
        small = spread.join(narrow(sizes.where(F.col("members") <= CELL).select("path", "cell")), ["path", "cell"])
        found = small.select("cell", "f", F.pmod("cell", F.lit(shards)).alias("shard")).groupBy("shard").applyInArrow(_links_of_shard, "a long, b long")
        links = found if links is None else links.unionByName(found)
        large = sizes.where(F.col("members") > CELL).select("path", "cell")
        used = {r["path"] for r in large.select("path").distinct().collect()}  # a path numbers pieces, not data: 4, 16, ... at most
        paths = {p: free for p, free in paths.items() if p in used}
        level = spread.join(narrow(large), ["path", "cell"]).select("f", "path")
    out = cut(links.distinct())
    discard(*held)
    return out


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row."""
    rows = cut(fingerprints(docs))
    own = F.coalesce("doc_id", F.lit(int(_LAST)))
    classes = cut(rows.groupBy("f").agg(F.min(own).alias("least")))
    links = near_links(classes)
    nodes = cut(components(links))
    parts = classes.join(narrow(nodes), F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("component", "f").alias("component"))
    smallest = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(parts.join(narrow(smallest), "component").select("f", "component_id"))
    discard(classes, links, nodes)
    out = rows.join(narrow(named), "f")
    hexed = F.lower(F.lpad(F.hex("f"), 16, "0"))
    return out.select("doc_id", hexed.alias("fingerprint"), F.when(F.col("component_id") < int(_LAST), F.col("component_id")).alias("component_id"))
