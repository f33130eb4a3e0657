"""Removal of byte strings that a document with a smaller id also holds, by suffix arrays.

Every string of LENGTH bytes has an anchor: of its GRAM-byte grams the one with the
smallest hash. Consecutive strings with one anchor make a segment. Equal strings have
equal anchors, so segments are sent to shards by their anchor's hash, and all places of
a string meet in one shard. There a suffix array of the distinct segments is induced;
neighbours with a permuted common prefix of LENGTH bytes hold the same string, and each
such class has a smallest doc_id.

Documents are dealt to blocks by a hash of their id and text, so that rows without an id
spread. Three exchanges of numpy arrays
go between blocks and shards, the first of anchors only: a segment whose anchor one
document alone holds is never sent. A block sends equal segments once, with their
smallest doc_id, whatever number of its documents hold them.

Cases: null and empty texts, and texts under LENGTH bytes, lose nothing; a null doc_id
counts as the largest; rows with one id do not take from each other; repeated rows are
judged alike; every byte counts as it is, NUL too; texts of any length are read whole, as
places of their block; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import groups_for
from tallyfold.llm.suffix_array import permuted_lcp, suffix_array

#: Bytes of a repeated string, bytes of an anchor gram, grams in a string.
LENGTH, GRAM = 50, 16
GRAMS = LENGTH - GRAM + 1
#: Input bytes of a block (as the files hold them), and bytes of the segments that one suffix array takes.
BLOCK_BYTES, ARRAY_BYTES = 4 << 20, 4 << 20
#: Strings whose anchors are sought at once.
CHUNK = 1 << 16

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_ANCHORS = "shard long, block long, anchors binary, several binary"
_SHARED = "block long, shard long, shared binary"
_SEGMENTS = "shard long, block long, hashes binary, subs binary, lengths binary, smallest binary, bytes binary"
_CLASSES = "block long, shard long, runs binary, counts binary, ids binary"
_LAST = np.iinfo(np.int64).max
_U = np.uint64
#: A random 64-bit number for each byte, and the odd base of the segments' hashes.
_OF_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE, _MIX = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX
    x = (x ^ (x >> _U(29))) * _BASE
    return x ^ (x >> _U(32))


class Block:
    """The documents of a block in a fixed order: by id, then text."""

    def __init__(self, table: pa.Table) -> None:
        ids = pc.fill_null(table["doc_id"], _LAST).combine_chunks()
        texts = pc.fill_null(table["text"].cast(pa.large_binary()), b"").combine_chunks()
        order = pc.sort_indices(pa.table({"i": ids, "t": texts}), sort_keys=[("i", "ascending"), ("t", "ascending")])
        self.doc_id = table["doc_id"].combine_chunks().take(order)
        self.ids = ids.take(order).to_numpy()
        texts = texts.take(order)
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        _, offsets, data = texts.buffers()
        self.ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.text = np.frombuffer(data, np.uint8)[self.ends[0] : self.ends[-1]] if data and self.ends[-1] > self.ends[0] else np.zeros(0, np.uint8)
        self.ends = self.ends - self.ends[0]

    def find_segments(self) -> None:
        """Sets first, stop: places of each segment's first string and behind its last; doc; key: its anchor's mixed hash."""
        anchors, hashes = [], []
        for at in range(0, max(0, len(self.text) - LENGTH + 1), CHUNK):
            a, h = _anchors(self.text[at : at + CHUNK + LENGTH - 1])
            anchors.append(a + at)
            hashes.append(h)
        anchor = np.concatenate(anchors) if anchors else np.zeros(0, np.int64)
        valid = np.zeros(len(self.text) + 1, np.int8)
        long = np.flatnonzero(np.diff(self.ends) >= LENGTH)
        np.add.at(valid, self.ends[long], 1)
        np.add.at(valid, self.ends[long + 1] - LENGTH + 1, -1)
        ok = np.cumsum(valid, dtype=np.int8)[: len(anchor)] > 0
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1]
        begins = np.zeros(len(self.text) + 1, bool)
        begins[self.ends[:-1]] = True
        new |= begins[: len(anchor)]
        self.first = np.flatnonzero(new & ok)
        breaks = np.flatnonzero(new | ~ok)
        following = np.searchsorted(breaks, self.first, side="right")
        self.stop = np.append(breaks, len(anchor))[following]
        self.doc = np.searchsorted(self.ends, self.first, side="right") - 1
        self.key = _mixed(np.concatenate(hashes)[self.first]) if anchors else np.zeros(0, np.uint64)

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, whether several ids hold each, and each segment's place among the keys."""
        keys, inverse = np.unique(self.key, return_inverse=True)
        ids = self.ids[self.doc]
        low, high = np.full(len(keys), _LAST), np.full(len(keys), -_LAST)
        np.minimum.at(low, inverse, ids)
        np.maximum.at(high, inverse, ids)
        return keys, low != high, inverse


def _anchors(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the string at each place the place of its anchor, and the anchor's hash. The last of equal grams counts."""
    h, size = _OF_BYTE[t], 1
    while size < GRAM:
        h = _mixed(h[:-size] * _BASE + h[size:])
        size *= 2
    place = np.arange(len(h), dtype=np.uint64)
    low = (h & _U(0xFFFFFFFF00000000)) | (_U(0xFFFFFFFF) - place)
    size = 1
    while 2 * size <= GRAMS:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < GRAMS:
        low = np.minimum(low[: -(GRAMS - size)], low[GRAMS - size :])
    anchor = (_U(0xFFFFFFFF) - (low & _U(0xFFFFFFFF))).astype(np.int64)
    return anchor, h[anchor]


def _spans(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the sorted keys of each shard begin; a shard is a range of keys."""
    firsts = np.array([-(-(s << 64) // shards) for s in range(1, shards)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, firsts), [len(keys)]))


def _table(columns: dict, schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.table({n: pa.array(columns[n], kinds[k]) for n, k in (x.split() for x in schema.split(", "))})


def _rows(schema: str) -> dict[str, list]:
    return {x.split()[0]: [] for x in schema.split(", ")}


def _send_anchors(shards: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        block.find_segments()
        keys, several, _ = block.distinct_keys()
        at, out = _spans(keys, shards), _rows(_ANCHORS)
        for s in np.flatnonzero(np.diff(at)):
            part = slice(at[s], at[s + 1])
            for column, x in zip(out.values(), (s, table["block"][0].as_py(), keys[part].tobytes(), np.packbits(several[part]).tobytes()), strict=True):
                column.append(x)
        return _table(out, _ANCHORS)

    return run


def _find_shared(table: pa.Table) -> pa.Table:
    """Of each block's anchors those that another block holds, or several ids of its own."""
    table = table.sort_by("block")
    keys = [np.frombuffer(b, np.uint64) for b in table["anchors"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)).astype(bool) for b, k in zip(table["several"].to_pylist(), keys, strict=True)]
    every = np.sort(np.concatenate(keys))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    out = _rows(_SHARED)
    for block, shard, k, s in zip(table["block"].to_pylist(), table["shard"].to_pylist(), keys, several, strict=True):
        at = np.searchsorted(again, k)
        shared = s | (again[np.minimum(at, max(0, len(again) - 1))] == k if len(again) else False)
        if shared.any():
            for column, x in zip(out.values(), (block, shard, np.packbits(shared).tobytes()), strict=True):
                column.append(x)
    return _table(out, _SHARED)


class Candidates:
    """The distinct segments of a block whose anchors are shared, in the order of their shards."""

    def __init__(self, block: Block, answers: pa.Table, shards: int) -> None:
        block.find_segments()
        keys, _, inverse = block.distinct_keys()
        at, shared = _spans(keys, shards), np.zeros(len(keys), bool)
        for s, bits in zip(answers["shard"].to_pylist(), answers["shared"].to_pylist(), strict=True):
            shared[at[s] : at[s + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(at[s + 1] - at[s])).astype(bool)
        #: Segments that are candidates, as places in the block's list.
        self.use = np.flatnonzero(shared[inverse])
        first, end = block.first[self.use], block.stop[self.use] + LENGTH - 1
        content = _content_hash(block.text, first, end) + (end - first).astype(np.uint64)
        key = block.key[self.use]
        order = np.lexsort((content, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        #: The distinct segment of each candidate.
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        leads = order[new]
        self.first, self.end, self.key, self.content = first[leads], end[leads], key[leads], content[leads]
        self.smallest = np.full(len(leads), _LAST)
        np.minimum.at(self.smallest, self.which, block.ids[block.doc[self.use]])
        self.at = _spans(self.key, shards)


def _content_hash(t: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each segment's bytes."""
    powers = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(len(t), _BASE))))
    sums = np.concatenate(([_U(0)], np.add.accumulate(_OF_BYTE[t] * powers[1:])))
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    back = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(len(t), inverse))))
    return _mixed((sums[end] - sums[first]) * back[first])


def _flat(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each segment, one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)


def _send_segments(shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = _rows(_SEGMENTS)
        if table.num_rows and answers.num_rows:
            block = Block(table)
            c = Candidates(block, answers, shards)
            for s in np.flatnonzero(np.diff(c.at)):
                part = slice(c.at[s], c.at[s + 1])
                length = c.end[part] - c.first[part]
                row = (s, table["block"][0].as_py(), c.content[part].tobytes(), (c.key[part] & _U(255)).astype(np.uint8).tobytes(), length.astype(np.uint8).tobytes(), c.smallest[part].tobytes(), block.text[_flat(c.first[part], length)].tobytes())
                for column, x in zip(out.values(), row, strict=True):
                    column.append(x)
        return _table(out, _SEGMENTS)

    return run


def smallest_holders(text: np.ndarray, length: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """For the string at each place of the joined segments the smallest id of all segments that hold it.

    The segments lie one after another, each byte plus 1, with a 0 behind each, which is
    therefore no byte of theirs; `smallest` is each segment's own id. Places too near a
    segment's end have no string.
    """
    sa = suffix_array(text, 257, joined=True)
    lcp = permuted_lcp(text, sa)
    rest = np.repeat(np.cumsum(length + 1), length + 1) - 1 - np.arange(len(text))
    own = np.where(rest >= LENGTH, np.repeat(smallest, length + 1), _LAST)
    new = lcp[sa] < LENGTH
    if len(new):
        new[0] = True
    heads = np.flatnonzero(new)
    low = np.minimum.reduceat(own[sa], heads) if len(heads) else own
    out = np.empty(len(text), np.int64)
    out[sa] = low[np.cumsum(new) - 1] if len(heads) else own
    return out


def _find_classes(table: pa.Table) -> pa.Table:
    """Answers each block: for its segments, in its order, the runs of smallest ids along their strings."""
    table = table.sort_by("block")
    col = {c: [np.frombuffer(b, k) for b in table[c].to_pylist()] for c, k in (("hashes", np.uint64), ("subs", np.uint8), ("lengths", np.uint8), ("smallest", np.int64), ("bytes", np.uint8))}
    sizes = [len(x) for x in col["hashes"]]
    hashes, subs, length, smallest, data = (np.concatenate(col[c]) for c in ("hashes", "subs", "lengths", "smallest", "bytes"))
    length = length.astype(np.int64)
    begin = np.cumsum(length) - length
    _, lead, which = np.unique(hashes, return_index=True, return_inverse=True)
    low = np.full(len(lead), _LAST)
    np.minimum.at(low, which, smallest)
    strings = length[lead] - LENGTH + 1
    place = np.cumsum(strings) - strings
    holders = np.empty(int(strings.sum()), np.int64)
    arrays = max(1, min(256, -(-int(length[lead].sum()) // ARRAY_BYTES)))
    part = subs[lead].astype(np.int64) * arrays >> 8  # segments with one anchor stay together
    for p in range(arrays):
        own = np.flatnonzero(part == p)
        if not len(own):
            continue
        n = length[lead[own]]
        symbols = data[_flat(begin[lead[own]], n)]
        # UTF-8 has no byte 255; where a text holds one nevertheless, symbols take 16 bits
        text = np.zeros(len(symbols) + len(own), np.uint16 if symbols.max() == 255 else np.uint8)
        starts = np.cumsum(n + 1) - (n + 1)
        text[_flat(starts, n)] = symbols.astype(text.dtype) + 1
        found = smallest_holders(text, n, low[own])
        holders[_flat(place[own], strings[own])] = found[_flat(starts, strings[own])]
    new = np.zeros(len(holders), bool)
    new[place] = True
    new[1:] |= holders[1:] != holders[:-1]
    heads = np.flatnonzero(new)
    run_ids, run_counts = holders[heads], np.diff(np.append(heads, len(holders))).astype(np.uint8)
    first_run = np.searchsorted(heads, place)
    runs = np.diff(np.append(first_run, len(heads)))
    out, at = _rows(_CLASSES), 0
    for block, shard, size in zip(table["block"].to_pylist(), table["shard"].to_pylist(), sizes, strict=True):
        own = which[at : at + size]
        at += size
        picked = _flat(first_run[own], runs[own])
        for column, x in zip(out.values(), (block, shard, runs[own].astype(np.uint8).tobytes(), run_counts[picked].tobytes(), run_ids[picked].tobytes()), strict=True):
            column.append(x)
    return _table(out, _CLASSES)


def _cut_out(shards: int):
    def run(table: pa.Table, answers: pa.Table, classes: pa.Table) -> pa.Table:
        block = Block(table)
        covered = np.zeros(len(block.text) + 1, np.int32)
        if classes.num_rows:
            c = Candidates(block, answers, shards)
            classes = classes.sort_by("shard")
            runs, counts, ids = (np.concatenate([np.frombuffer(b, k) for b in classes[n].to_pylist()]) for n, k in (("runs", np.uint8), ("counts", np.uint8), ("ids", np.int64)))
            first_run = np.cumsum(runs.astype(np.int64)) - runs
            offset = np.cumsum(counts.astype(np.int64)) - counts
            n = runs[c.which].astype(np.int64)
            picked = _flat(first_run[c.which], n)
            shift = offset[picked] - np.repeat(offset[first_run[c.which]], n)
            start = np.repeat(block.first[c.use], n) + shift
            gone = ids[picked] < np.repeat(block.ids[block.doc[c.use]], n)
            np.add.at(covered, start[gone], 1)
            np.add.at(covered, start[gone] + counts[picked][gone] + LENGTH - 1, -1)
        lost = np.cumsum(covered)[:-1] > 0
        out = _rows(SCHEMA)
        for i, doc_id in enumerate(block.doc_id.to_pylist()):
            part = slice(block.ends[i], block.ends[i + 1])
            gone, text = lost[part], block.text[part]
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            row = (doc_id, len(text), int(gone.sum()), spans, hashlib.sha256((text[~gone] if spans else text).tobytes()).hexdigest())
            for column, x in zip(out.values(), row, strict=True):
                column.append(x)
        return _table(out, SCHEMA)

    return run


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per document its bytes, those that are removed, their maximal runs, and the hash of what is left."""
    blocks = groups_for(docs, BLOCK_BYTES)
    shards = 2 * blocks
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    anchors = rows.groupBy("block").applyInArrow(_send_anchors(shards), _ANCHORS)
    shared = anchors.groupBy("shard").applyInArrow(_find_shared, _SHARED)
    segments = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send_segments(shards), _SEGMENTS)
    classes = segments.groupBy("shard").applyInArrow(_find_classes, _CLASSES)
    nothing = F.lit(None).cast("binary")
    both = shared.select("block", "shard", "shared", nothing.alias("runs"), nothing.alias("counts"), nothing.alias("ids")).unionByName(classes.select("block", "shard", nothing.alias("shared"), "runs", "counts", "ids"))
    last = _cut_out(shards)

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(_rows(SCHEMA), SCHEMA)
        told = pc.is_valid(found["shared"])
        return last(table, found.filter(told), found.filter(pc.invert(told)))

    return rows.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, SCHEMA)
