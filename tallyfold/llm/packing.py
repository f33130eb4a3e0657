"""Packing into fixed-length sequences: first-fit decreasing in randomised groups.

Documents are cut into full sequences and one tail each. Tails are packed by first-fit
decreasing; a tournament tree over the bins' free capacities finds the first bin that
fits in a logarithm of the bins. Groups are drawn by a hash of the piece, so they are
alike in size and lengths and are packed independently. Only lengths and checksums
are shuffled, no text and no token.

Cases: a null or empty text is the closing id alone; repeated rows are packed as rows
of their own, in any groups; texts of any length, runs of blanks too, are encoded whole; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import groups_for, map_arrow, small_batches, text_bytes

LENGTH = 1024
#: Input bytes of one group, as the files hold them.
GROUP_BYTES = 2 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class BinTree:
    """Free capacity of open bins in the leaves, and in each inner node the winner: the larger of its children."""

    def __init__(self, most: int, capacity: int) -> None:
        self.capacity, self.used, self.leaves = capacity, 0, 1
        while self.leaves < max(1, most):
            self.leaves *= 2
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for `size`; its capacity shrinks."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        found = at - self.leaves
        best[at] -= size
        at //= 2
        while at:
            best[at] = max(best[2 * at], best[2 * at + 1])
            at //= 2
        self.used = max(self.used, found + 1)
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each size and its offset there; sizes are between 1 and `capacity`."""
    tree = BinTree(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled: dict[int, int] = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        b = tree.place(size)
        bins[i], offsets[i] = b, filled.get(b, 0)
        filled[b] = filled.get(b, 0) + size
    return bins, offsets


@functools.cache
def _encoder(path: str):
    """The tokenizer at `path`, as tiktoken reads its vocabulary: the same ids (tested against the library `tokenizers`), four times as fast."""
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


@functools.cache
def _slow_encoder(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def encode(texts: list[str], name: str = "byte_bpe_50k") -> list[list[int]]:
    """Ids of each text; the special token's own string stands for its id, as `tokenizers` reads it.

    `name` is a vocabulary of `public_tokenizers`, or a path of its own, that ends in .json
    and .tiktoken. Where a run of blanks is too long for the pattern's backtracking in
    tiktoken, `tokenizers` itself gives the ids.
    """
    import public_tokenizers

    path = (lambda end: f"{name}{end}") if "/" in name else lambda end: public_tokenizers.path(f"{name}{end}")
    own, out = _encoder(path(".tiktoken")), []
    for text in texts:
        try:
            out.append(own.encode(text, allowed_special="all"))
        except ValueError:
            out.append(_slow_encoder(path(".json")).encode(text, add_special_tokens=False).ids)
    return out


def pieces(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every document's ids with a closing 0, cut at multiples of `length`."""
    small_batches(docs.sparkSession)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], [], []]
        texts = [b.decode("utf-8", "replace") for b in text_bytes(batch.column("text"))]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
            ids = np.array([*encode([text])[0], 0], "<u4")
            for start in range(0, len(ids), length):
                part = ids[start : start + length]
                for column, x in zip(columns, (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, _PIECES)


def pack(docs: DataFrame, length: int = LENGTH, seed: int = 42) -> DataFrame:
    """A row for each piece with its sequence and its place there."""
    groups = groups_for(docs, GROUP_BYTES)
    # the row number parts repeated rows, which would else fill one group
    salt = F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    dealt = pieces(docs, length).withColumn("group", F.pmod(salt, F.lit(groups)))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "doc_tokens")])
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), length)
        ids = (part["group"].to_numpy() << 32) + bins
        return part.drop_columns(["group"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("group").applyInArrow(run, SCHEMA)
