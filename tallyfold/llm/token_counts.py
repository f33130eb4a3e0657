"""Token counts: lengths only, from batches balanced by bytes, whatever number of rows they hold.

Cases: null and empty texts have 0 tokens; long texts are counted whole, in pieces; repeated rows each get their count; an
empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyfold.llm.common import small_batches, text_bytes

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Bytes that are encoded in one call of the library.
BATCH_BYTES = 1 << 20
#: Texts above this many characters are split before they are encoded.
LONG_TEXT = 1 << 14

#: A safe place: one space between two ASCII letters or digits. The model writes the
#: space as its word mark, no piece has that mark after another character (checked by
#: `safe_to_split`), and such characters are not changed by the model's normalisation.
_SAFE = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


@functools.cache
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def safe_to_split(path: str) -> bool:
    """Whether no piece holds a word mark behind another character, and a text gets a leading mark of its own."""
    sp = _model(path)
    inner = any("▁" in p.lstrip("▁") for p in map(sp.id_to_piece, range(sp.get_piece_size())))
    return not inner and sp.encode("a", out_type=str)[0].startswith("▁")


def split_text(text: str, long_text: int = LONG_TEXT) -> Iterator[str]:
    """Pieces of about `long_text` characters, cut at safe places only; their counts add up to the text's."""
    at = 0
    while len(text) - at > long_text:
        found = _SAFE.search(text, at + long_text)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text as the sentencepiece model at `path` gives them."""
    sp, out = _model(path), [0] * len(texts)
    may_split, owners, batch, held = safe_to_split(path), [], [], 0

    def flush() -> None:
        for owner, ids in zip(owners, sp.encode(batch, num_threads=1), strict=True):
            out[owner] += len(ids)
        owners.clear()
        batch.clear()

    for i, text in enumerate(texts):
        for piece in split_text(text) if may_split else (text,):
            size = len(piece.encode())
            if batch and held + size > BATCH_BYTES:
                flush()
                held = 0
            owners.append(i)
            batch.append(piece)
            held += size
    flush()
    return out


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """Per document its bytes, its tokens and whether these are over `limit`.

    `model` is a name below `public_tokenizers` or a path of its own.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = model if "/" in model else public_tokenizers.path(model)

        def counted(ids: list[int | None], raw: list[bytes]) -> pa.RecordBatch:
            counts = count_tokens([b.decode("utf-8", "replace") for b in raw], path)
            columns = [pa.array(ids, pa.int64()), pa.array([len(b) for b in raw], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        ids, raw, held = [], [], 0
        for batch in batches:  # rows gather until they hold the bytes of a call
            own = text_bytes(batch.column("text"))
            ids += batch.column("doc_id").cast(pa.int64()).to_pylist()
            raw += own
            held += sum(map(len, own))
            if held >= BATCH_BYTES:
                yield counted(ids, raw)
                ids, raw, held = [], [], 0
        if ids:
            yield counted(ids, raw)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
