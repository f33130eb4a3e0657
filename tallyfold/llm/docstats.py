"""Statistics of whole texts, shared by the quality operators.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r; nothing is cut off.
A null text counts as empty; an empty text has 0 everywhere.
"""

from __future__ import annotations

import numpy as np

_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"[#*$%&|<>]"[1:-1]
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_STOPS = b".,;:?"

#: Columns of `measure`, in order.
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_stops", "n_bangs", "n_bars", "n_distinct", "n_upper_words")


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words that lie in a 3-word window which the text holds twice or more; distinct words. Exact."""
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    v = len(names)
    if len(ids) < 4:
        return 0, v
    pairs = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:  # three names would not fit in 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * v + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0, v
    twice = np.zeros(len(ranked), bool)
    twice[1:] |= same
    twice[:-1] |= same
    marks = np.zeros(len(ids) + 3, np.int64)
    at = order[twice]
    np.add.at(marks, at, 1)
    np.add.at(marks, at + 3, -1)
    return int((np.cumsum(marks)[: len(ids)] > 0).sum()), v


def measure(texts: list[bytes]) -> np.ndarray:
    """A row of COLUMNS for each text."""
    out = np.zeros((len(texts), len(COLUMNS)), np.int64)
    for i, b in enumerate(texts):
        if not b:
            continue
        words = b.split()
        lines = [x for x in b.split(b"\n") if x.strip(_SPACE)]
        repeated, distinct = repeat_words(words)
        chars = len(b) - _count(b, _CONTINUATION + _SPACE)
        out[i] = (
            len(words), chars, _count(b, _SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines),
            _count(b, _UPPER), _count(b, _LOWER), _count(b, _DIGITS), _count(b, _STOPS), b.count(b"!"), b.count(b"|"), distinct, sum(map(bytes.isupper, words)),
        )
    return out


#: Columns of `ratios`, in order.
RATIOS = ("log_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "words_per_line", "upper_ratio", "letter_ratio", "digit_ratio", "stop_ratio", "bang_ratio", "bar_ratio", "distinct_ratio", "upper_word_ratio")


def ratios(m: np.ndarray) -> np.ndarray:
    """RATIOS of each row of `measure`: shares that do not grow with the text's length, and its logarithm."""
    c = {k: m[:, i].astype(float) for i, k in enumerate(COLUMNS)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack(
        (
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, np.log1p(c["n_words"] / lines),
            c["n_upper"] / chars, (c["n_upper"] + c["n_lower"]) / chars, c["n_digits"] / chars, c["n_stops"] / words, c["n_bangs"] / words, c["n_bars"] / words,
            c["n_distinct"] / words**0.9, c["n_upper_words"] / words,
        )
    )
