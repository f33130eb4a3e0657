"""Word shingles of many texts at once, as 64-bit hashes, in numpy.

A-Z are lower-cased; words are runs of bytes other than space and \\t \\n \\v \\f \\r; a
shingle is SIZE words in a row. A text with fewer words has its whole sequence as one.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_WORD = np.array([c not in b" \t\n\v\f\r" for c in range(256)])
_U = np.uint64
_OF_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE, _MIX = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_BACK = _U(pow(int(_BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX
    x = (x ^ (x >> _U(29))) * _BASE
    return x ^ (x >> _U(32))


def _word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the joined texts, and the place where the word begins."""
    is_word = _IS_WORD[text]
    edge = np.diff(np.concatenate(([False], is_word, [False])).astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(len(text), _BASE))))
    back = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(len(text), _BACK))))
    sums = np.concatenate(([_U(0)], np.add.accumulate(_OF_BYTE[text] * powers[1:])))
    return mixed((sums[end] - sums[first]) * back[first] + (end - first).astype(np.uint64)), first


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text, in ascending order of their hashes."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    held = 0
    for i, t in enumerate(texts):  # a few MB at once
        part.append(t)
        held += len(t)
        if held > 1 << 21 or i + 1 == len(texts):
            out += _sets(part)
            part, held = [], 0
    return out


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    text = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    words, first = _word_hashes(text)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(first, ends)
    begins = np.concatenate(([0], cuts[:-1]))
    shingles = np.zeros(0, np.uint64)
    if len(words) >= SIZE:
        n = len(words) - SIZE + 1
        shingles = words[:n].copy()
        for k in range(1, SIZE):
            shingles = mixed(shingles * _BASE + words[k : k + n])
    out = []
    for a, b in zip(begins.tolist(), cuts.tolist(), strict=True):
        if b - a >= SIZE:
            s = np.sort(shingles[a : b - SIZE + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = words[a : a + 1]
            for k in range(a + 1, b):
                h = mixed(h * _BASE + words[k : k + 1])
            out.append(mixed(h + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
