"""Exact joins of similar texts without all pairs: length windows, counts of shared grams, a prefix index, verification.

The ratio of two texts is 2 LCS / (n + m), by their longest common subsequence. For a
ratio of t or more

* m lies between n t / (2 - t) and n (2 - t) / t;
* of the LCS characters' runs of q, at most q - 1 are broken by each character that one
  text has alone, so that the texts share (2q - 1) LCS - (q - 1)(n + m) - (q - 1) grams
  of q characters or more, with repeats.

Grams are numbered by occurrence, so that a text has a set of them, and sorted by how
rare they are. Two texts that must share k grams share s of them among the first
size - k + s of both, for s up to k. So each text sends its first grams only, and an
equi-join on the gram that counts the pairs' hits finds every pair that can reach t; s
is MEETS, or k where that is less. Grams of two characters serve the pairs whose lengths
are great enough for the bound to hold at least two of them, single characters the
others. The pairs found are verified by the ratio itself. One rule holds at every
size and no pair is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLACK = 1e-9
#: Grams that two texts must meet in before they are compared, where the bound asks for as many.
MEETS = 3


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one big integer for each row."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    s = mask
    for c in b:
        u = s & places.get(c, 0)
        s = ((s + u) | (s - u)) & mask
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * (1 - edits without substitution / both lengths)."""
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text to a part of the longer."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    m = len(short)
    parts = {long[max(0, i) : i + m] for i in range(1 - m, len(long))}
    return max(ratio(short, p) for p in parts)


def sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(sorted_words(a), sorted_words(b))


RATIOS = {"ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio}


def grams(text: str, q: int) -> list[str]:
    """The text's runs of q characters, each with its number among equal ones."""
    seen: Counter = Counter()
    out = []
    for i in range(len(text) - q + 1):
        g = text[i : i + q]
        out.append(f"{q}:{seen[g]}:{g}")
        seen[g] += 1
    return out


def _up(x: float) -> int:
    return math.ceil(x - _SLACK)


def shared_grams(both: int, t: float, q: int) -> int:
    """Grams that two texts of `both` characters share at least, if their ratio is t or more."""
    return (2 * q - 1) * _up(t * both / 2) - (q - 1) * both - (q - 1)


def paired_from(t: float) -> int | None:
    """The length of two texts together from which on pairs of characters tell them apart, for all greater lengths; None if there is none."""
    if 1.5 * t <= 1:
        return None
    from_ = _up(3 / (1.5 * t - 1))  # shared_grams is (3t/2 - 1) * both - 1 or more
    return from_


def prefix_sizes(n: int, t: float) -> dict[int, tuple[int, int]]:
    """For a text of n characters and each q how many of its rarest grams it sends and how many a partner must meet; (0, 0) where no partner asks."""
    short, long = n + _up(n * t / (2 - t)), n + math.floor(n * (2 - t) / t + _SLACK)
    cut = paired_from(t)
    out = {1: (0, 0), 2: (0, 0)}
    if n and (cut is None or short < cut):
        out[1] = _first(n, shared_grams(short, t, 1))
    if n and cut is not None and long >= cut:
        out[2] = _first(n - 1, shared_grams(max(short, cut), t, 2))
    return out


def part_sizes(n: int, t: float) -> dict[int, tuple[int, int]]:
    """The same for a text whose partner holds a part of ratio t or more."""
    pairs = 2 * (1.5 * t - 1) * n / (2 - t) - 1
    if pairs >= 2:
        return {1: (0, 0), 2: _first(n - 1, _up(pairs))}
    return {1: _first(n, _up(n * t / (2 - t))) if n else (0, 0), 2: (0, 0)}


def _first(size: int, shared: int) -> tuple[int, int]:
    meets = max(1, min(MEETS, shared))
    return max(0, min(size, size - shared + meets)), meets


_ROWS = "key string, side int, q int, gram string, size int, meets int, n int"


def _gram_rows(texts: DataFrame, t: float, partial: bool) -> DataFrame:
    """A row for each gram of `texts` (key, side) that any partner may ask for; the empty text has one of its own."""
    sizes = part_sizes if partial else prefix_sizes

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, side in zip(part["key"], part["side"], strict=True):
                own = sizes(len(key), t)
                if not key:
                    rows.append((key, side, 0, "0", 1, 1, 0))
                for q in (1, 2):
                    if partial or own[q][0]:
                        rows += [(key, side, q, g, *own[q], len(key)) for g in grams(key, q)]
            yield pd.DataFrame(rows, columns=["key", "side", "q", "gram", "size", "meets", "n"])

    return texts.mapInPandas(run, _ROWS)


def candidates(left: DataFrame, right: DataFrame, threshold: float, method: str = "ratio") -> DataFrame:
    """(a, b): all pairs of a text of `left` (key) and of `right` (key) whose ratio can reach `threshold`; the ratio is still to be seen."""
    if not 0 < threshold <= 100:
        raise ValueError("the threshold lies above 0 and at 100 at most")
    t, partial = threshold / 100, method == "partial_ratio"
    side = lambda df, k: df.select("key", F.lit(k).alias("side"))
    rows = _gram_rows(side(left, 0).unionByName(side(right, 1)), t, partial)
    counts = rows.groupBy("gram").agg(F.count("*").alias("held"))
    # a text's own grams: as many as it has characters
    ranked = rows.join(counts, "gram").groupBy("key", "side", "q", "size", "meets", "n").agg(F.sort_array(F.collect_list(F.struct("held", "gram"))).alias("all"))
    first = ranked.where("size > 0").select("key", "side", "q", "n", "meets", F.explode(F.slice("all", 1, F.col("size"))["gram"]).alias("gram"))
    sent = lambda df, k, name: df.where(F.col("side") == k).select(F.col("key").alias(name), F.col("n").alias(f"n{name}"), F.col("meets").alias(f"m{name}"), "q", "gram")
    if partial:
        # the shorter text sends its first grams, the longer one all
        every = ranked.select("key", "side", "q", "n", F.lit(MEETS).alias("meets"), F.explode("all.gram").alias("gram"))
        hits = sent(first, 0, "a").join(sent(every, 1, "b"), ["q", "gram"]).where("na <= nb")
        hits = hits.unionByName(sent(every, 0, "a").join(sent(first, 1, "b"), ["q", "gram"]).where("nb < na"))
    else:
        near = (F.least("na", "nb") * (2 - t) + _SLACK) >= F.greatest("na", "nb") * t
        hits = sent(first, 0, "a").join(sent(first, 1, "b"), ["q", "gram"]).where(near)
    met = hits.groupBy("a", "b", "q").agg(F.count("*").alias("hits"), F.first(F.least("ma", "mb")).alias("meets"))
    return met.where("hits >= meets").select("a", "b").distinct()


def rated(pairs: DataFrame, threshold: float, score: Callable[[str, str], float]) -> DataFrame:
    """(a, b, score) of the pairs at `threshold` or more."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [score(a, b) for a, b in zip(part["a"], part["b"], strict=True)]
            yield part.assign(score=found)[[s >= threshold for s in found]]

    return pairs.mapInPandas(run, "a string, b string, score double")


def similar(left: DataFrame, right: DataFrame, threshold: float = 80, method: str = "ratio") -> DataFrame:
    """(a, b, score) of all pairs of texts of `left` and `right` (a column `text` each) whose ratio is `threshold` or more."""
    if method not in RATIOS:
        raise ValueError(f"there are the methods {', '.join(RATIOS)}")
    texts = [df.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct() for df in (left, right)]
    if method != "token_sort_ratio":
        found = candidates(*(x.withColumnRenamed("text", "key") for x in texts), threshold, method)
        return rated(found, threshold, RATIOS[method])
    keyed = [x.withColumn("key", F.array_join(F.array_sort(F.expr(r"filter(split(text, '\\s+'), x -> x <> '')")), " ")) for x in texts]
    found = rated(candidates(*(x.select("key").distinct() for x in keyed), threshold), threshold, ratio)
    a, b = (x.select(F.col("text").alias(n), F.col("key").alias(f"key{n}")) for x, n in zip(keyed, "ab", strict=True))
    return found.withColumnsRenamed({"a": "keya", "b": "keyb"}).join(a, "keya").join(b, "keyb").select("a", "b", "score")
