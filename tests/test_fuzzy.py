"""The join of similar texts equals all pairs, at every threshold and length."""

from __future__ import annotations

import random

import pytest

from tallyfold.operators import fuzzy


def _texts(r, n, letters, longest):
    out = ["".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(n)]
    for t in out[: n // 2]:  # near copies
        chars = list(t)
        for _ in range(r.randint(1, 4)):
            at = r.randint(0, len(chars))
            if r.random() < 0.5:
                chars.insert(at, r.choice(letters))
            elif chars:
                chars.pop(at % len(chars))
        out.append("".join(chars))
    return out


@pytest.mark.parametrize("method, threshold, letters, longest", [
    ("ratio", 80, "abcd ", 30), ("ratio", 95, "ab", 40), ("ratio", 66, "abcdefgh", 12), ("ratio", 30, "abc", 9), ("ratio", 100, "abé日", 6),
    ("partial_ratio", 80, "abcdef", 18), ("partial_ratio", 55, "abcdef", 8), ("partial_ratio", 95, "abc", 30), ("token_sort_ratio", 75, "ab c", 24),
])
def test_similar_equals_all_pairs(spark, method, threshold, letters, longest):
    r = random.Random(threshold)
    texts = _texts(r, 120, letters, longest)
    left, right = [*texts[::2], None, ""], [*texts[1::2], *texts[:10], None]
    score = fuzzy.RATIOS[method]
    want = {(a, b, score(a, b)) for a in set(left) - {None} for b in set(right) - {None} if score(a, b) >= threshold}
    got = fuzzy.similar(*(spark.createDataFrame([(t,) for t in x], "text string") for x in (left, right)), threshold, method).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want and len(want) > 5


def test_bounds_hold_for_every_pair():
    r = random.Random(0)
    for _ in range(3000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 25))) for _ in range(2))
        if r.random() < 0.7:
            b = "".join(c for c in a if r.random() < 0.9) or "a"
        t = fuzzy.ratio(a, b) / 100
        for q in (1, 2):
            both = len(set(fuzzy.grams(a, q)) & set(fuzzy.grams(b, q)))
            assert both >= fuzzy.shared_grams(len(a) + len(b), t, q)


def test_few_pairs_are_compared(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(300)]
    texts = [(" ".join(r.choice(words) for _ in range(4)),) for _ in range(2000)]
    left, right = (spark.createDataFrame(x, "key string") for x in (texts[:1000], texts[1000:] + texts[:50]))
    pairs = fuzzy.candidates(left, right, 85)
    assert pairs.count() < 0.1 * 1000 * 1050 and fuzzy.rated(pairs, 100, fuzzy.ratio).count() >= 50


def test_edges(spark):
    empty, some = spark.createDataFrame([], "text string"), spark.createDataFrame([("",), ("a",), (None,)], "text string")
    assert fuzzy.similar(empty, some).count() == fuzzy.similar(some, empty).count() == 0
    assert sorted(map(tuple, fuzzy.similar(some, some).collect())) == [("", "", 100.0), ("a", "a", 100.0)]
    for wrong in (0, 101):
        with pytest.raises(ValueError):
            fuzzy.similar(some, some, wrong)
    long = spark.createDataFrame([("x y " * 3000,), ("x y " * 3000 + "z",)], "text string")
    assert fuzzy.similar(long, long, 99).count() == 4
