"""Fill-in-the-middle, SimHash near-duplicates and the divergence audit against brute force, with their edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyfold.llm import divergence, fill_middle, simhash
from tallyfold.llm.gray_index import GrayIndex, gray_rank

CLASH = ("row", "of", "n", "first", "place", "units", "f", "path", "cell", "shard", "term", "p", "own", "component", "node", "count")


def _frame(spark, rows, *clash):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit(1).alias(c) for c in clash))


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def _middle(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = _sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, _sha(text), _sha(text)
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), _sha(f"<S>{s}<P>{p}<M>{m}"), _sha(text)
    return doc_id, n, "psm", len(p), len(m), _sha(f"<P>{p}<S>{s}<M>{m}"), _sha(text)


def test_fill_in_middle_against_brute_force(spark):
    r = random.Random(1)
    chars = ["a", "bc", "Q", " ", "\n", "<", ">", "P", "é", "日", "😀", "\x00", "\r\n", "\u2028", "7", "."]
    docs = [(i, "".join(r.choice(chars) for _ in range(r.choice([0, 1, 2, 63, 64, 65, 128, 129, 400])))) for i in range(200)]
    docs += [(900, None), (901, ""), (902, "a <P> b"), (903, "x<M>"), (904, "no <S>"), (905, "<P"), (None, "one two three"), (None, None), docs[7], docs[7], (-5, "ab cd ef")]
    docs.append((906, "word " * 300_000 + "x" * 500_000 + " " * 500_000))  # a very long text, with very long units
    got = collections.Counter(map(tuple, fill_middle.fill_in_middle_digest(_frame(spark, docs, *CLASH)).collect()))
    want = collections.Counter(_middle(*d) for d in docs)
    assert got == want
    assert {"plain", "psm", "spm"} == {x[2] for x in want}
    assert fill_middle.fill_in_middle_digest(_frame(spark, [])).count() == 0


def test_fill_in_middle_outputs(spark):
    docs = [(i, f"alpha {i} beta, gamma < S>") for i in range(50)]
    for x in fill_middle.fill_in_middle(_frame(spark, docs)).collect():
        if x.form == "psm":
            p, rest = x.output.removeprefix("<P>").split("<S>")
            s, m = rest.split("<M>")
        elif x.form == "spm":
            s, rest = x.output.removeprefix("<S>").split("<P>")
            p, m = rest.split("<M>")
        else:
            p, m, s = x.output, "", ""
        assert p + m + s == x.text


# 12


def _fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _least(ids, words):
    above = list(range(len(ids)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (words[i] ^ words[j]).bit_count() <= 3:
            above[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


def test_gray_ranks_walk_the_code():
    code = np.arange(1 << 10, dtype=np.uint64)
    code ^= code >> np.uint64(1)
    assert gray_rank(code).tolist() == list(range(1 << 10))


@pytest.mark.parametrize("n, spread", [(0, 3), (1, 3), (720, 3), (2000, 6)])
def test_gray_index_finds_all_near_pairs(n, spread):
    r = np.random.default_rng(n)
    words = r.integers(0, 1 << 63, max(1, n // 40), dtype=np.uint64).repeat(40)[:n]
    for _ in range(spread):
        words = words ^ (np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64))
    words = np.unique(words)
    group = r.integers(0, 2, len(words))
    order = np.lexsort((gray_rank(words), group))
    words, group = words[order], group[order]
    index = GrayIndex(words, group)
    found = [set(zip(i.tolist(), j.tolist(), strict=True)) for i, j in index.near_pairs(np.searchsorted(index.group, group), 3)]
    near = (np.bitwise_count(words[:, None] ^ words) <= 3) & (group[:, None] == group)
    assert set().union(*found) == {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True) if i < j}
    for k in range(len(index.children)):  # no bit is held twice on the way down
        above = np.repeat(index.masks[k + 1], np.diff(index.children[k]))
        assert not (above & index.masks[k]).any()


@pytest.mark.parametrize("cell", [simhash.CELL, 5])
def test_simhash_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)  # with 5, cells are cut again and again
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    docs, base = [], []
    for i in range(120):
        text = " ".join(word() for _ in range(r.choice([0, 1, 2, 3, 30, 150])))
        docs.append((i, text))
        if len(text) > 300:
            base.append(text.split(" "))
    for i in range(150):  # chains of small changes
        words = base[i % len(base)]
        words[r.randrange(len(words))] = word()
        docs.append((200 + i, " ".join(words)))
    docs += [(900, None), (901, ""), (902, " \n\t"), (None, "lone words here now"), (None, docs[3][1]), docs[5], docs[5], (903, docs[9][1].upper()), (904, "É é\x00 x  y")]
    docs.append((905, "a b c d " * 200_000))
    words = [_fingerprint(t) for _, t in docs]
    want = collections.Counter((d, f"{w:016x}", c) for (d, _), w, c in zip(docs, words, _least([d for d, _ in docs], words), strict=True))
    assert len({c for *_, c in want}) < len(set(words)) - 10  # links beyond equal fingerprints
    assert collections.Counter(map(tuple, simhash.simhash(_frame(spark, docs, *CLASH)).collect())) == want
    assert simhash.simhash(_frame(spark, [])).count() == 0


# 13


def _audit(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, holders = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        counts[lang or "", source or ""].update(words)
        holders[lang or ""].update(set(words))
    rows = []
    for lang, df in holders.items():
        kept = sorted(t for t, k in df.items() if k >= 30)
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(groups.values(), collections.Counter())

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s, own in groups.items():
            pairs = [(t, sum(abs(p[s][k] - p[t][k]) for k in kept)) for t in groups if t != s]
            terms = [(k, p[s][k] - q[k]) for k in kept if own[k] and p[s][k] > q[k]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                rows += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(found, 1) if part == "pair" or i <= 50]
    return collections.Counter(rows)


@pytest.mark.parametrize("heavy, tile_terms, tile_groups", [(16, 2048, 256), (4, 5, 3), (1, 7, 2), (99, 10, 4)])
def test_divergence_against_brute_force(spark, heavy, tile_terms, tile_groups):
    r = random.Random(6)
    vocabulary = {"en": ["The", "the", "of", "x-y", "don't", "naïve", "Ünder", "日本", "a1b", "\x00nul"] + [f"w{'abcdefghij'[k % 10]}{'klmnop'[k // 10]}" for k in range(60)], "de": ["und", "ÜBER", "über"], None: ["alone"]}
    docs = []
    for i in range(700):
        lang = r.choice(["en", "en", "en", "de", None])
        source = r.choice(["a", "B", "é", "b", None, "", "z z", "日"])
        words = vocabulary[lang]
        seed = len(source or "") + ord((source or "q")[0])
        docs.append((i, " ".join(words[int(r.random() ** 2 * len(words) + seed * 7) % len(words)] for _ in range(r.randint(0, 30))), lang, source))
    docs += [(None, None, "en", "none"), (800, "", "fr", "x"), (801, None, "fr", "y"), (802, "rare words only", "fr", "w"), docs[3], docs[3]]
    docs.append((803, "the of " * 200_000, "en", "long"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    clash = df.select("*", *(F.lit(1).alias(c) for c in (*CLASH, "docs", "item", "value", "rank", "kept", "heavy", "weight", "tile", "low", "high")))
    want = _audit(docs)
    assert len({x[3] for x in want if x[2] == "term"}) > 40 and any(x[0] == "fr" and x[4] == 0 for x in want)
    assert collections.Counter(map(tuple, divergence.divergence(clash, heavy, tile_terms, tile_groups).collect())) == want
    assert divergence.divergence(df.limit(0), heavy, tile_terms, tile_groups).count() == 0
