"""The corpus operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import boosting, components, decontaminate, docstats, jaccard_join, line_dedup, packing, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts, toxicity
from tallyfold.llm.common import table
from tallyfold.llm.suffix_array import permuted_lcp, suffix_array

SF = "/root/testdata/sf0.001"
EDGE = [(1, ""), (2, None), (None, "A null id is here, with some words of its own."), (3, "x" * 3000), (4, "same line\nsame line\n"), (4, "same line\nsame line\n"), (5, "a<|endoftext|>b  \n\n  c"), (6, "ﬁn é ñ 中文\t|%|")]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("mask", F.lit(1)).withColumn("key", F.lit("k")).withColumn("ord", F.lit(0))


@pytest.fixture(scope="module")
def edge(spark):
    return _frame(spark, EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return _frame(spark, [])


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(200):
        t = rng.integers(0, rng.choice([1, 2, 3, 255]) + 1, rng.integers(0, 60)).astype(np.uint8)
        b = bytes(t)
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        lcp = permuted_lcp(t, sa)
        for r in range(1, len(b)):
            x, y = b[sa[r] :], b[sa[r - 1] :]
            n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert lcp[sa[r]] == n


def _cut_brute(rows, length=50):
    last = 2**63 - 1
    owner: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            owner[b[p : p + length]] = min(owner.get(b[p : p + length], last), last if i is None else i)
    out = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if owner[b[p : p + length]] < (last if i is None else i):
                gone[p : p + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_dedup(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 60_000)
    r = random.Random(seed)
    base = ["".join(r.choice("abcde é\n") for _ in range(r.randint(10, 200))) for _ in range(12)]
    rows = [(r.choice([i, r.randint(0, 60)]), "".join(r.choice(base)[r.randint(0, 20) :] for _ in range(r.randint(0, 4)))) for i in range(60)]
    rows += [*EDGE, (7, "y" * 49), (8, "y" * 51)]
    assert collections.Counter(tuple(x) for x in suffix_dedup.suffix_dedup(_frame(spark, rows)).collect()) == _cut_brute(rows)


def test_token_counts(spark, edge, empty):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(edge).collect())
    assert got == collections.Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in EDGE)
    assert token_counts.token_counts(empty).count() == 0
    r = random.Random(2)
    for _ in range(500):
        t = "".join(r.choice("ab cd  é\n.,1x<s> ") for _ in range(r.randint(0, 80)))
        assert sum(len(sp.encode(p)) for p in token_counts.split_text(t, 5)) == len(sp.encode(t))


def test_packing(spark, edge, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = edge.unionByName(table(spark, SF, "documents").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True)
    rows = packing.pack(docs).collect()
    texts = collections.defaultdict(list)
    for i, t in docs.select("doc_id", "text").collect():
        texts[i].append(np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    assert sum(r.length for r in rows) == sum(len(x) for v in texts.values() for x in v)
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in texts[r.doc_id])
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty).count() == 0


def test_first_fit_decreasing():
    sizes = np.random.default_rng(1).integers(1, 1025, 300)
    bins, _ = packing.first_fit_decreasing(sizes)
    free: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        free += [1024] * (b == len(free))
        free[b] -= sizes[i]
        assert bins[i] == b


def test_sharding(spark, edge, empty):
    docs = edge.unionByName(table(spark, SF, "documents").select("doc_id", "text"), allowMissingColumns=True)
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == docs.count()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(collections.Counter({s: 0 for s in range(4)} | {}).keys()) == 3
    sizes = collections.Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.1 * sum(sizes.values())
    hashed = docs.select(F.xxhash64("text").alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("s")).groupBy("h").agg(F.sum("s").alias("s")).orderBy("h").collect()
    assert max(sizes.values()) == sharding.smallest_capacity([r.s for r in hashed], 4)
    assert sharding.shard_documents(empty).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {x: got[x] for x in ()}


def test_line_dedup(spark, edge, empty):
    r = random.Random(1)
    base = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(40)) for _ in range(20)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 5)):
            w = r.choice(base).split(" ")
            if r.random() < 0.5:
                w[r.randrange(len(w))] = "zzz"
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines + r.choice([[], [""], ["  "], ["short"], ["\t"]]))))
    docs += [(90, None), (91, ""), docs[3]]
    got = line_dedup.line_dedup(_frame(spark, docs)).collect()

    def shingles(line):
        b = line.encode()
        return {b[i : i + 12] for i in range(max(1, len(b) - 11))}

    sets = {x: shingles(x) for _, t in docs if t for x in t.split("\n") if x.strip()}
    names = sorted(sets)
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    keep: dict = {}
    for d, p, x in sorted((d, p, x) for d, t in docs if t for p, x in enumerate(t.split("\n")) if x.strip()):
        keep.setdefault(find(x), (d, p))
    want = {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or keep[find(x)] == (d, p)) for d, t in docs}
    assert len(got) == len(docs)
    assert sum(want[x.doc_id] != x.text for x in got) <= 2  # banding may miss a link
    assert line_dedup.line_dedup(empty).count() == 0
    kept = line_dedup.dedup_lines(edge)
    assert kept.columns == edge.columns
    assert kept.where("doc_id = 4").select("text").first()[0].startswith("same line")


def test_line_dedup_long_lines_by_all_shingles(spark):
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    docs, near = [], []
    for i in range(20):
        short, long = [word(2) for _ in range(8)], [word(15) for _ in range(9)]
        edited = [*short[:5], "##", *short[6:]]  # one edit: Jaccard above 0.8, but a third of the word beginnings change
        docs += [(2 * i, " ".join(short + long)), (2 * i + 1, " ".join(edited + long))]
        near.append(2 * i + 1)
        far = [word(16) for _ in range(10)]  # edits past the first 12 bytes of each word: beginnings stay, Jaccard is far below 0.8
        docs += [(1000 + 2 * i, " ".join(far)), (1001 + 2 * i, " ".join(x[:13] + "#" + x[14:] for x in far))]
    gone = {x.doc_id for x in line_dedup.line_dedup(_frame(spark, docs)).where("n_removed > 0").collect()}
    assert gone <= set(near)
    assert len(gone) >= 19  # banding may miss a link


def test_line_dedup_large_buckets(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).replace("  ", "xy")
    form, docs = text(94), []  # forms share about 0.6 of their shingles and so bands; copies have a Jaccard of about 0.95
    for i in range(300):
        line = form + text(26)
        docs += [(2 * i, f"q{line}q"), (2 * i + 1, f"q{line[:-3]}###q")]
    gone = [x.doc_id for x in line_dedup.line_dedup(_frame(spark, docs)).where("n_removed > 0").collect()]
    assert all(x % 2 for x in gone)
    assert len(gone) >= 295  # banding may miss a link


def _links_brute(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    last, least = 2**63 - 1, {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), last), last if d is None else d)
    return collections.Counter((d, len(sets[i]), None if least[find(i)] == last else least[find(i)]) for i, (d, _) in enumerate(docs))


def test_jaccard_join(spark, edge, empty):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 5))) for _ in range(300)]
    base = [[r.choice(words) for _ in range(r.choice([3, 5, 8, 30, 60, 120]))] for _ in range(15)]
    passage = [r.choice(words) for _ in range(60)]
    docs = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append((i, " ".join(w + (passage if r.random() < 0.2 else []))))
    docs += [(None, docs[0][1]), (500, None), (501, ""), (502, " \n "), docs[3], (3, "another text with the id of another row"), (503, "A b C"), (504, "a B c")]
    assert collections.Counter(tuple(x) for x in jaccard_join.jaccard_join(_frame(spark, docs)).collect()) == _links_brute(docs)
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert jaccard_join.one_of_each(edge).columns == edge.columns


def test_one_of_each_with_null_and_repeated_ids(spark):
    r = random.Random(9)
    a, b, c, d, e, f = (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(6))
    near = a + " end"
    docs = [(1, a), (None, near), (None, b), (2, c), (2, d), (3, d), (4, e), (4, e), (None, f), (None, f), (0, c), (None, None), (None, None)]
    got = collections.Counter((x.doc_id, x.text) for x in jaccard_join.one_of_each(_frame(spark, docs)).collect())
    assert got == collections.Counter([(1, a), (None, b), (2, d), (4, e), (None, f), (0, c), (None, None), (None, None)])


def test_decontamination(spark, empty):
    item = "the quick brown fox jumps over the lazy dog and then it runs away from the very angry farmer who owns the field"
    near = item.replace("quick", "quack").replace("angry", "angri")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    docs = _frame(spark, [(1, f"before {item} after"), (2, f"Before {near.upper()}\nafter"), (3, "the quick brown fox"), *[(None, None), (5, "")]])
    got = {r.doc_id: r.distance for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {1: 0, 2: 2}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {3, None, 5}
    assert decontaminate.contaminated(empty, bench).count() == 0

    def edits(a, b):  # of a to any substring of b
        row = [0] * (len(b) + 1)
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    r = random.Random(4)
    for _ in range(200):
        a, b = (bytes(r.choice(b"abc") for _ in range(r.randint(1, 12 if k else 8))) for k in range(2))
        assert decontaminate.myers(a, b)[0] == edits(a, b)


def test_document_statistics():
    r = random.Random(6)
    for _ in range(100):
        t = "".join(r.choice("ab \n#é|") for _ in range(r.randint(0, 60)))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        m = dict(zip(docstats.COLUMNS, docstats.measure([t.encode()])[0], strict=True))
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))


def test_boosting_is_monotone():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 3))
    y = ((x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) + 0.2 * rng.normal(size=2000)) < 0.6).astype(float)
    f = boosting.fit(x, y, {0: -1})
    grid = np.repeat(x[:50], 20, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 20), 50)
    assert (np.diff(f.raw(grid).reshape(50, 20), axis=1) <= 1e-12).all()
    assert ((f.score(x) > 0.5) == (y == 1)).mean() > 0.85


def test_quality(spark, edge, empty):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    forest, model = quality_rules.fit_rules(docs, labels), quality_classifier.fit_classifier(docs, labels)
    held = quality_classifier.quality_scores(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.9
    assert quality_rules.quality_rules(edge, forest).where("not kept").count() == len(EDGE)
    assert quality_classifier.quality_scores(edge, model).where("score between 0 and 1").count() == len(EDGE)
    assert quality_rules.quality_rules(empty, forest).count() == quality_classifier.quality_scores(empty, model).count() == 0
    assert quality_rules.keep_good(edge, forest).columns == edge.columns
    none = labels.limit(0)
    assert quality_rules.quality_rules(edge, quality_rules.fit_rules(docs, none)).count() == len(EDGE)


def test_toxicity(spark, edge, empty):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    chain = toxicity.fit_toxicity(docs, labels.where("doc_id % 4 <> 2"))
    held = toxicity.toxicity_scores(docs, chain).join(labels, "doc_id").where("doc_id % 4 = 2").toPandas()
    assert (held.is_toxic == (held.toxic == 1)).mean() > 0.97
    assert toxicity.toxicity_scores(edge, chain).where("is_toxic").count() == 0
    assert toxicity.toxicity_scores(empty, chain).count() == 0
    assert toxicity.toxicity_scores(edge, toxicity.fit_toxicity(docs, labels.limit(0))).where("is_toxic").count() == 0
