"""The queries' results against brute force on small fixtures, and their edge cases."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import boosting, decontaminate, line_dedup, packing, quality_classifier, quality_rules, queries, sharding, suffix_dedup, toxicity, voronoi
from tallyfold.llm.common import table
from tallyfold.llm.docstats import COLUMNS, RATIOS, measure, ratios

SF = "/root/testdata/sf0.001"
CLASH = ("mask", "key", "ord", "row", "group", "part", "block", "band", "shard", "i", "c", "h")


def _frame(spark, rows, *clash):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit(1).alias(c) for c in clash))


def _words(r, n, letters="abcdefghijklmnop"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


# 1


def _edits(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def _whole(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_decontamination_against_brute_force(spark):
    r = random.Random(1)
    items = [(k, _words(r, r.choice([3, 12, 25]))) for k in range(6)] + [(6, ""), (7, None)]
    items.append((8, items[0][1]))  # equal items are reported each
    docs = []
    for i in range(40):
        text = _words(r, r.randint(0, 20))
        if r.random() < 0.6:
            item = list(r.choice(items[:6])[1])
            for _ in range(r.choice([0, 1, 3, 9])):
                item[r.randrange(len(item))] = r.choice("xyz")
            text += " " + "".join(item).upper() + " " + _words(r, 3)
        docs.append((i, text))
    docs += [(50, None), (51, ""), docs[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: b" ".join((t or "").encode().lower().split())
    want = collections.Counter()
    for d, t in docs:
        for k, item in items:
            x = norm(item)
            if x and (e := _edits(x, norm(t))) <= decontaminate.budget(len(x)):
                want[d, k, e] += 1
    rows = decontaminate.contaminated(_frame(spark, docs, *CLASH), bench).collect()
    assert collections.Counter((x.doc_id, x.item_id, x.distance) for x in rows) == want and len(want) > 5
    for x in rows:  # the span itself has the distance
        assert _whole(norm(dict(items)[x.item_id]), norm(dict(docs)[x.doc_id])[x.start : x.end]) == x.distance
    assert decontaminate.contaminated(_frame(spark, docs), bench.limit(0)).count() == 0
    clean = {d for d, _ in docs} - {d for d, _, _ in want}
    assert {x.doc_id for x in decontaminate.drop_contaminated(_frame(spark, docs, *CLASH), bench).collect()} == clean


# 2


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.suffix_dedup(_frame(spark, [])).count() == 0
    passage = "".join(random.Random(2).choice("abc") for _ in range(80))
    docs = [(None, passage), (None, "x" + passage), (4, passage), (2, passage + "y"), (2, passage + "y")]
    got = collections.Counter((x.doc_id, x.n_removed, x.n_spans) for x in suffix_dedup.suffix_dedup(_frame(spark, docs, *CLASH)).collect())
    assert got == collections.Counter([(None, 80, 1), (None, 80, 1), (4, 80, 1), (2, 0, 0), (2, 0, 0)])


# 4


def test_line_dedup_repeated_and_null_ids(spark):
    r = random.Random(3)
    a, b = _words(r, 30), _words(r, 30)
    docs = [(None, f"{a}\none"), (None, f"{a}\ntwo"), (7, f"{b}\nthree"), (7, f"{b}\nfour"), (9, f"{a[:-1]}\nfive"), (3, "same\nrow"), (3, "same\nrow"), (1, None), (1, "")]
    got = sorted(((x.doc_id, x.text) for x in line_dedup.line_dedup(_frame(spark, docs, *CLASH)).collect()), key=repr)
    assert sum(t.count(a[:-1]) for _, t in got if t) == 1  # one line of the component, by the least id
    assert any(d == 9 and a[:-1] in t for d, t in got if t)
    assert sum(t.count(b) for _, t in got if t) == 1
    assert sorted(t for d, t in got if d == 3) == ["", "same\nrow"]
    assert [t for d, t in got if d == 1 and t is None] == [None]
    kept = line_dedup.dedup_lines(_frame(spark, docs, *CLASH))
    assert kept.columns == ["doc_id", "text", *CLASH]
    assert kept.where("doc_id = 3").count() == 1


# 6


def _minimax(sizes, shards):
    """The least largest sum of contiguous parts, by trying every cut."""
    return min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *c, len(sizes)))) for k in range(min(shards, len(sizes))) for c in itertools.combinations(range(1, len(sizes)), k))


def test_smallest_capacity_and_balanced_cuts():
    r = random.Random(4)
    for _ in range(60):
        sizes, shards = [r.randint(1, 30) for _ in range(r.randint(1, 9))], r.randint(1, 5)
        capacity = sharding.smallest_capacity(sizes, shards)
        assert capacity == _minimax(sizes, shards)
        ends = sharding.balanced_ends(sizes, capacity, shards)
        parts = [sizes[a:b] for a, b in itertools.pairwise((0, *ends))]
        assert ends[-1] == len(sizes) and len(ends) == shards and max(map(sum, parts)) <= capacity


def test_sharding_with_a_large_group(spark):
    r = random.Random(5)
    docs = [(i, _words(r, 20)) for i in range(400)] + [(1000 + i, "large group " * 20) for i in range(200)] + [(None, None), (None, None), (5, ""), (5, "")]
    rows = sharding.shard_documents(_frame(spark, docs, *CLASH)).collect()
    assert len(rows) == len(docs)
    texts = collections.defaultdict(list)
    for d, t in docs:
        texts[d].append(t or "")
    by, slots = collections.Counter(), collections.defaultdict(list)
    for x in rows:
        assert x.law == "bytes" and x.grown_shard is None
        assert any(x.size == len(t.encode()) + 1 and x.text_crc32 == zlib.crc32(t.encode()) for t in texts[x.doc_id])
        by[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    large = {x.shard for x in rows if x.doc_id and x.doc_id >= 1000}
    assert len(large) == 1 and {x.shard for x in rows if x.doc_id is None} and len({x.shard for x in rows if x.doc_id is None}) == 1
    rest = [n for s, n in by.items() if s not in large]
    assert len(by) == 16 and max(rest) < 1.3 * min(rest)


# 7 and 10


def _walk(f, x):
    total = f.base
    for root in f.roots:
        at = root
        while f.feature[at] >= 0:
            at = f.child[at] + int(x[f.feature[at]] > f.threshold[at])
        total += f.value[at]
    return 1 / (1 + math.exp(-total))


def test_quality_rules_against_brute_force(spark):
    r = random.Random(6)
    docs = [(i, _words(r, r.randint(0, 120)) + r.choice(["", " ###", "\nab\nab\nab", " go on go on go on go on"])) for i in range(60)] + [(60, None), (61, ""), (0, "repeated id")]
    m = measure([(t or "").encode() for _, t in docs])
    y = (m[:, COLUMNS.index("n_symbols")] == 0).astype(float)
    forest = boosting.fit(ratios(m), y, {RATIOS.index(c): -1 for c in quality_rules.FALLING}, boosting.Settings(trees=8, least_rows=3))
    out = quality_rules.quality_rules(_frame(spark, docs, *CLASH), forest)
    assert out.columns[:8] == ["doc_id", *COLUMNS[:5], "base_failed", "kept"]
    want = collections.Counter()
    for (d, t), x in zip(docs, ratios(m), strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = len({j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        want[d, len(w), repeated, failed, not failed and _walk(forest, x) >= 0.5] += 1
    assert collections.Counter((x.doc_id, x.n_words, x.n_repeat_words, x.base_failed, x.kept) for x in out.collect()) == want
    assert len({k[-1] for k in want}) == 2
    kept = quality_rules.keep_good(_frame(spark, docs, *CLASH), forest)
    assert kept.columns == ["doc_id", "text", *CLASH] and kept.count() == sum(n for k, n in want.items() if k[-1])


def test_discriminant_against_densities():
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(0, 1, (80, 4)), rng.normal(1, 2, (60, 4))))
    y = np.repeat([0.0, 1.0], [80, 60])
    model = quality_classifier.fit(x, y)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = (80 * covs[0] + 60 * covs[1]) / 140
    logs = []
    for k, c in enumerate(covs):
        c = 0.9 * c + 0.1 * pooled
        c = 0.98 * c + 0.02 * np.trace(c) / 4 * np.eye(4) + 1e-9 * np.eye(4)
        gap = z - z[y == k].mean(axis=0)
        logs.append(math.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(c), gap))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))
    assert np.allclose(model.log_ratio(x), logs[1] - logs[0])
    assert quality_classifier.fit(x, np.ones(140)).score(x[:3]).tolist() == [1.0] * 3  # one class only


def test_scores_are_calibrated_and_untied():
    rng = np.random.default_rng(9)
    for gap in (0.4, 6.0):  # classes that overlap, and classes that are far apart
        x = np.concatenate((rng.normal(0, 1, (900, 6)), rng.normal(gap, 1.5, (900, 6))))
        y = np.repeat([0.0, 1.0], 900)
        order = rng.permutation(1800)
        x, y = x[order], y[order]
        model = quality_classifier.tuned(x[:1200], y[:1200])
        score, rest = model.score(x[1200:]), y[1200:]
        assert len(np.unique(score)) == 600 and (0 < score).all() and (score < 1).all()
        assert (np.argsort(score) == np.argsort(model.log_ratio(x[1200:]))).all()
        plain = quality_classifier.fit(x[:1200], y[:1200]).score(x[1200:])
        loss = [-np.mean(np.where(rest == 1, np.log(p), np.log1p(-p))) for p in (score, np.clip(plain, 1e-12, 1 - 1e-12))]
        assert loss[0] < loss[1] + 0.02
        for low in (0.0, 0.25, 0.5, 0.75):
            part = (score >= low) & (score < low + 0.25)
            assert part.sum() < 30 or abs(score[part].mean() - rest[part].mean()) < 0.15
    few = quality_classifier.tuned(x[:12], y[:12])
    assert few.line is None and quality_classifier.tuned(x[:5], np.ones(5)).score(x[:2]).tolist() == [1.0, 1.0]


def test_quality_scores_of_documents_differ(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_classifier.fit_classifier(docs, labels)
    scores = quality_classifier.quality_scores(docs, model).toPandas()
    per_text = docs.select("doc_id", "text").dropDuplicates(["text"]).select("doc_id").toPandas().merge(scores, on="doc_id")
    assert per_text.score.duplicated(keep=False).mean() <= 0.01
    held = scores.merge(labels.toPandas(), on="doc_id").query("held_out")
    p = held.score.clip(1e-12, 1 - 1e-12)
    assert -np.mean(np.where(held.quality == 1, np.log(p), np.log1p(-p))) < 0.05 and (held.predicted == held.quality).mean() > 0.98


# 8


def test_chain_folds_and_scores(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (200, 6)).astype(float)
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    fold = np.arange(200) % toxicity.FOLDS
    terms = [["a", "b", "c"], ["a", "b", "d"], ["a", "b"], ["b", "c"], ["a", "e"], ["a", "b", "c", "d", "e", "f"]]
    chain = toxicity.fit_chain(terms, x, y, fold)
    assert chain.terms == terms[-1] and [len(w) for w in chain.weights] == [7, 8, 9]  # each model reads one earlier category more
    # scores by hand: every category from the terms and the logits of the earlier ones
    p = np.zeros((200, 0))
    for w in chain.weights:
        z = np.column_stack((x, np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3)))))
        p = np.column_stack((p, 1 / (1 + np.exp(-(z @ w[1:] + w[0])))))
    assert np.allclose(chain.score(x), p) and ((p[:, 2] > 0.5) == (y == 1)).mean() > 0.85
    assert toxicity.fit_chain(terms, x, np.zeros(200), fold).score(x[:2]).tolist() == [[0.0] * 3] * 2
    r = random.Random(8)
    docs = [(i, _words(r, 30) + (" vileword" if i % 3 == 0 else "")) for i in range(120)] + [(200, None), (0, "repeated id")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    df = _frame(spark, docs, *CLASH)
    got = toxicity.toxicity_scores(df, toxicity.fit_toxicity(df, labels)).collect()
    assert len(got) == len(docs) and {x.doc_id for x in got if x.is_toxic} == {i for i in range(120) if i % 3 == 0}


# 9


def test_linked_sets_share_a_region():
    rng = np.random.default_rng(9)
    base = [np.unique(rng.integers(0, 1 << 62, rng.integers(20, 200)).astype(np.uint64)) for _ in range(12)]
    sets = []
    for _ in range(300):
        s = base[rng.integers(12)]
        keep = s[rng.random(len(s)) > rng.choice([0, 0.05, 0.1, 0.3])]
        more = rng.integers(0, 1 << 62, int(rng.choice([0, 2, 10, 60]))).astype(np.uint64)
        other = base[rng.integers(12)][: int(rng.choice([0, 0, 30]))]
        sets.append(np.unique(np.concatenate((keep, more, other))))
    rounds = [voronoi.Pivots([1000 + i for i in range(6)], [voronoi.ROOT] * 6, base[:6])]
    first, _ = voronoi.regions_of(sets, rounds)
    inner = next(r for x in first for r, _ in x if r != voronoi.part_of(voronoi.ROOT, 0))
    rounds.append(voronoi.Pivots([2000, 2001, 2002], [voronoi.part_of(voronoi.ROOT, 0)] * 2 + [inner], base[6:9]))
    regions, _ = voronoi.regions_of(sets, rounds)
    seen = 0
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            seen += 1
            x, y = dict(regions[i]), dict(regions[j])
            assert any(abs(x[r] - y[r]) <= voronoi.REACH + 1e-5 for r in x.keys() & y.keys())
    assert seen > 50 and len({r for x in regions for r, _ in x}) > 4


# the pipeline


def _pipeline_tables(spark, folder):
    r = random.Random(10)
    good = [_words(r, 80) for _ in range(40)]
    shared = _words(r, 25)
    item = _words(r, 30, "qrstuvwxyz")
    near = good[0].split()
    near[5] = "changed"
    docs = [(i, t) for i, t in enumerate(good)] + [(50, good[1]), (51, " ".join(near)), (52, f"{good[2]}\n{shared}\n{_words(r, 60)}"), (53, f"{_words(r, 70)}\n{shared}"), (54, f"{_words(r, 60)} {item} {_words(r, 10)}"), (55, "too short"), (56, None), (57, "")]
    rows = [(i, t, "en", "web", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(docs), shared


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, shared = _pipeline_tables(spark, str(tmp_path))
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = spark.createDataFrame(stage(spark, current, str(tmp_path)).collect(), current.schema)
        assert current.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = {x.doc_id: x.text for x in current.collect()}
    assert set(left["quality_rules"]) == set(docs) - {55, 56, 57}
    lines = left["line_dedup"]
    # equal lines: the first document keeps them; 51 differs from 0 in one word of a long line, 50 is a copy of 1
    assert 50 not in lines and shared in lines[52] and shared not in lines[53]
    assert not any(docs[2] in t for d, t in lines.items() if d == 52)
    joined = left["jaccard_join"]
    assert 51 not in joined or 0 not in joined
    assert set(joined) <= set(lines) and {i for i in range(1, 40)} <= set(joined)
    assert set(left["decontamination"]) == set(joined) - {54}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in pieces} == set(left["decontamination"])
    tokens = collections.Counter()
    for x in pieces:
        tokens[x.doc_id] += x.length
    assert all(tokens[x.doc_id] == x.doc_tokens for x in pieces)


# every byte, every length


def _holders(segments, smallest):
    of = {}
    for b, i in zip(segments, smallest, strict=True):
        for p in range(len(b) - suffix_dedup.LENGTH + 1):
            x = b[p : p + suffix_dedup.LENGTH]
            of[x] = min(of.get(x, i), i)
    return of


@pytest.mark.parametrize("letters", [b"\x00a", b"\x00\x01", b"\x00\xff\xfe", b"ab"])
def test_smallest_holders_count_every_byte(letters):
    r = random.Random(len(letters) + letters[-1])
    for _ in range(40):
        base = [bytes(r.choice(letters) if r.random() < 0.5 else letters[0] for _ in range(r.randint(40, 90))) for _ in range(3)]
        segments = list({(b"\x00" * r.choice([0, 0, 1, 2, 60]) + r.choice(base) + r.choice(base)[: r.randint(0, 9)])[:84] for _ in range(12)})
        segments = [b for b in segments if len(b) >= suffix_dedup.LENGTH]
        smallest = np.array([r.randrange(50) for _ in segments], np.int64)
        data = [np.frombuffer(b, np.uint8).astype(np.uint16) + 1 for b in segments]
        text = np.concatenate([np.append(x, 0) for x in data]).astype(np.uint16 if 255 in letters else np.uint8)
        got = suffix_dedup.smallest_holders(text, np.array([len(b) for b in segments]), smallest)
        of, at = _holders(segments, smallest.tolist()), 0
        for b in segments:
            for p in range(len(b) - suffix_dedup.LENGTH + 1):
                assert got[at + p] == of[b[p : p + suffix_dedup.LENGTH]]
            at += len(b) + 1


@pytest.mark.parametrize("letters", ["\x00ab", "\x00", "\x00\x01é"])
def test_suffix_dedup_with_nul(spark, monkeypatch, letters):
    from test_llm import _cut_brute

    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 60_000)
    r = random.Random(len(letters))
    base = ["".join(r.choice(letters) if r.random() < 0.7 else "\x00" for _ in range(r.randint(40, 160))) for _ in range(8)]
    rows = [(i, "".join(r.choice(base)[r.randint(0, 20) :] + "\x00" * r.choice([0, 1, 60]) for _ in range(r.randint(0, 4)))) for i in range(60)]
    rows += [(70, "x" * 200_000 + base[0]), (71, "y" + "x" * 300 + base[0])]  # a long run of one letter
    assert collections.Counter(tuple(x) for x in suffix_dedup.suffix_dedup(_frame(spark, rows, *CLASH)).collect()) == _cut_brute(rows)


BLANKS = {"spaces": "a" + " " * 2_000_000 + "b", "tabs": "\t" * 1_200_000, "mixed": " \n\t" * 500_000 + "word " * 1000}


def test_packing_of_long_blanks(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [(i, t) for i, t in enumerate(BLANKS.values())] + [(9, "short one")]
    rows = packing.pack(_frame(spark, docs, *CLASH)).collect()
    for i, t in docs:
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4")
        parts = sorted((x.start, x.length, x.ids_crc32, x.doc_tokens) for x in rows if x.doc_id == i)
        assert sum(n for _, n, _, _ in parts) == len(ids) == parts[0][3]
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c, _ in parts)


def test_pipeline_with_long_blanks_repeated_rows_and_further_columns(spark, tmp_path):
    _pipeline_tables(spark, str(tmp_path))
    r = random.Random(12)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    long = _words(r, 80) + " " * 1_200_000 + _words(r, 80)
    more = spark.createDataFrame([(80, long, "en", "web", len(long)), (None, _words(r, 90), None, None, None)], docs.schema)
    clash = docs.unionByName(more).unionByName(docs.where("doc_id = 5")).select("*", *(F.lit(1).alias(c) for c in CLASH))
    clash.write.parquet(f"{tmp_path}/wide/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/wide/{t}.parquet")
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/wide").collect()
    assert {80, None, 5} <= {x.doc_id for x in pieces}
    assert sum(x.start == 0 for x in pieces if x.doc_id == 5) == 1


def test_pipeline_over_an_empty_table(spark, tmp_path):
    _pipeline_tables(spark, str(tmp_path))
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
