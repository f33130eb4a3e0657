"""Crowds of lines that share bands and stay below the threshold: all links are found, and few other pairs leave the join."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyfold.llm import line_dedup


def _shingle_set(line: str) -> set[bytes]:
    b = line.encode()
    return {b[i : i + 12] for i in range(max(1, len(b) - 11))}


def _crowd(n: int, seed: int = 5) -> list[str]:
    """Copies of one line of 450 letters with one to six words of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    base = [word() for _ in range(50)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(1 + i % 6):
            words[rng.randrange(50)] = word()
        out.append(" ".join(words))
    return out


def test_crowd_links_are_those_of_brute_force(spark):
    lines = _crowd(90)
    sets = [_shingle_set(x) for x in lines]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    signatures = line_dedup.cut(line_dedup._signatures(line_dedup._lines(line_dedup._keyed(docs))))
    names = {r["line"]: r["h"] for r in line_dedup._lines(line_dedup._keyed(docs)).collect()}
    held = {r["h"]: tuple(r[f"v{k}"] for k in range(6)) for r in signatures.collect()}
    mins = [held[names[x]] for x in lines]
    root = list(range(len(lines)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            same = [a == b for a, b in zip(mins[i], mins[j], strict=True)]
            band = any(same[k] and same[(k + 1) % 6] for k in range(6))
            if band and sum(same) >= line_dedup.AGREE and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = sorted(r.doc_id for r in line_dedup.line_dedup(docs).where("n_removed = 0").collect())
    assert kept == [i for i in range(len(lines)) if find(i) == i]
    assert 1 < len(kept) < len(lines)


def test_few_pairs_below_the_threshold_leave_the_join(spark):
    lines = _crowd(240)
    sets = [_shingle_set(x) for x in lines]
    links = sum(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i in range(len(lines)) for j in range(i))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    rows = line_dedup._lines(line_dedup._keyed(docs))
    found = rows.select("h", F.col("line").cast("binary").alias("line"))
    members = line_dedup._members(rows.select(F.lit(0).cast("long").alias("p"), "h"), found, line_dedup._signatures(rows))
    sizes = {r["h"]: r["n"] for r in members.select("h", "n").collect()}
    assert sorted(sizes.values()) == sorted(map(len, sets))
    live = line_dedup.cut(members.withColumn("part", F.col("h")).withColumn("chunks", F.lit(3).cast("long")))
    pairs = line_dedup._meeting(live, live, once=True)
    assert pairs.count() < links + 0.1 * len(lines) * (len(lines) - 1) / 2


def test_a_pair_of_several_crowds_leaves_the_join_once(spark):
    lines = _crowd(60)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    rows = line_dedup._lines(line_dedup._keyed(docs))
    found = rows.select("h", F.col("line").cast("binary").alias("line"))
    crowds = rows.select(F.explode(F.array(*(F.lit(p).cast("long") for p in range(3)))).alias("p"), "h")
    members = line_dedup._members(crowds, found, line_dedup._signatures(rows))
    live = line_dedup.cut(members.withColumn("part", F.col("h")).withColumn("chunks", F.lit(2).cast("long")))
    alone = line_dedup.cut(live.where("p = 0").withColumn("ps", F.array(F.lit(0).cast("long"))))
    pairs = line_dedup._meeting(live, live, once=True)
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(tuple, line_dedup._meeting(alone, alone, once=True).collect()))
    assert sorted(map(tuple, pairs.collect())) == want and want


def test_texts_are_split_and_sets_made_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    rows = line_dedup._lines(line_dedup._keyed(docs))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(rows).count("split(") == 1
    found = line_dedup.cut(rows.select("h", F.col("line").cast("binary").alias("line")))
    members = line_dedup._members(rows.select(F.lit(0).cast("long").alias("p"), "h"), found, line_dedup._signatures(rows))
    assert plan(members).count("array_distinct(") == 1


def test_places_are_read_back(spark):
    ids = [-(1 << 63), -5, -1, 0, 7, (1 << 63) - 1]
    keys = [-(1 << 63), -1, 0, 1 << 40, (1 << 63) - 1]
    rows = spark.createDataFrame([(o, k, p) for o in ids for k in keys for p in (0, 3, (1 << 31) - 1)], "ord long, key long, pos int")
    got = rows.select("*", line_dedup._at().alias("at")).select("ord", "key", "pos", F.struct(*line_dedup._place("at")).alias("x"))
    assert all(tuple(r.x) == (r.ord, (r.key % (1 << 64)) >> 32, r.pos) for r in got.collect())
