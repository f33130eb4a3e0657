"""Modularity and its greatest partition, against direct computation."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tallyfold.session import Session
from tallyfold.stats import network


def _q(edges, label):
    k, inside, m2 = {}, 0.0, 2 * sum(w for *_, w in edges)
    for a, b, w in edges:
        k[label[a]] = k.get(label[a], 0) + w
        k[label[b]] = k.get(label[b], 0) + w
        inside += 2 * w * (label[a] == label[b])
    return inside / m2 - sum((v / m2) ** 2 for v in k.values())


def _frame(spark, edges):
    return network.build(spark.createDataFrame(edges, "a string, b string, w double"), "a", "b", "w")


def _planted(groups=6, size=12, seed=2):
    r = random.Random(seed)
    nodes = [f"n{g:02d}.{i:02d}" for g in range(groups) for i in range(size)]
    return [(a, b, 1.0) for a, b in itertools.combinations(nodes, 2) if r.random() < (0.6 if a[:3] == b[:3] else 0.02)]


def test_modularity_with_weights_and_loops(spark):
    r = random.Random(1)
    edges = [(f"{a}", f"{b}", r.choice([1.0, 2.5])) for a in range(8) for b in range(a, 8) if r.random() < 0.5]
    label = {f"{i}": f"c{i % 3}" for i in range(8)}
    got = network.modularity(_frame(spark, edges), spark.createDataFrame(list(label.items()), "node string, community string")).first()[0]
    assert np.isclose(got, _q(edges, label))


def test_louvain_finds_planted_communities(spark):
    edges = _planted()
    got = {r.node: r.community for r in network.louvain(_frame(spark, edges)).collect()}
    truth = {n: n[:3] for n in got}
    assert len(got) == 72 and _q(edges, got) >= _q(edges, truth) - 1e-9
    assert {frozenset(n for n in got if got[n] == c) for c in set(got.values())} == {frozenset(n for n in got if n.startswith(g)) for g in {n[:3] for n in got}}
    assert all(c == min(n for n in got if got[n] == c) for c in got.values())  # named by the least node
    again = {r.node: r.community for r in network.louvain(_frame(spark, edges).repartition(7, "dst")).collect()}
    assert again == got


def test_louvain_near_the_greatest_modularity(spark):
    r = random.Random(5)
    nodes = list("abcdefg")
    edges = [(a, b, float(r.randint(1, 3))) for a, b in itertools.combinations(nodes, 2) if r.random() < 0.5]

    def partitions(rest):
        if not rest:
            yield {}
            return
        for p in partitions(rest[1:]):
            for c in {*p.values(), len(p)}:
                yield p | {rest[0]: c}

    used = sorted({x for a, b, _ in edges for x in (a, b)})
    most = max(_q(edges, p) for p in partitions(used))
    got = {x.node: x.community for x in network.louvain(_frame(spark, edges)).collect()}
    assert _q(edges, got) > most - 0.05 and _q(edges, got) > 0


def test_louvain_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "src string, dst string, weight double")
    assert network.louvain(empty).count() == 0
    pair = _frame(spark, [("x", "y", 1.0), ("z", "z", 1.0)])
    got = {r.node: r.community for r in network.louvain(pair).collect()}
    assert got["x"] == got["y"] == "x" and got["z"] == "z"
    spark.createDataFrame(_planted(3, 6), "a string, b string, w double").write.parquet(f"{tmp_path}/t.parquet")
    s = Session(spark)
    s.run(f"load {tmp_path}/t.parquet")
    s.run("network build a b w")
    s.run("network community --louvain")
    assert s.result.select("community").distinct().count() == 3
    s.run("network community --labels")
    assert s.result.columns == ["node", "community"]
    with pytest.raises(ValueError, match="leiden"):
        s.run("network community --leiden")
