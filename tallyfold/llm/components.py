"""Connected components by alternating large and small stars, in DataFrame functions only.

Each round is written to the shared folder, so lineage stays short. Nodes are of any
type that has an order and a hash. Every join is on a node with a minimum that was
aggregated before the shuffle; adaptive execution splits the partitions of hub nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import cut, discard, narrow, release


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame) -> DataFrame:
    """One large star, then one small star, of edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.unionByName(least.where("a > m").select("a", F.col("m").alias("b"))).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); component is the least node reachable. Self-loops and repeats are allowed."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = _state(edges)
    while state[0]:
        old, edges = edges, cut(_star(edges))
        before, state = state, _state(edges)
        discard(old)
        if before == state:
            break
        release(edges.sparkSession)
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def joined(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, component) after further links (a, b) between nodes; only components that these links touch are looked at again."""
    if parts is None:
        return cut(components(links))
    name = lambda c: F.coalesce(F.col(f"of_{c}.component"), F.col(c)).alias(c)
    side = lambda c: narrow(parts).alias(f"of_{c}")
    met = links.join(side("a"), F.col("a") == F.col("of_a.node"), "left").join(side("b"), F.col("b") == F.col("of_b.node"), "left")
    wider = cut(components(met.select(name("a"), name("b")))).select(F.col("node").alias("part"), F.col("component").alias("wider"))
    old = parts.join(narrow(wider), F.col("component") == F.col("part"), "left").select("node", F.coalesce("wider", "component").alias("component"))
    new = wider.join(parts, F.col("part") == F.col("node"), "left_anti").select(F.col("part").alias("node"), F.col("wider").alias("component"))
    out = cut(old.unionByName(new))
    discard(parts)
    return out
