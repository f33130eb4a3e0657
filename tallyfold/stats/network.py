"""Graph measures on edge lists: joins and aggregations, no graph in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col
from tallyfold.storage import discard, written


def build(df: DataFrame, source: str, target: str, weight: str | None = None, directed: bool = False) -> DataFrame:
    """src, dst and weight; parallel edges add up; undirected edges have src <= dst."""
    a, b = col(source).cast("string"), col(target).cast("string")
    rows = df.where(a.isNotNull() & b.isNotNull()).select((a if directed else F.least(a, b)).alias("src"), (b if directed else F.greatest(a, b)).alias("dst"), (col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _both(edges: DataFrame) -> DataFrame:
    e = edges.where("src <> dst")
    return e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def describe(edges: DataFrame, directed: bool = False) -> DataFrame:
    """nodes, edges and density."""
    nodes = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct().agg(F.count("*").alias("nodes"))
    n = F.col("nodes")
    return edges.agg(F.count("*").alias("edges")).crossJoin(F.broadcast(nodes)).select("nodes", "edges", (F.col("edges") / (n * (n - 1) / (1 if directed else 2))).alias("density"))


def degree(edges: DataFrame) -> DataFrame:
    """node, degree, strength (sum of weights) and degree centrality."""
    n = _both(edges).select("src").distinct().agg(F.count("*").alias("__n"))
    d = _both(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", "strength", (F.col("degree") / (F.col("__n") - 1)).alias("centrality"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, triangles and local coefficient. Edges point to the end of higher degree, which bounds the wedges of hubs."""
    both = _both(edges).select("src", "dst")
    deg = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    ranked = edges.where("src <> dst").select("src", "dst").join(deg.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(deg.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    e = ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    wedges = e.join(e.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = both.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    tri = wedges.join(closed, ["b", "c"], "left_semi").select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    t = F.coalesce("triangles", F.lit(0))
    return deg.join(tri, "node", "left").select("node", t.alias("triangles"), F.when(F.col("d") > 1, 2 * t / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering"))


def _checkpoint(df: DataFrame) -> DataFrame:
    """Written to the folder in spark.checkpoint.dir; where that is unset, to a temporary one on a local master only."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="tallyfold-"))
    return df.checkpoint()


def eigenvector(edges: DataFrame, steps: int = 30) -> DataFrame:
    """node and centrality by power iteration on A + I; each step is one join, and every few steps lineage is cut by a checkpoint."""
    both = _both(edges)
    nodes = both.select(F.col("src").alias("node")).distinct()
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("weight"))
    both = both.unionByName(loops).persist()
    x = nodes.withColumn("x", F.lit(1.0))
    for i in range(steps):
        y = both.join(x, both["dst"] == x["node"]).groupBy("src").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
        x = y.select(F.col("src").alias("node"), "x")
        if i % 4 == 3 or i == steps - 1:
            x = _checkpoint(x)
            norm = x.agg(F.sqrt(F.sum(F.col("x") ** 2))).first()[0] or 1.0
            x = x.withColumn("x", F.col("x") / F.lit(norm))
    both.unpersist()
    return x.withColumnRenamed("x", "centrality")


def communities(edges: DataFrame, steps: int = 5) -> DataFrame:
    """node and community by label propagation: the label of the greatest weight around, the least of ties."""
    both = _both(edges).persist()
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(steps):
        votes = both.join(labels, both["dst"] == labels["node"]).groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("k"), "community")).alias("m"))
        labels = _checkpoint(best.select(F.col("src").alias("node"), F.col("m.community").alias("community")))
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """modularity of the communities in `labels` (node, community): the share of weight inside less what the strengths alone would put there. Loops count."""
    named = lambda end: labels.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    found = edges.join(named("src"), "src").join(named("dst"), "dst")
    ends = found.select(F.col("c_src").alias("c"), "weight", F.when(F.col("c_src") == F.col("c_dst"), 2 * F.col("weight")).otherwise(0.0).alias("inside"))
    ends = ends.unionByName(found.select(F.col("c_dst").alias("c"), "weight", F.lit(0.0).alias("inside")))
    per = ends.groupBy("c").agg(F.sum("weight").alias("k"), F.sum("inside").alias("inside"))
    whole = per.agg(F.sum("k").alias("m2"))
    return per.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("inside") / F.col("m2") - (F.col("k") / F.col("m2")) ** 2).alias("modularity"))


def _strengths(edges: DataFrame) -> DataFrame:
    """node and strength; a loop counts at both of its ends."""
    return edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("dst").alias("node"), "weight")).groupBy("node").agg(F.sum("weight").alias("k"))


def _weighed(both: DataFrame, labels: DataFrame, total: float, loops: float) -> tuple[DataFrame, float, int]:
    """Of each of `labels` (node, community, k) the weight `inside` to others of its community, the community `to` of the greatest gain and that gain over staying; the modularity; the nodes that gain.

    One pass over the edges gives all of it: what the nodes have inside adds up to the modularity.
    """
    ends = both.join(labels.select(F.col("node").alias("dst"), "community"), "dst").select(F.col("src").alias("node"), "community", "weight")
    around = ends.unionByName(labels.select("node", "community", F.lit(0.0).alias("weight"))).groupBy("node", "community").agg(F.sum("weight").alias("w"))
    sums = labels.groupBy("community").agg(F.sum("k").alias("all"))
    options = around.join(sums, "community").join(labels.select("node", F.col("community").alias("now"), "k"), "node")
    stays = F.col("community") == F.col("now")
    gain = F.round((F.col("w") - F.col("k") * (F.col("all") - F.when(stays, F.col("k")).otherwise(0.0)) / F.lit(2 * total)) / F.lit(total), 12)
    best = options.groupBy("node", "now", "k").agg(F.min(F.struct((-gain).alias("g"), (~stays).alias("moves"), "community")).alias("b"), F.max(F.when(stays, gain)).alias("here"), F.max(F.when(stays, F.col("w"))).alias("inside"))
    over = F.when(F.col("b.moves"), -F.col("b.g") - F.col("here")).otherwise(0.0)
    out = written(best.select("node", "now", "k", "inside", F.col("b.community").alias("to"), over.alias("gain")))
    m2 = F.lit(2 * total)
    per = out.groupBy("now").agg(F.sum("inside").alias("inside"), F.sum("k").alias("k"), F.sum((F.col("gain") > 0).cast("long")).alias("gain"))
    reached, found = per.agg(F.sum(F.col("inside") / m2 - (F.col("k") / m2) ** 2), F.sum("gain")).first()
    return out, (reached or 0.0) + loops / total, found or 0


def _local_moves(edges: DataFrame, total: float, seed: int, steps: int, least: float) -> tuple[DataFrame, float]:
    """Labels (node, community, k) of the nodes of `edges` after steps in which a share of the nodes, drawn by a hash, go to the community around with the greatest gain.

    Nodes that gain by themselves may lose together: a step that does not raise the
    modularity is taken back and a quarter of the share is drawn next, down to the one
    node with the greatest gain, which always raises it. No node that gains, or a step that
    raises it by less than `least`, ends the moves.
    """
    both = written(_both(edges))
    loops = edges.where("src = dst").agg(F.sum("weight")).first()[0] or 0.0
    labels = written(_strengths(edges).select("node", F.col("node").alias("community"), "k"))
    (asks, score, found), share = _weighed(both, labels, total, loops), 2
    for step in range(steps):
        if not found:
            break
        alone = share >= found
        moves = asks.where("gain > 0")
        first = moves.orderBy(F.desc("gain"), "node").first()["node"] if alone else None
        drawn = F.col("node") == F.lit(first) if alone else F.pmod(F.xxhash64(F.lit(seed + step), "node"), F.lit(share)) == 0
        new = written(asks.select("node", F.when((F.col("gain") > 0) & drawn, F.col("to")).otherwise(F.col("now")).alias("community"), "k"))
        asked, reached, gaining = _weighed(both, new, total, loops)
        if reached > score + 1e-12:
            discard(labels, asks)
            small = reached - score < least
            labels, asks, score, found, share = new, asked, reached, gaining, max(2, share // 2)
            if small:
                break
        else:
            discard(new, asked)
            if alone:
                break
            share *= 4
    discard(both, asks)
    return labels, score


def louvain(edges: DataFrame, seed: int = 42, steps: int = 20, levels: int = 10, least: float = 1e-4) -> DataFrame:
    """node and community of greatest modularity by distributed Louvain: local moves by aggregated gains, then the same on the graph of the communities.

    A community is named by its least node. Gains come from joins and aggregates on the
    edges; each step is written to the shared folder, and the modularity never falls.
    Direction is ignored and parallel edges add up.
    """
    level = written(build(edges.where("src is not null and dst is not null"), "src", "dst", "weight"))
    total = level.agg(F.sum("weight")).first()[0]
    found = _strengths(level).select("node", F.col("node").alias("community"))
    if not total:
        return found
    score, held = -1.0, None
    for _ in range(levels):
        labels, reached = _local_moves(level, total, seed, steps, least)
        if reached <= score + 1e-9:
            discard(labels)
            break
        score = reached
        inner = labels.select(F.col("node").alias("community"), F.col("community").alias("__wider"))
        new = written(found.join(inner, "community").select("node", F.col("__wider").alias("community")))
        if held is not None:
            discard(held)
        found = held = new
        name = lambda end: labels.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))  # noqa: E731, B023
        wider = level.join(name("src"), "src").join(name("dst"), "dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"), "weight")
        wider = written(build(wider, "src", "dst", "weight"))
        discard(level, labels)
        level = wider
    least = found.groupBy("community").agg(F.min("node").alias("__least"))
    return written(found.join(least, "community").select("node", F.col("__least").alias("community")))


def distances(edges: DataFrame, sources: DataFrame, most: int = 6) -> DataFrame:
    """source, node and hops from each of `sources` (a column node), by frontier joins up to `most` hops."""
    both = _both(edges).select("src", "dst").persist()
    seen = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops"))
    front = seen
    for h in range(1, most + 1):
        step = front.join(both, front["node"] == both["src"]).select("source", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(h))
        front = _checkpoint(front)
        seen = _checkpoint(seen.unionByName(front))
    return seen


#: Nodes of a graph whose shortest paths are all made, at most.
MOST_NODES = 2_000


def _hops(edges: DataFrame) -> DataFrame:
    """source, node and hops between all pairs that are connected; a bounded number of nodes."""
    nodes = _both(edges).select(F.col("src").alias("node")).distinct()
    n = nodes.count()
    if n > MOST_NODES:
        raise ValueError(f"all shortest paths are made of {MOST_NODES} nodes at most, here are {n}; use distances from chosen nodes")
    return distances(edges, nodes, n).where("hops > 0")


def closeness(edges: DataFrame) -> DataFrame:
    """node and closeness: reached nodes over the sum of their hops, times the share of nodes reached."""
    hops = _hops(edges)
    n = hops.select("source").distinct().agg(F.count("*").alias("__n"))
    per = hops.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("r"), F.sum("hops").alias("s"))
    return per.crossJoin(F.broadcast(n)).select("node", (F.col("r") / F.col("s") * F.col("r") / (F.col("__n") - 1)).alias("closeness"))


def betweenness(edges: DataFrame) -> DataFrame:
    """node and the share of shortest paths between other nodes that pass it (Brandes), from a graph of a bounded number of nodes."""
    import numpy as np

    from tallyfold.stats.frames import frame

    pairs = _both(edges).select("src", "dst").distinct().limit(MOST_NODES * MOST_NODES).collect()
    names = sorted({r["src"] for r in pairs})
    if len(names) > MOST_NODES:
        raise ValueError(f"betweenness takes {MOST_NODES} nodes at most, here are {len(names)}")
    at = {v: i for i, v in enumerate(names)}
    near: list[list[int]] = [[] for _ in names]
    for r in pairs:
        near[at[r["src"]]].append(at[r["dst"]])
    n, score = len(names), np.zeros(len(names))
    for source in range(n):
        level, paths, front, layers = {source: 0}, np.zeros(n), [source], [[source]]
        paths[source] = 1
        while front:
            after: list[int] = []
            for u in front:
                for v in near[u]:
                    if v not in level:
                        level[v] = level[u] + 1
                        after.append(v)
                    if level[v] == level[u] + 1:
                        paths[v] += paths[u]
            layers.append(after)
            front = after
        due = np.zeros(n)
        for layer in reversed(layers):
            for v in layer:
                for u in near[v]:
                    if level[u] == level[v] - 1:
                        due[u] += paths[u] / paths[v] * (1 + due[v])
                if v != source:
                    score[v] += due[v]
    scale = (n - 1) * (n - 2) or 1
    return frame(edges.sparkSession, [{"node": v, "betweenness": float(score[i] / scale)} for i, v in enumerate(names)], "node string, betweenness double")
