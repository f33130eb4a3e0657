"""Components, factors, clusters, discriminants and mixtures."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col
from tallyfold.operators.ordered import RN, numbered
from tallyfold.stats.frames import CONST, complete, frame, moments
from tallyfold.stats.tests import group_outer
from tallyfold.storage import discard, written

#: Rows that a method on all pairs takes to one task.
MOST_ROWS = 5_000


def correlation(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Correlations, means and sample deviations from one pass."""
    m = moments(df, {c: col(c) for c in columns})
    mean = m.block([CONST], columns)[0] / m.n
    c = (m.block(columns, columns) - m.n * np.outer(mean, mean)) / (m.n - 1)
    sd = np.sqrt(np.diag(c))
    return c / np.outer(sd, sd), mean, sd, m.n


def _signed(v: np.ndarray) -> np.ndarray:
    """Each vector's largest entry is positive."""
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)


def pca(df: DataFrame, columns: Sequence[str], n: int | None = None) -> DataFrame:
    """component, eigenvalue, share, and a loading column for each variable, of the correlation matrix."""
    r, _, _, _ = correlation(df, columns)
    values, vectors = np.linalg.eigh(r)
    order = values.argsort()[::-1][: n or len(columns)]
    vectors = _signed(vectors[:, order])
    return frame(df.sparkSession, [{"component": i + 1, "eigenvalue": values[k], "share": values[k] / len(columns), **{c: vectors[j, i] for j, c in enumerate(columns)}} for i, k in enumerate(order)])


def varimax(loads: np.ndarray, steps: int = 100) -> np.ndarray:
    p, k = loads.shape
    turn, before = np.eye(k), 0.0
    for _ in range(steps):
        x = loads @ turn
        u, s, vt = np.linalg.svd(loads.T @ (x**3 - x * (x**2).sum(axis=0) / p))
        turn = u @ vt
        if s.sum() < before * (1 + 1e-9):
            break
        before = s.sum()
    return loads @ turn


def factor(df: DataFrame, columns: Sequence[str], n: int = 2, method: str = "pc", rotate: bool = True) -> DataFrame:
    """variable, loadings and uniqueness: principal components, or maximum likelihood by expectation-maximisation."""
    r, _, _, _ = correlation(df, columns)
    values, vectors = np.linalg.eigh(r)
    order = values.argsort()[::-1][:n]
    loads = _signed(vectors[:, order] * np.sqrt(np.maximum(values[order], 0)))
    if method == "ml":
        psi = np.clip(1 - (loads**2).sum(axis=1), 0.05, 1)
        for _ in range(500):
            beta = loads.T @ np.linalg.inv(loads @ loads.T + np.diag(psi))
            new = r @ beta.T @ np.linalg.inv(np.eye(n) - beta @ loads + beta @ r @ beta.T)
            psi = np.clip(np.diag(r - new @ beta @ r), 1e-4, None)
            done, loads = np.abs(new - loads).max() < 1e-8, new
            if done:
                break
    if rotate and n > 1:
        loads = varimax(loads)
    loads = _signed(loads)
    return frame(df.sparkSession, [{"variable": c, **{f"factor{j + 1}": loads[i, j] for j in range(n)}, "uniqueness": 1 - float((loads[i] ** 2).sum())} for i, c in enumerate(columns)])


def scaled_vectors(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """z-scored features of complete rows."""
    rows = complete(df, {c: col(c) for c in columns}).select(*map(col, keep), *(col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)))
    rows = VectorAssembler(inputCols=[f"__v{i}" for i in range(len(columns))], outputCol="__raw").transform(rows)
    return StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True).fit(rows).transform(rows)


def kmeans(df: DataFrame, columns: Sequence[str], k: int = 3, seed: int = 42) -> DataFrame:
    """cluster, size and the centre's columns (on the data's scale), by size; inertia beside."""
    from pyspark.ml.clustering import KMeans

    rows = scaled_vectors(df, columns).persist()
    model = KMeans(k=k, seed=seed, initSteps=5, maxIter=50).fit(rows)
    out = model.transform(rows).groupBy("prediction").agg(F.count("*").alias("size"), *(F.avg(f"__v{i}").alias(c) for i, c in enumerate(columns))).collect()
    rows.unpersist()
    out = sorted(out, key=lambda r: (-r["size"], r[columns[0]]))
    return frame(df.sparkSession, [{"cluster": i, "size": r["size"], **{c: r[c] for c in columns}, "inertia": model.summary.trainingCost} for i, r in enumerate(out)])


def _gather(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    rows = complete(df, {c: col(c) for c in columns}).select(*(col(c).cast("double") for c in columns)).limit(MOST_ROWS + 1).toPandas()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"this method compares all pairs; it takes {MOST_ROWS} rows at most. Sample first")
    x = rows.to_numpy()
    return (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-12)


#: Clusters of a block that are compared at once, and clusters that are joined on the driver at the end.
WARD_BLOCK = 1_000


def _ward_gaps(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Ward's distances of two tables of clusters (id, n, x); a cluster is infinitely far from itself."""
    x, y = np.array(a.x.tolist()), np.array(b.x.tolist())
    d = sum((x[:, [i]] - y[:, i]) ** 2 for i in range(x.shape[1]))
    n, m = a.n.to_numpy(np.float64)[:, None], b.n.to_numpy(np.float64)
    d = d * (2 * n * m / (n + m))
    return np.where(a.id.to_numpy()[:, None] == b.id.to_numpy(), np.inf, d)


def _ward_mates(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
    """The nearest of b for each row of a; of equal distances the least hash of both ids, which is one order of all pairs."""
    low = d.min(axis=1)
    mix = (a.id.to_numpy(np.uint64)[:, None] ^ b.id.to_numpy(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(2)
    at = np.where(d == low[:, None], mix, np.uint64(1 << 63)).argmin(axis=1)
    found = pd.DataFrame({"id": a.id.to_numpy(), "d": low, "t": mix[np.arange(len(a)), at].astype(np.int64), "mate": b.id.to_numpy()[at]})
    return found[np.isfinite(low)]


def _ward_local(part: pd.DataFrame) -> pd.DataFrame:
    """The stretch of x[0] outside of which no cluster can be nearer than the nearest of the block."""
    part = part.sort_values("id")
    r = np.sqrt(_ward_gaps(part, part).min(axis=1) * (part.n + 1) / (2 * part.n)) * (1 + 1e-9)
    return pd.DataFrame({"block": [part.block.iloc[0]], "low": [part.x0.min()], "high": [part.x0.max()], "lo": [(part.x0 - r).min()], "hi": [(part.x0 + r).max()]})


def _ward_pair(part: pd.DataFrame) -> pd.DataFrame:
    """Nearest clusters, both ways, of two blocks (or of one and itself)."""
    a, b = part[part.side == 0], part[part.side == 1]
    if not len(b):
        return _ward_mates(a, a, _ward_gaps(a, a))
    d = _ward_gaps(a, b)
    return pd.concat([_ward_mates(a, b, d), _ward_mates(b, a, d.T)])


def _ward_round(rows: DataFrame, step: int) -> DataFrame:
    """Clusters (id, n, x, h, born) and, beside joined ones, both parts: all pairs that are each other's nearest are joined.

    Ward's distance never falls by a join, so that these joins are in the whole tree in whatever order they come.
    """
    held = written(numbered(rows.withColumn("x0", F.col("x")[0]), ["x0", "id"]).withColumn("block", F.floor(F.col(RN) / WARD_BLOCK).cast("long")).drop(RN))
    spans = written(held.groupBy("block").applyInPandas(_ward_local, "block long, low double, high double, lo double, hi double"))
    a, b = spans.alias("a"), spans.alias("b")
    pairs = a.join(b, F.expr("a.block <= b.block and (a.hi >= b.low and a.lo <= b.high or b.hi >= a.low and b.lo <= a.high)")).select(F.col("a.block").alias("p"), F.col("b.block").alias("q"))
    pairs = written(pairs)
    sides = held.join(pairs.withColumn("block", F.col("p")), "block").withColumn("side", F.lit(0)).unionByName(held.join(pairs.where("p < q").withColumn("block", F.col("q")), "block").withColumn("side", F.lit(1)))
    mates = sides.select("p", "q", "side", "id", "n", "x").groupBy("p", "q").applyInPandas(_ward_pair, "id long, d double, t long, mate long")
    mates = written(mates.groupBy("id").agg(F.min(F.struct("d", "t", "mate")).alias("m")).select("id", "m.d", "m.mate"))
    other = mates.select(F.col("id").alias("mate"), F.col("mate").alias("back"))
    joins = mates.join(other, "mate").where("back = id and id < mate").select("id", "mate", "d")
    right = held.select(F.col("id").alias("mate"), *(F.col(c).alias(f"r_{c}") for c in ("n", "x", "h", "born")))
    both = written(joins.join(right, "mate").join(held.select("id", F.col("n").alias("l_n"), "x", "h", "born"), "id"))
    whole = F.col("l_n") + F.col("r_n")
    node = lambda i, born, n: F.struct(F.col(i).alias("id"), F.col(born).alias("born"), F.col(n).alias("n"))
    made = both.select("id", whole.alias("n"), F.zip_with("x", "r_x", lambda u, v: (u * F.col("l_n") + v * F.col("r_n")) / whole).alias("x"), F.greatest("d", "h", "r_h").alias("h"), F.lit(step).alias("born"), node("id", "born", "l_n").alias("left"), node("mate", "r_born", "r_n").alias("right"))
    gone = both.select(F.explode(F.array("id", "mate")).alias("id"))
    kept = held.join(gone, "id", "left_anti").select("id", "n", "x", "h", "born").withColumns({"left": F.lit(None).cast(made.schema["left"].dataType), "right": F.lit(None).cast(made.schema["right"].dataType)})
    out = written(made.unionByName(kept))
    discard(held, spans, pairs, mates, both)
    return out


def _ward(rows: DataFrame, k: int) -> list[int]:
    """Sizes of the k clusters of Ward's tree on standardised rows `x`: rounds in Spark until WARD_BLOCK clusters are left, then one by one."""
    now = written(rows.groupBy("x").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()).withColumns({"h": F.lit(0.0), "born": F.lit(0)}))
    step, tops = 0, []
    while now.count() > max(WARD_BLOCK, k):
        step += 1
        new = _ward_round(now.select("id", "n", "x", "h", "born"), step)
        tops += [(r["h"], step, tuple(r["left"]), tuple(r["right"]), (r["id"], step)) for r in new.where(F.col("born") == step).orderBy(F.desc("h")).limit(k - 1).collect()]
        discard(now)
        now = new
    left = now.select("id", "n", "x", "h", "born").toPandas()
    discard(now)
    d, size, h = _ward_gaps(left, left), left.n.to_numpy(np.float64), left.h.to_numpy(np.float64)
    nodes = [(int(i), int(b), int(n)) for i, b, n in zip(left.id, left.born, left.n, strict=True)]
    for _ in range(len(left) - 1):
        step += 1
        i, j = sorted(divmod(int(d.argmin()), len(left)))
        a, b, found = size[i], size[j], d[i, j]
        row = ((a + size) * d[i] + (b + size) * d[j] - size * found) / (a + b + size)
        row[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i], h[i] = a + b, max(found, h[i], h[j])
        new = (nodes[i][0], step, int(a + b))
        tops.append((h[i], step, nodes[i], nodes[j], new[:2]))
        nodes[i] = new
    cut = sorted(tops, key=lambda t: t[:2], reverse=True)[: k - 1]
    inner = {t[4] for t in cut}
    sizes = [n[2] for t in cut for n in t[2:4] if n[:2] not in inner] or [int(left.n.sum())]
    while len(sizes) < k:  # fewer different rows than clusters: copies are parted
        sizes.sort()
        sizes[-1:] = [sizes[-1] - 1, 1]
    return sorted(sizes, reverse=True)


def hierarchical(df: DataFrame, columns: Sequence[str], k: int = 3, linkage: str = "ward") -> DataFrame:
    """cluster and size after joining the nearest clusters (Lance and Williams) down to k. Ward's take any number of rows, other linkages a bounded one."""
    if linkage == "ward":
        rows = complete(df, {c: col(c) for c in columns})
        xs = [col(c).cast("double") for c in columns]
        n, *stats = rows.agg(F.count("*"), *(f(x) for x in xs for f in (F.avg, F.stddev_pop))).first()
        if n > MOST_ROWS:
            scaled = F.array(*((x - F.lit(m)) / F.lit(max(v, 1e-12)) for x, m, v in zip(xs, stats[::2], stats[1::2], strict=True)))
            return frame(df.sparkSession, [{"cluster": i, "size": v} for i, v in enumerate(_ward(rows.select(scaled.alias("x")), k))])
    x = _gather(df, columns)
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    d = d**2 if linkage == "ward" else d
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(n - k):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        a, b = size[i], size[j]
        row = {
            "single": lambda: np.minimum(d[i], d[j]), "complete": lambda: np.maximum(d[i], d[j]), "average": lambda: (a * d[i] + b * d[j]) / (a + b),  # noqa: B023
            "ward": lambda: ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size),  # noqa: B023
        }[linkage]()
        row[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i] = a + b
        label[label == label[j]] = label[i]
    sizes = sorted(np.unique(label, return_counts=True)[1].tolist(), reverse=True)
    return frame(df.sparkSession, [{"cluster": i, "size": s} for i, s in enumerate(sizes)])


def mds(df: DataFrame, columns: Sequence[str], n: int = 2, steps: int = 200) -> DataFrame:
    """Coordinates by stress majorisation from the classical solution; a bounded number of rows."""
    x = _gather(df, columns)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    m = len(d)
    j = np.eye(m) - 1 / m
    values, vectors = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    z = vectors[:, -n:][:, ::-1] * np.sqrt(np.maximum(values[-n:][::-1], 0))
    for _ in range(steps):
        now = np.sqrt(np.maximum(((z[:, None] - z[None]) ** 2).sum(axis=2), 1e-18))
        b = -d / now
        np.fill_diagonal(b, 0)
        np.fill_diagonal(b, -b.sum(axis=1))
        new = b @ z / m
        done, z = np.abs(new - z).max() < 1e-6, new
        if done:
            break
    return frame(df.sparkSession, [{"row": i, **{f"dim{k + 1}": r[k] for k in range(n)}} for i, r in enumerate(z)])


def tsne(df: DataFrame, columns: Sequence[str], n: int = 2, perplexity: float = 30.0, steps: int = 300, seed: int = 42) -> DataFrame:
    """Coordinates by t-SNE with exact gradients; a bounded number of rows."""
    x = _gather(df, columns)
    m = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    p = np.zeros((m, m))
    goal = math.log(min(perplexity, (m - 1) / 3))
    for i in range(m):
        low, high, beta = 0.0, math.inf, 1.0
        for _ in range(50):
            w = np.exp(-(d[i] - np.partition(d[i], 1)[1]) * beta)
            w[i] = 0
            q = w / w.sum()
            h = -(q[q > 0] * np.log(q[q > 0])).sum()
            low, high = (beta, high) if h > goal else (low, beta)
            beta = beta * 2 if math.isinf(high) else (low + high) / 2
        p[i] = q
    p = np.maximum((p + p.T) / (2 * m), 1e-12)
    rng = np.random.default_rng(seed)
    z, step = rng.normal(0, 1e-2, (m, n)), np.zeros((m, n))
    for it in range(steps):
        w = 1 / (1 + ((z[:, None] - z[None]) ** 2).sum(axis=2))
        np.fill_diagonal(w, 0)
        g = ((4 if it < 80 else 1) * p - np.maximum(w / w.sum(), 1e-12)) * w
        grad = 4 * (np.diag(g.sum(axis=1)) - g) @ z
        step = (0.5 if it < 80 else 0.8) * step - max(m / 12, 20) * grad
        z = z + step
    return frame(df.sparkSession, [{"row": i, **{f"dim{k + 1}": r[k] for k in range(n)}} for i, r in enumerate(z)])


def umap(df: DataFrame, columns: Sequence[str], n: int = 2, neighbours: int = 15, spread: float = 0.1, steps: int = 200, seed: int = 42) -> DataFrame:
    """Coordinates by UMAP: a fuzzy graph of nearest neighbours, laid out by attraction along it and repulsion elsewhere; a bounded number of rows."""
    x = _gather(df, columns)
    m = len(x)
    k = min(neighbours, m - 1)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    held = np.take_along_axis(d, near, axis=1)
    first, goal = held[:, :1], math.log2(max(k, 2))
    low, high = np.zeros((m, 1)), np.full((m, 1), 1e3)
    for _ in range(60):  # the width at which the memberships add up to log2 k
        mid = (low + high) / 2
        over = np.exp(-np.maximum(held - first, 0) / np.maximum(mid, 1e-12)).sum(axis=1, keepdims=True) > goal
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    p = np.zeros((m, m))
    np.put_along_axis(p, near, np.exp(-np.maximum(held - first, 0) / np.maximum(mid, 1e-12)), axis=1)
    p = p + p.T - p * p.T
    # layout: eigenvectors of the normalised graph, then gradient steps on the cross-entropy with 1 / (1 + a r^(2b))
    root = 1 / np.sqrt(np.maximum(p.sum(axis=1), 1e-12))
    z = np.linalg.eigh(np.eye(m) - root[:, None] * p * root[None])[1][:, 1 : n + 1]
    z = 10 * z / max(np.abs(z).max(), 1e-12) + np.random.default_rng(seed).normal(0, 1e-4, (m, n))
    a, b = 1 / (1 + spread), 1.0
    for it in range(steps):
        gap = z[:, None] - z[None]
        r = (gap**2).sum(axis=2)
        pull = -2 * a * b * p / (1 + a * r)
        push = 2 * b * (1 - p) / ((0.1 + r) * (1 + a * r))
        np.fill_diagonal(push, 0)
        move = ((pull + push * k / m)[:, :, None] * gap).sum(axis=1)
        z = z + (1 - it / steps) * np.clip(move / k, -1, 1)
    return frame(df.sparkSession, [{"row": i, **{f"dim{j + 1}": v[j] for j in range(n)}} for i, v in enumerate(z)])


def discriminant(df: DataFrame, by: str, columns: Sequence[str], method: str = "lda") -> DataFrame:
    """group, predicted and n of a linear or quadratic discriminant on its own rows; scores are Column expressions."""
    groups, ns, means, within = group_outer(df, columns, by)
    total, k = sum(ns), len(columns)
    x = [col(c).cast("double") for c in columns]
    rows = complete(df, {c: col(c) for c in columns}).where(col(by).isNotNull())
    if method == "lda":
        covs = [within / (total - len(groups))] * len(groups)
    else:
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = rows.groupBy(col(by).alias("g")).agg(*(F.covar_samp(x[i], x[j]) for i, j in pairs)).orderBy("g").collect()
        covs = []
        for r in got:
            c = np.zeros((k, k))
            c[np.triu_indices(k)] = r[1:]
            covs.append(c + np.triu(c, 1).T)
    scores = []
    for n, m, c in zip(ns, means, covs, strict=True):
        inv, (_, logdet) = np.linalg.inv(c), np.linalg.slogdet(c)
        gaps = [a - F.lit(float(b)) for a, b in zip(x, m, strict=True)]
        quad = sum((F.lit(float(inv[i, j])) * gaps[i] * gaps[j] for i in range(k) for j in range(k)), F.lit(0.0))
        scores.append(F.lit(math.log(n / total) - logdet / 2) - quad / 2)
    best = F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(str(g)).alias("g")) for s, g in zip(scores, groups, strict=True)))).getField("g")
    return rows.groupBy(col(by).cast("string").alias("group"), best.alias("predicted")).agg(F.count("*").alias("n")).orderBy("group", "predicted")


def mixture(df: DataFrame, column: str, k: int = 3, seed: int = 42) -> DataFrame:
    """component, weight, mean and sd of a Gaussian mixture of one column."""
    from pyspark.ml.clustering import GaussianMixture

    rows = VectorAssembler(inputCols=["v"], outputCol="features").transform(complete(df, {"v": col(column)}).select(col(column).cast("double").alias("v")))
    model = GaussianMixture(k=k, seed=seed, maxIter=100).fit(rows)
    got = sorted((g.mean[0], float(g.cov.toArray()[0, 0]), w) for g, w in zip(model.gaussians, model.weights, strict=True))
    return frame(df.sparkSession, [{"component": i, "weight": w, "mean": m, "sd": math.sqrt(v)} for i, (m, v, w) in enumerate(got)])


def irt(df: DataFrame, items: Sequence[str], model: str = "2pl") -> DataFrame:
    """item, discrimination and difficulty from logits on the standardised sum score; counts by score are all that is gathered."""
    total = sum((F.coalesce(col(i).cast("double"), F.lit(0.0)) for i in items), F.lit(0.0))
    got = df.groupBy(total.alias("s")).agg(F.count("*").alias("n"), *(F.sum(col(i).cast("double")).alias(f"k{j}") for j, i in enumerate(items))).orderBy("s").toPandas()
    n = got.n.to_numpy()
    mean = np.average(got.s, weights=n)
    theta = (got.s.to_numpy() - mean) / max(math.sqrt(np.average((got.s - mean) ** 2, weights=n)), 1e-12)
    out = []
    for j, item in enumerate(items):
        b, y = np.zeros(2), got[f"k{j}"].fillna(0).to_numpy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-(b[0] + (b[1] if model != "1pl" else 1.0) * theta)))
            w = n * p * (1 - p) + 1e-9
            a = np.column_stack((np.ones(len(theta)), theta)) if model != "1pl" else np.ones((len(theta), 1))
            step = np.linalg.solve((a * w[:, None]).T @ a + 1e-6 * np.eye(a.shape[1]), a.T @ (y - n * p))
            b[: len(step)] += np.clip(step, -2, 2)
        slope = b[1] if model != "1pl" else 1.0
        out.append({"item": item, "discrimination": slope, "difficulty": -b[0] / slope if slope else math.nan})
    return frame(df.sparkSession, out, "item string, discrimination double, difficulty double")


def sem(df: DataFrame, model: dict[str, Sequence[str]], steps: int = 500) -> DataFrame:
    """Confirmatory factor model by maximum likelihood on the correlations: lhs, op, rhs and estimate (standardised), with fit rows.

    `model` maps each factor to its indicators; factors have unit variance and are correlated.
    """
    names = sorted({i for v in model.values() for i in v})
    s, _, _, n = correlation(df, names)
    factors, p = list(model), len(names)
    free = [(names.index(i), f) for f, fac in enumerate(factors) for i in model[fac]]
    pairs = [(a, b) for a in range(len(factors)) for b in range(a + 1, len(factors))]

    def unpack(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        load, phi = np.zeros((p, len(factors))), np.eye(len(factors))
        for (i, f), x in zip(free, v, strict=False):
            load[i, f] = x
        for (a, b), x in zip(pairs, v[len(free) :], strict=False):
            phi[a, b] = phi[b, a] = math.tanh(x)
        return load, phi, np.exp(v[len(free) + len(pairs) :])

    def gap(v: np.ndarray) -> float:
        load, phi, psi = unpack(v)
        sig = load @ phi @ load.T + np.diag(psi)
        sign, logdet = np.linalg.slogdet(sig)
        return logdet + np.trace(np.linalg.solve(sig, s)) - np.linalg.slogdet(s)[1] - p if sign > 0 else 1e6

    v = np.concatenate((np.full(len(free), 0.6), np.zeros(len(pairs)), np.full(p, math.log(0.5))))
    h = np.eye(len(v))
    grad = lambda x: np.array([(gap(x + e) - gap(x - e)) / 2e-6 for e in np.eye(len(x)) * 1e-6])
    g = grad(v)
    for _ in range(steps):  # quasi-Newton
        d, t = -h @ g, 1.0
        while gap(v + t * d) > gap(v) + 1e-4 * t * g @ d and t > 1e-8:
            t /= 2
        new = v + t * d
        g2 = grad(new)
        step, y = new - v, g2 - g
        if step @ y > 1e-12:
            rho = 1 / (step @ y)
            a = np.eye(len(v)) - rho * np.outer(step, y)
            h = a @ h @ a.T + rho * np.outer(step, step)
        v, g = new, g2
        if np.abs(g).max() < 1e-6 or t <= 1e-8:
            break
    load, phi, psi = unpack(v)
    d, stat = p * (p + 1) // 2 - len(v), (n - 1) * gap(v)
    base = -(n - 1) * np.linalg.slogdet(s)[1]
    d0 = p * (p - 1) // 2
    rows = [(factors[f], "=~", names[i], load[i, f]) for i, f in free] + [(factors[a], "~~", factors[b], phi[a, b]) for a, b in pairs] + [(x, "~~", x, psi[i]) for i, x in enumerate(names)]
    rows += [("fit", "chi2", "", stat), ("fit", "df", "", d), ("fit", "cfi", "", 1 - max(stat - d, 0) / max(base - d0, stat - d, 1e-12)), ("fit", "rmsea", "", math.sqrt(max(stat - d, 0) / max(d * (n - 1), 1)))]
    return frame(df.sparkSession, [{"lhs": a, "op": b, "rhs": c, "estimate": float(x)} for a, b, c, x in rows])
