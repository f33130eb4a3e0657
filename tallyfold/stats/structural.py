"""Structural equation models: factors, paths and covariances, fitted to one aggregated covariance matrix.

A model is lines of `f =~ x1 + x2` (factors), `y ~ f + z` (paths) and `x1 ~~ x2`
(covariances); `2*x` fixes a parameter. It is held as directed paths A and symmetric
moments S over observed variables and factors; the implied covariance is the observed
block of (I - A)^-1 S (I - A)^-T. Parameters come from scoring steps with analytic
derivatives. The table enters through one pass for its covariances (and, for method
wls, one more for the covariances of its products); all else is small matrices.

Defaults: a factor's first loading is 1; every variable that nothing points to has a free
variance, and such factors are correlated freely; every other has a free residual
variance; variables that only predict keep their sample moments.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col
from tallyfold.stats import dist
from tallyfold.stats.frames import CONST, _matrix, complete, cross_products, frame

METHODS = ("ml", "gls", "uls", "wls")
_LINE = re.compile(r"\s*(\w+)\s*(=~|~~|~)\s*(.+?)\s*$")
_TERM = re.compile(r"\s*(?:([-+]?\d+(?:\.\d+)?)\s*\*\s*)?([A-Za-z_]\w*)\s*$")
#: Variables of a model, at most: their covariances are one aggregation.
MOST_VARIABLES = 100


@dataclass
class Model:
    """Parameters (lhs, op, rhs, fixed value or None) over observed variables and factors."""

    observed: list[str]
    factors: list[str]
    parameters: list[tuple[str, str, str, float | None]] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [*self.observed, *self.factors]

    @property
    def targets(self) -> set[str]:
        """Variables that a path or a factor points to."""
        return {(b if op == "=~" else a) for a, op, b, _ in self.parameters if op != "~~"}

    @property
    def exogenous(self) -> list[str]:
        """Observed variables that only predict."""
        return [v for v in self.observed if v not in self.targets]


def parse(text: str) -> Model:
    """The model of a text; lines end at a line break or a semicolon. A line of another form raises."""
    lines = [x for x in re.split(r"\\n|[\n;]", text.strip().strip("\"'")) if x.strip()]
    if not lines:
        raise ValueError("a model has lines like f =~ x1 + x2 + x3, y ~ f + z, x1 ~~ x2")
    given: list[tuple[str, str, str, float | None]] = []
    for line in lines:
        m = _LINE.match(line)
        terms = [_TERM.match(t) for t in m[3].split("+")] if m else []
        if not m or not all(terms):
            raise ValueError(f"not a line of a model: {line.strip()}")
        for t in terms:
            given.append((m[1], m[2], t[2], float(t[1]) if t[1] else None))
    factors = list(dict.fromkeys(a for a, op, _, _ in given if op == "=~"))
    observed = list(dict.fromkeys(v for a, _, b, _ in given for v in (a, b) if v not in factors))
    model = Model(observed, factors)
    seen: dict[tuple, None] = {}
    for a, op, b, fixed in given:
        key = (op, *sorted((a, b))) if op == "~~" else (op, a, b)
        if key in seen:
            raise ValueError(f"twice in the model: {a} {op} {b}")
        if a == b and op != "~~":
            raise ValueError(f"a variable does not point to itself: {a} {op} {b}")
        seen[key] = None
        first = op == "=~" and not any(x[0] == a and x[1] == "=~" for x in model.parameters)
        model.parameters.append((a, op, b, 1.0 if first and fixed is None else fixed))
    have = {key[1:] for key in seen if key[0] == "~~"}
    only = model.exogenous
    for v in model.names:
        if v not in only and (v, v) not in have:
            model.parameters.append((v, "~~", v, None))
    roots = [f for f in factors if f not in model.targets]
    for i, a in enumerate(roots):
        for b in roots[:i]:
            if tuple(sorted((a, b))) not in have:
                model.parameters.append((b, "~~", a, None))
    return model


class Implied:
    """Implied covariances and their derivatives, of a model whose predicting variables keep the moments of `sample`."""

    def __init__(self, model: Model, sample: np.ndarray) -> None:
        self.model, self.p, names = model, len(model.observed), model.names
        at = {v: i for i, v in enumerate(names)}
        self.a, self.s = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
        own = [at[v] for v in model.exogenous]
        self.s[np.ix_(own, own)] = sample[np.ix_(own, own)]
        self.free: list[tuple[str, str, str]] = []
        self.cells: list[tuple[bool, int, int]] = []
        for a, op, b, fixed in model.parameters:
            i, j = (at[b], at[a]) if op == "=~" else (at[a], at[b])
            if fixed is not None:
                self._put((op != "~~", i, j), fixed)
            else:
                self.free.append((a, op, b))
                self.cells.append((op != "~~", i, j))

    def _put(self, cell: tuple[bool, int, int], value: float) -> None:
        directed, i, j = cell
        if directed:
            self.a[i, j] = value
        else:
            self.s[i, j] = self.s[j, i] = value

    def start(self, sample: np.ndarray) -> np.ndarray:
        """Loadings by the spread of the indicators, observed paths by least squares, half of each variance."""
        names, out = self.model.names, np.zeros(len(self.cells))
        spread = {v: math.sqrt(sample[i, i]) for i, v in enumerate(self.model.observed)}
        marker = {a: spread.get(b, 1.0) for a, op, b, fixed in reversed(self.model.parameters) if op == "=~" and fixed is not None}
        for k, ((a, op, b), (directed, i, j)) in enumerate(zip(self.free, self.cells, strict=True)):
            if op == "=~":
                out[k] = spread.get(b, 1.0) / marker.get(a, 1.0)
            elif directed and i < self.p and j < self.p:
                xs = [names.index(x) for (y, o, x) in self.free if o == "~" and y == a and x in spread]
                out[k] = np.linalg.lstsq(sample[np.ix_(xs, xs)], sample[xs, i], rcond=None)[0][xs.index(j)]
            elif not directed and i == j:
                out[k] = 0.5 * (sample[i, i] if i < self.p else marker.get(a, 1.0) ** 2)
        return out

    def at(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(covariance of all variables, (I - A)^-1) at the free parameters."""
        for cell, v in zip(self.cells, values, strict=True):
            self._put(cell, float(v))
        b = np.linalg.inv(np.eye(len(self.a)) - self.a)
        return b @ self.s @ b.T, b

    def derivatives(self, whole: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Derivative of the observed covariance by each free parameter."""
        out = np.empty((len(self.cells), self.p, self.p))
        for k, (directed, i, j) in enumerate(self.cells):
            half = np.outer(b[: self.p, i], whole[j, : self.p]) if directed else np.outer(b[: self.p, i], b[: self.p, j])
            out[k] = half + half.T if directed or i != j else half
        return out


@dataclass
class Result:
    """A fitted model: free parameters, their covariance, and measures of fit."""

    model: Model
    free: list[tuple[str, str, str]]
    values: np.ndarray
    errors: np.ndarray | None
    whole: np.ndarray
    sample: np.ndarray
    n: int
    measures: dict[str, float]

    def rows(self) -> list[dict]:
        """lhs, op, rhs, estimate, se, z, p, and std: the estimate in standard deviations of the implied variables."""
        sd = dict(zip(self.model.names, np.sqrt(np.diag(self.whole)), strict=True))
        found = dict(zip(self.free, self.values, strict=True))
        out = []
        for a, op, b, fixed in self.model.parameters:
            est = float(found.get((a, op, b), fixed))
            se = float(self.errors[self.free.index((a, op, b))]) if fixed is None and self.errors is not None else None
            std = est * sd[a] / sd[b] if op == "=~" else est * sd[b] / sd[a] if op == "~" else est / (sd[a] * sd[b])
            z = est / se if se else None
            out.append({"lhs": a, "op": op, "rhs": b, "estimate": est, "se": se, "z": z, "p": math.erfc(abs(z) / math.sqrt(2)) if z is not None else None, "std": float(std)})
        return out


def _inner(method: str, sample: np.ndarray, products: np.ndarray | None) -> Callable[[np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """For an implied covariance, the products of stacks of symmetric matrices that the method weighs differences by."""
    low = np.tril_indices(len(sample))
    if method == "wls":
        weight = np.linalg.inv(products)
        return lambda sigma: lambda x, y: 2 * x[:, low[0], low[1]] @ weight @ y[:, low[0], low[1]].T
    fixed = np.eye(len(sample)) if method == "uls" else np.linalg.inv(sample)

    def make(sigma: np.ndarray):
        v = np.linalg.inv(sigma) if method == "ml" else fixed
        return lambda x, y: np.einsum("aij,bji->ab", v @ x, v @ y)

    return make


def fit_covariance(model: Model, sample: np.ndarray, n: int, method: str = "ml", products: np.ndarray | None = None, steps: int = 500) -> Result:
    """The model fitted to the covariance of n rows (divided by n) of `model.observed`."""
    sd = np.sqrt(np.diag(sample))
    if not sd.all() or np.linalg.eigvalsh(sample / np.outer(sd, sd))[0] < 1e-12:
        raise ValueError("the observed variables are linearly dependent")
    implied, weigh = Implied(model, sample), _inner(method, sample, products)
    p, log_sample = len(sample), np.linalg.slogdet(sample)[1]

    def gap(values: np.ndarray) -> float:
        sigma = implied.at(values)[0][:p, :p]
        sign, logdet = np.linalg.slogdet(sigma)
        if sign <= 0 or np.linalg.eigvalsh(sigma)[0] <= 0:
            return math.inf
        if method == "ml":
            return float(logdet + np.trace(np.linalg.solve(sigma, sample)) - log_sample - p)
        rest = (sample - sigma)[None]
        return 0.5 * float(weigh(sigma)(rest, rest)[0, 0])

    values = implied.start(sample)
    now = gap(values)
    if not math.isfinite(now):
        raise ValueError("no covariance follows from the model's start; do paths run in a circle?")
    for _ in range(steps if len(values) else 0):
        whole, b = implied.at(values)
        d, inner = implied.derivatives(whole, b), weigh(whole[:p, :p])
        h, slope = inner(d, d), inner(d, (sample - whole[:p, :p])[None])[:, 0]
        step, size = np.linalg.pinv(h, rcond=1e-13, hermitian=True) @ slope, 1.0
        while (new := gap(values + size * step)) > now - 1e-4 * size * float(slope @ step) and size > 1e-10:
            size /= 2
        if size <= 1e-10 or float(slope @ step) < 1e-18:
            break
        values, now = values + size * step, new
    whole, b = implied.at(values)
    d = implied.derivatives(whole, b)
    h = weigh(whole[:p, :p])(d, d)
    scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
    if len(values) and np.linalg.eigvalsh(h / np.outer(scale, scale))[0] < 1e-10:
        raise ValueError("the model's parameters cannot be told apart by its covariances")
    errors = np.sqrt(np.diag(np.linalg.inv(h)) * 2 / n) if method != "uls" and len(values) else None
    return Result(model, implied.free, values, errors, whole, sample, n, _measures(model, implied, sample, whole[:p, :p], n, now))


def _measures(model: Model, implied: Implied, c: np.ndarray, sigma: np.ndarray, n: int, gap: float) -> dict[str, float]:
    p, k = len(c), len(model.exogenous)
    chi2, df = n * gap, p * (p + 1) // 2 - k * (k + 1) // 2 - len(implied.cells)
    df += sum(a in model.exogenous and b in model.exogenous for a, op, b in implied.free if op == "~~")
    own = [model.observed.index(v) for v in model.exogenous]
    rest = [i for i in range(p) if i not in own]
    none = np.linalg.slogdet(c[np.ix_(own, own)])[1] if own else 0.0
    base = n * (none + np.log(np.diag(c)[rest]).sum() - np.linalg.slogdet(c)[1])
    base_df = p * (p + 1) // 2 - k * (k + 1) // 2 - len(rest)
    over, base_over = max(chi2 - df, 0.0), max(base - base_df, chi2 - df, 1e-12)
    sd = np.sqrt(np.diag(c))
    low = np.tril_indices(p)
    apart = ((c - sigma) / np.outer(sd, sd))[low]
    inv = np.linalg.inv(sigma)
    shape = inv @ c
    ll = -0.5 * n * (p * math.log(2 * math.pi) + np.linalg.slogdet(sigma)[1] + np.trace(shape))
    q = len(implied.cells)
    out = {"n": float(n), "chi2": chi2, "df": float(df), "p": dist.chi2_sf(chi2, df) if df else 1.0, "cfi": 1 - over / base_over}
    out["tli"] = 1 - (chi2 / df - 1) / (base / base_df - 1) if df and base_df and base > base_df else 1.0
    out |= {"rmsea": math.sqrt(over / (df * n)) if df else 0.0, "srmr": float(np.sqrt(np.mean(apart**2)))}
    off = shape - np.eye(p)
    out |= {"gfi": float(1 - np.trace(off @ off) / np.trace(shape @ shape)), "ll": float(ll), "aic": float(2 * q - 2 * ll), "bic": float(q * math.log(n) - 2 * ll)}
    return out


def covariance(df: DataFrame, names: Sequence[str], fourth: bool = False) -> tuple[int, np.ndarray, np.ndarray | None]:
    """Complete rows, their covariance (divided by rows), and with `fourth` the covariance of the products of deviations."""
    if len(names) > MOST_VARIABLES:
        raise ValueError(f"a model has {MOST_VARIABLES} observed variables at most")
    rows = complete(df, {v: col(v) for v in names})
    means = rows.agg(*(F.avg(col(v).cast("double")) for v in names)).first()
    if means[0] is None:
        raise ValueError("no complete rows")
    away = {v: col(v).cast("double") - F.lit(m) for v, m in zip(names, means, strict=True)}
    got = rows.agg(F.count("*"), *cross_products(away, None)).first()
    n, p = got[0], len(names)
    second = _matrix(got[1:], p) / n
    if not fourth:
        return n, second, None
    low = list(zip(*np.tril_indices(p), strict=True))
    columns = {CONST: F.lit(1.0), **{f"{i}_{j}": away[names[i]] * away[names[j]] for i, j in low}}
    m = _matrix(rows.agg(*cross_products(columns, None)).first(), len(low) + 1) / n
    return n, second, m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:])


def fit(df: DataFrame, text: str, method: str = "ml") -> Result:
    """The model of `text` on the complete rows of df."""
    if method not in METHODS:
        raise ValueError(f"there are the methods {', '.join(METHODS)}")
    model = parse(text)
    n, sample, products = covariance(df, model.observed, method == "wls")
    if len(sample) * (len(sample) + 1) // 2 < len([p for p in model.parameters if p[3] is None]):
        raise ValueError("the model has more parameters than covariances")
    return fit_covariance(model, sample, n, method, products)


def sem(df: DataFrame, text: str, method: str = "ml") -> DataFrame:
    """lhs, op, rhs, estimate, se, z, p and std of every parameter; the measures of fit follow, with op `fit`."""
    done = fit(df, text, method)
    more = [{"lhs": k, "op": "fit", "rhs": "", "estimate": v, "se": None, "z": None, "p": None, "std": None} for k, v in done.measures.items()]
    return frame(df.sparkSession, [*done.rows(), *more], "lhs string, op string, rhs string, estimate double, se double, z double, p double, std double")
