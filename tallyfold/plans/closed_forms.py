"""DuckDB SQL of least squares and of Newton's steps, made of sums and one small Cholesky solution."""

from __future__ import annotations

from collections.abc import Sequence


def _solve(name: str, k: int) -> list[str]:
    """CTEs from `<name>_0` (h_i_j for i <= j, and c_i) to `<name>`: the solution b_i and the inverse v_i_j."""
    out, last = [], f"{name}_0"

    def stage(columns: Sequence[str]) -> None:
        nonlocal last
        new = f"{name}_{len(out) + 1}"
        out.append(f"{new} AS (SELECT *, {', '.join(columns)} FROM {last})")
        last = new

    for s in range(k):
        stage([f"sqrt(h_{s}_{s}" + "".join(f" - l_{s}_{t} * l_{s}_{t}" for t in range(s)) + f") AS l_{s}_{s}"])
        if s + 1 < k:
            stage([f"(h_{s}_{i}" + "".join(f" - l_{i}_{t} * l_{s}_{t}" for t in range(s)) + f") / l_{s}_{s} AS l_{i}_{s}" for i in range(s + 1, k)])
    for i in range(k):
        stage([f"1 / l_{i}_{i} AS m_{i}_{i}", *("-(" + " + ".join(f"l_{i}_{t} * m_{t}_{j}" for t in range(j, i)) + f") / l_{i}_{i} AS m_{i}_{j}" for j in range(i))])
    stage([" + ".join(f"m_{i}_{j} * c_{j}" for j in range(i + 1)) + f" AS z_{i}" for i in range(k)])
    columns = [" + ".join(f"m_{r}_{i} * z_{r}" for r in range(i, k)) + f" AS b_{i}" for i in range(k)]
    columns += [" + ".join(f"m_{r}_{i} * m_{r}_{j}" for r in range(max(i, j), k)) + f" AS v_{i}_{j}" for i in range(k) for j in range(k)]
    out.append(f"{name} AS MATERIALIZED (SELECT *, {', '.join(columns)} FROM {last})")
    return out


def least_squares(name: str, data: str, y: str, xs: Sequence[str], ridge: float = 0.0, weight: str = "1.0") -> str:
    """CTEs up to `<name>`: n, b_i, v_i_j and rss of y on a constant and xs over `data`."""
    x = ["1.0", *xs]
    k = len(x)
    sums = [f"sum(({weight}) * ({x[i]}) * ({x[j]}))" + (f" + {ridge}" if ridge and i == j else "") + f" AS h_{i}_{j}" for i in range(k) for j in range(i, k)]
    sums += [f"sum(({weight}) * ({x[i]}) * ({y})) AS c_{i}" for i in range(k)]
    first = f"{name}_0 AS (SELECT count(*)::DOUBLE AS n, sum(({weight}) * ({y}) * ({y})) AS yy, avg({y}) AS ybar, {', '.join(sums)} FROM {data})"
    parts = [first, *_solve(name, k)]
    residual = f"({y}) - (" + " + ".join(f"b_{i} * ({x[i]})" for i in range(k)) + ")"
    parts.append(f"{name}_rss AS MATERIALIZED (SELECT sum(({residual}) ** 2) AS rss, sum((({y}) - ybar) ** 2) AS tss FROM {data} AS source, {name})")
    return ", ".join(parts)


#: Mean, weight and score of a row at the linear predictor `eta` for canonical links.
FAMILIES = {"logit": ("1 / (1 + exp(-eta))", "mu * (1 - mu)"), "poisson": ("exp(eta)", "mu")}


def newton(name: str, data: str, y: str, xs: Sequence[str], family: str, start: str, steps: int = 9, weight: str = "1.0") -> str:
    """CTEs up to `<name>`: b_i and v_i_j after Newton's steps from (start, 0, 0, ...); `data` has plain columns."""
    x = ["1.0", *xs]
    k = len(x)
    mean, spread = FAMILIES[family]
    parts = [f"{name}s0 AS MATERIALIZED (SELECT {start} AS b_0, " + ", ".join(f"0.0 AS b_{i}" for i in range(1, k)) + f" FROM {data})"]
    for t in range(1, steps + 1):
        step = f"{name}d{t}"
        eta = " + ".join(f"b_{i} * ({x[i]})" for i in range(k))
        parts.append(f"{step}_e AS (SELECT source.*, b_0 AS a_0, {', '.join(f'b_{i} AS a_{i}' for i in range(1, k))}, {eta} AS eta FROM {data} AS source, {name}s{t - 1})")
        parts.append(f"{step}_m AS (SELECT *, {mean} AS mu FROM {step}_e)")
        sums = [f"sum(({weight}) * ({spread}) * ({x[i]}) * ({x[j]})) AS h_{i}_{j}" for i in range(k) for j in range(i, k)] + [f"sum(({weight}) * (({y}) - mu) * ({x[i]})) AS c_{i}" for i in range(k)] + [f"any_value(a_{i}) AS a_{i}" for i in range(k)]
        parts.append(f"{step}_0 AS (SELECT {', '.join(sums)} FROM {step}_m)")
        parts += _solve(step, k)
        last = t == steps
        kept = [f"a_{i} + b_{i} AS b_{i}" for i in range(k)] + ([f"v_{i}_{j}" for i in range(k) for j in range(k)] if last else [])
        parts.append(f"{name if last else f'{name}s{t}'} AS MATERIALIZED (SELECT {', '.join(kept)} FROM {step})")
    return ", ".join(parts)


def terms(name: str, names: Sequence[str], digits: int = 5, se: str | None = None, source: str | None = None) -> str:
    """A SELECT of term and coef (and the error, as an expression of {v}: the inverse's diagonal element)."""
    texts = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    coef = "[" + ", ".join(f"round(b_{i}, {digits}) + 0.0" for i in range(len(names))) + "]"
    errors = ", unnest([" + ", ".join(f"round({se.format(v=f'v_{i}_{i}')}, {digits})" for i in range(len(names))) + "]) AS se" if se else ""
    return f"SELECT unnest({texts}) AS term, unnest({coef}) AS coef{errors} FROM {source or name}"
