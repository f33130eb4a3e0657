"""Commands of models, designs, series and what comes after a fit."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame

from tallyfold.operators import aggregate as A
from tallyfold.operators import sets as S
from tallyfold.operators import sketches
from tallyfold.registry import command, options, report, table, trailing
from tallyfold.stats import boot, causal, designs, explain, imputation, learning, likelihood, multivariate, network, regression, smooth, structural, timeseries
from tallyfold.stats import tests as H
from tallyfold.stats.frames import frame
from tallyfold.stats.regression import Fit
from tallyfold.streaming import runs, windows


def _fit(s, fit: Fit) -> DataFrame:
    s.fit = fit
    return s.report(fit.tidy(s.df))


def _spec(text: str) -> tuple[str, dict[str, str]]:
    """A formula and the options behind it."""
    spec, *rest = re.split(r"\s--|,", text, maxsplit=1)
    return spec.strip(), trailing(rest[0] if rest else "")


def _sums(words: Sequence[str]) -> str:
    """`y x1 x2` as the formula y ~ x1 + x2; a formula stays."""
    return " ".join(words) if "~" in words else f"{words[0]} ~ {' + '.join(words[1:])}"


def _plain(words: Sequence[str]) -> list[str]:
    return [w for w in words if w not in ("~", "+")]


# tables

table("melt", lambda s, w, o: _melt(s, w, o))
table("tssmooth", lambda s, w, o: A.smooth_exp(s.df, w[0], float(o.get("alpha", 0.3)), s.order(), [s.settings["panel"]] if s.settings.get("panel") not in (None, s.settings.get("time")) else []) if o.get("method") == "exp" else A.smooth_ma(s.df, w[0], int(o.get("window", 3)), s.order()))
table("reshape", lambda s, w, o: A.reshape_long(s.df, w[1], o["i"].split(), o["j"]) if w[0] == "long" else A.reshape_wide(s.df, w[1:], o["i"].split(), o["j"], s.order()))


def _melt(s, words: Sequence[str], o: dict[str, str]) -> DataFrame:
    """Identifiers are the words of `id(...)`, or the first word; the values are the others."""
    ids = o["id"].split() if "id" in o else words[:1]
    return A.melt(s.df, ids, [w for w in words if w not in ids], o.get("var_name", "variable"), o.get("value_name", "value"))


@command("duplicates")
def _duplicates(s, text: str) -> DataFrame:
    words, _ = options(text)
    return s.use(S.drop_duplicates(s.df, words[1:], s.order())) if words[:1] == ["drop"] else s.report(S.duplicates(s.df, words))


@command("validate")
def _validate(s, text: str) -> DataFrame:
    column, *rules = text.split()
    found: dict[str, object] = {}
    for r in rules:
        k, _, v = r.partition("=")
        found[k] = True if not v else float(v) if k in ("min", "max") else [float(x) for x in v.split(",")] if k == "between" else v.split(",") if k == "oneof" else v
    return s.report(A.validate(s.df, column, found))


# tests

report("anova2", lambda s, w, o: designs.anova2(s.df, *w[:3], interaction="nointeraction" not in o))
report("power", lambda s, w, o: frame(s.spark, [H.power(w[0], float(o.pop("alpha", 0.05)), **{k: float(v) for k, v in o.items()})], "n double, power double"))
report("sampsi", lambda s, w, o: frame(s.spark, [H.sampsi(float(w[0]), float(w[1]), float(o.get("sd", 1)), float(o.get("alpha", 0.05)), float(o.get("power", 0.8)))], "n double, power double"))

def _bootstrap(s, words: Sequence[str], o: dict[str, str]) -> DataFrame:
    """`bootstrap x [by(g)] [stat(mean)] [n(2000)] [ci(0.95)]`; without a column, the coefficients of the last ols, logit, probit or poisson fit."""
    ci, seed = float(o.get("ci", 0.95)), int(s.settings["seed"])
    if words:
        return H.bootstrap(s.df, words[0], o.get("stat", "mean"), int(o.get("n", 2000)), ci, seed, o.get("by"))
    if s.fit is None:
        raise ValueError("bootstrap needs a column, or a model fit before it")
    if s.fit.kind not in ("ols", "logit", "probit", "poisson"):
        raise ValueError("the bootstrap of a model takes ols, logit, probit and poisson")
    return boot.model_bootstrap(s.df, s.fit.formula, s.fit.kind, int(o.get("n", 500)), ci, seed)


report("bootstrap", _bootstrap)

# regressions

command("nls")(lambda s, t: (lambda w, o: _fit(s, likelihood.nls(s.df, w[0], w[1], o.get("fn", "power"), [float(x) for x in o["p0"].split()] if "p0" in o else ())))(*options(t)))
command("did")(lambda s, t: (lambda w, o: _fit(s, regression.did(s.df, *_plain(w)[:3], "robust" in o, o.get("cluster"))))(_spec(t)[0].split(), _spec(t)[1]))
report("automodel", lambda s, w, o: regression.automodel(s.df, _plain(w)[0], _plain(w)[1:], o.get("criterion", "aic"), int(o["maxvars"]) if "maxvars" in o else None))
report("leverage", lambda s, w, o: regression.influence(s.df, s.spec(w)))
report("cooksd", lambda s, w, o: regression.influence(s.df, s.spec(w)))
report("dfbeta", lambda s, w, o: regression.dfbeta(s.df, s.spec(w)))
report("outlier", lambda s, w, o: regression.outliers(s.df, s.spec(w), float(o.get("threshold", 3))))


@command("hurdle")
def _hurdle(s, text: str) -> DataFrame:
    first, s.fit = likelihood.hurdle(s.df, _sums(_spec(text)[0].split()))
    rows = [{"part": part, **{k: r[k] for k in ("term", "coef", "se", "p")}} for part, f in (("zero", first), ("count", s.fit)) for r in f.rows()]
    return s.report(frame(s.spark, rows, "part string, term string, coef double, se double, p double"))


@command("sureg")
def _sureg(s, text: str) -> DataFrame:
    """`sureg (y1 x1 x2) (y2 x3)`: coefficients, and the correlations of the residuals as rows of `corr`."""
    fits, corr = regression.sureg(s.df, [_sums(p.split()) for p in re.findall(r"\(([^()]*)\)", text)])
    rows = [{"equation": f.formula.y, "term": n, "coef": float(b), "se": float(e)} for f in fits for n, b, e in zip(f.names, f.params, f.se, strict=True)]
    rows += [{"equation": "corr", "term": f"{fits[i].formula.y}:{fits[j].formula.y}", "coef": float(corr[i, j]), "se": None} for i in range(len(fits)) for j in range(i)]
    return s.report(frame(s.spark, rows, "equation string, term string, coef double, se double"))


@command("bayes:", "bayes")
def _bayes(s, text: str) -> DataFrame:
    spec, o = _spec(re.sub(r"^\s*:?\s*ols\s+", "", text))
    return s.report(regression.bayes(s.df, _sums(spec.split()), float(o.get("priorscale", 10)), int(o.get("samples", 4000)), float(o.get("ci", 0.95)), int(s.settings["seed"])))


@command("ivregress")
def _ivregress(s, text: str) -> DataFrame:
    m = re.match(r"(?:2sls\s+)?(\w+)\s*~?\s*([^()]*)\(([^=()]+)=([^()]+)\)(.*)", text.strip())
    if not m:
        raise ValueError("ivregress 2sls y ~ x1 (endogenous = instruments)")
    s.iv = (m[1], [w for w in m[2].split() if w != "+"], m[3].split(), m[4].split())
    return _fit(s, regression.ivregress(s.df, *s.iv, robust="robust" in m[5]))


@command("hausman")
def _hausman(s, _: str) -> DataFrame:
    """The fixed and the random effects of the last `xtreg`."""
    return s.report(regression.hausman(s.df, *(regression.xtreg(s.df, s.xt, s.settings["panel"], how) for how in ("fe", "re"))))


@command("mi")
def _mi(s, text: str) -> DataFrame:
    """impute [chained] [(regress|logit|pmm)] x1 x2 ..., add(m) knn(k) rounds(r); a method holds for the columns behind it. estimate: ols y ~ x. describe [x ...]."""
    what, _, rest = text.strip().partition(" ")
    words, o = options(rest.lstrip(": "))
    if what == "impute":
        how, methods = "regress", {}
        for w in words:
            name = w.strip("()")
            if name in imputation.METHODS:
                how = name
            elif name != "chained":
                methods[name] = how
        return s.use(imputation.impute(s.df, methods, int(o.get("add", o.get("m", 5))), int(o.get("rounds", 10)), int(o.get("knn", 5)), int(s.settings["seed"])))
    if what.rstrip(":") == "estimate":
        return s.report(causal.rubin(s.df, _sums(words[1:] if words[0] == "ols" else words)))
    return s.report(A.missing_pattern(s.df, words))


report("psmatch", lambda s, w, o: causal.psmatch(s.df, w[0], o["treatment"], _plain(w)[1:], float(o["caliper"]) if "caliper" in o else None, int(o.get("nn", 1))))


@command("shap")
def _shap(s, text: str) -> DataFrame:
    """shap y x1 x2 --model=rf|gb|linear [--n=100] [--depth=d]: mean attributions over all rows."""
    w, o = options(text)
    kind = {"gb": "gbm", "tree": "cart"}.get(o.get("model", "rf"), o.get("model", "rf"))
    if kind == "linear":
        return s.report(learning.shap_linear(s.df, w[0], w[1:]))
    if kind not in ("rf", "gbm", "cart"):
        raise ValueError("shap --model=rf, gb, tree or linear")
    more = {"n": int(o.get("n", 100))} | ({"depth": int(o["depth"])} if "depth" in o else {})
    return s.report(explain.shap_trees(s.df, w[0], w[1:], kind, seed=int(s.settings["seed"]), **more))


@command("sketch")
def _sketch(s, text: str) -> DataFrame:
    """sketch distinct(a b) quantiles(x) [by(g)] [lg(12)] [k(200)] makes the table of sketches active; sketch merge [by(g)] merges it; sketch estimate [at(0.25 0.5)] reports."""
    words, o = options(text)
    by = o.get("by", "").split()
    if words[:1] == ["estimate"]:
        out = sketches.estimated(s.df, [float(q) for q in o.get("at", "0.25 0.5 0.75").split()])
        o.check()
        return s.report(out)
    if words[:1] == ["merge"]:
        out = sketches.merged(s.df, by)
    else:
        out = sketches.sketched(s.df, by, o.get("distinct", "").split(), o.get("quantiles", "").split(), int(o.get("lg", 12)), int(o.get("k", 200)))
    o.check()
    return s.use(out)


@command("stream")
def _stream(s, text: str) -> DataFrame:
    """stream path time(ts) width(1 hour) [slide(..)] late(10 minutes) value(x) [by(g)], or gap(..) for sessions; sink(..) and checkpoint(..) let a later run go on. The final windows become the active table."""
    words, o = options(text)
    time, late, by = o["time"], o.get("late", "0 seconds"), o.get("by", "").split()
    if "gap" in o:
        gap = o["gap"]
        make = lambda r: windows.sessions(r, time, gap, late, by)
    else:
        width, slide, value = o["width"], o.get("slide"), o["value"]
        make = lambda r: windows.tumbling(r, time, width, late, by, value, slide)
    sink, checkpoint, files = o.get("sink"), o.get("checkpoint"), int(o["files"]) if "files" in o else None
    o.check()
    return s.use(runs.over(s.spark, words[0], time, make, sink, checkpoint, files))


@command("spline")
def _spline(s, text: str) -> DataFrame:
    """spline y x1 [x2 ...] [--type=natural|bs] [--knots=n or a,b,c]; --type=loess [--frac=0.3] [--rounds=3] [--vertices=n]. --summary reports the fit, --gen=name adds the curve to the table."""
    given = re.search(r"--knots=(\S+)", text)
    words, o = options(re.sub(r"--knots=\S+", "", text))
    kind, new = o.get("type", "natural"), o.get("gen")
    if kind == "loess":
        shape = (float(o.get("frac", 0.3)), int(o.get("rounds", 3)), int(o.get("vertices", smooth.VERTICES)))
        run = (smooth.loess, smooth.loess_summary, smooth.loess_values)
        args: tuple = (words[0], words[1], *shape)
    elif kind in ("natural", "bs"):
        at = given[1].split(",") if given else ["4"]
        run = (smooth.spline, smooth.spline_summary, smooth.spline_values)
        args = (words[0], words[1:], int(at[0]) if len(at) == 1 and at[0].isdigit() else [float(k) for k in at], kind)
    else:
        raise ValueError("spline --type=natural, bs or loess")
    summary = "summary" in o
    o.check()
    if new:
        return s.use(run[2](s.df, *args, new=new))
    return s.report(run[1 if summary else 0](s.df, *args))


# survey designs


@command("svyset")
def _svyset(s, text: str) -> None:
    weight = re.search(r"\[pw\s*=\s*(\w+)\]", text)
    words, o = options(re.sub(r"\[[^\]]*\]", " ", text))
    s.settings["svy"] = {"psu": words[0] if words else None, "weight": weight[1] if weight else o.get("weight"), "strata": o.get("strata")}


@command("svy:", "svy")
def _svy(s, text: str) -> DataFrame:
    plan = s.settings.get("svy") or {}
    if not plan.get("weight"):
        raise ValueError("declare the design first: svyset psu [pw=weight], strata(s)")
    kind, _, rest = text.strip().lstrip(": ").partition(" ")
    if kind == "summarize":
        return s.report(regression.svy_summary(s.df, rest.split(), plan["weight"]))
    return _fit(s, designs.svy(s.df, kind, _sums(_spec(rest)[0].split()), plan["weight"], plan["strata"], plan["psu"]))


# stored estimates and their tables


@command("estimates")
def _estimates(s, text: str) -> DataFrame | None:
    what, _, name = text.strip().partition(" ")
    if what == "store":
        s.stored[name.strip() or f"m{len(s.stored) + 1}"] = s.fit
        return None
    return s.report(model_table(s))


def _models(s) -> dict[str, Fit]:
    if not s.stored and s.fit is None:
        raise ValueError("no model has been fitted")
    return s.stored or {s.fit.kind: s.fit}


def _stars(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


def model_table(s, cells: Sequence[str] = ("coef", "se"), stars: bool = True) -> DataFrame:
    """term, then for each stored model a text with its cells; the last rows hold n and R2."""
    models = _models(s)
    by = {k: {r["term"]: r for r in f.rows()} for k, f in models.items()}
    names = {"coef": lambda r: f"{r['coef']:.4f}{_stars(r['p']) if stars else ''}", "se": lambda r: f"({r['se']:.4f})", "pval": lambda r: f"[{r['p']:.4f}]"}
    rows = [{"term": t, **{k: " ".join(names[c](by[k][t]) for c in cells) if t in by[k] else "" for k in models}} for t in dict.fromkeys(t for b in by.values() for t in b)]
    rows.append({"term": "N", **{k: str(f.n) for k, f in models.items()}})
    rows.append({"term": "R2", **{k: next((f"{f.stats[x]:.4f}" for x in ("r2", "pseudo_r2") if x in f.stats), "") for k, f in models.items()}})
    return frame(s.spark, rows, ", ".join(f"`{c}` string" for c in rows[0]))


def _rows(s, **k) -> list[list[str]]:
    df = model_table(s, **k)
    return [df.columns, *([x or "" for x in r] for r in df.collect())]


def as_latex(rows: Sequence[Sequence[str]]) -> str:
    clean = lambda x: re.sub(r"([_&%#$])", r"\\\1", x)
    body = [" & ".join(map(clean, r)) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{l" + "c" * (len(rows[0]) - 1) + "}", r"\hline", body[0], r"\hline", *body[1:], r"\hline", r"\end{tabular}", ""])


def as_html(rows: Sequence[Sequence[str]]) -> str:
    cells = lambda r, tag: "<tr>" + "".join(f"<{tag}>{x}</{tag}>" for x in r) + "</tr>"
    return "\n".join(["<table>", cells(rows[0], "th"), *(cells(r, "td") for r in rows[1:]), "</table>", ""])


report("esttab", lambda s, w, o: model_table(s, o["stats"].replace(",", " ").split() if "stats" in o else ("coef", "se"), "nostars" not in o))


@command("outreg", "latex")
def _outreg(s, text: str) -> DataFrame:
    """The model table as LaTeX or HTML, written to the path that is given."""
    words, o = options(text)
    path = o.get("using") or next((w for w in words if w != "using"), None)
    rows = _rows(s)
    done = as_html(rows) if o.get("format") == "html" else as_latex(rows)
    if path:
        Path(path).write_text(done)
    return s.report(frame(s.spark, [{"text": done}], "text string"))


@command("estat")
def _estat(s, text: str) -> DataFrame:
    test, fit = text.strip(), s.fit
    if fit is None:
        raise ValueError("no model has been fitted")
    if test in ("firststage", "overid"):
        if fit.kind != "iv":
            raise ValueError(f"estat {test} follows ivregress")
        if test == "overid":
            return s.report(frame(s.spark, [{"test": test, "statistic": fit.stats["sargan"], "df": len(s.iv[3]) - len(s.iv[2]), "p": fit.stats["sargan_p"]}], "test string, statistic double, df long, p double"))
        return s.report(frame(s.spark, [{"endogenous": e, "f": fit.stats[f"first_stage_f_{e}"]} for e in s.iv[2]], "endogenous string, f double"))
    if test == "endogtest":
        return s.report(regression.endogtest(s.df, *s.iv))
    if test == "deff":
        return s.report(regression.design_effect(s.df, s.settings["svy"]["weight"]))
    if test == "icc":
        return s.report(s.mixed.where("term = 'icc'"))
    if test == "phtest":
        from tallyfold.stats.survival import proportional

        return s.report(proportional(s.df, s.settings["time"], s.settings["failure"], fit))
    if test == "all":
        out = None
        for t in ("hettest", "ovtest", "linktest"):
            one = regression.estat(s.df, fit, t).selectExpr("test", "cast(statistic as double) statistic", "cast(df as double) df", "p")
            out = one if out is None else out.unionByName(one)
        return s.report(out)
    return s.report(regression.estat(s.df, fit, test))


# series


@command("var")
def _var(s, text: str) -> DataFrame:
    words, o = options(text)
    lags = int(o.get("lags", 1))
    s.var = (timeseries.var_model(s.df, words, lags, s.order()), lags)
    rows = [{"equation": f.formula.y, **{k: r[k] for k in ("term", "coef", "se", "p")}} for f in s.var[0] for r in f.rows()]
    s.series = None
    return s.report(frame(s.spark, rows, "equation string, term string, coef double, se double, p double"))


@command("arima")
def _arima(s, text: str) -> DataFrame:
    words, o = options(text)
    s.series = (words[0], tuple(int(x) for x in o.get("order", "1 0 0").replace(",", " ").split()))
    return s.report(timeseries.arima(s.df, s.series[0], s.order(), s.series[1]))


@command("forecast")
def _forecast(s, text: str) -> DataFrame:
    """Steps ahead of the last `arima` or `var`."""
    steps = int(text.split()[0]) if text.split() else 10
    if s.series:
        return s.report(timeseries.arima(s.df, s.series[0], s.order(), s.series[1], steps=steps).where("term like 'forecast%'"))
    if s.var is None:
        raise ValueError("forecast follows arima or var")
    return s.report(timeseries.var_forecast(s.df, *s.var, s.order(), steps))


@command("irf")
def _irf(s, text: str) -> DataFrame:
    if s.var is None:
        raise ValueError("irf follows var")
    return s.report(timeseries.impulse_responses(s.df, *s.var, int(options(text)[1].get("steps", 10))))


# learning, latent variables, networks

report("hyperopt", lambda s, w, o: learning.hyperopt(s.df, w[0], w[1:], {"gb": "gbm"}.get(o.get("model", "rf"), o.get("model", "rf")), o.get("task", "regression"), int(o.get("cv", 5)), int(o.get("draws", 20)), int(s.settings["seed"])))
@command("learncurve")
def _learncurve(s, text: str) -> DataFrame:
    """learncurve y x1 x2 [--model=ols|logit|rf|gb|cart] [--steps=10] [--cv=5] [--task=classification] [--n=100]; ols without --steps takes four sizes."""
    w, o = options(text)
    given = "steps" in o
    kind, steps, folds, task = o.get("model", "ols"), int(o.get("steps", 10)), int(o.get("cv", 5)), o.get("task")
    more = {"n": int(o["n"])} if "n" in o else {}
    o.check()
    if kind in ("ols", "linear"):
        return s.report(learning.learning_curve(s.df, w[0], w[1:], **({"sizes": [0.1 + 0.9 * i / max(steps - 1, 1) for i in range(steps)]} if given else {}), folds=folds))
    return s.report(learning.model_curve(s.df, w[0], w[1:], kind, steps, folds, task, int(s.settings["seed"]), **more))


report("umap", lambda s, w, o: multivariate.umap(s.df, w, int(o.get("n", 2)), int(o.get("neighbors", 15)), seed=int(s.settings["seed"])))
report("screeplot", lambda s, w, o: multivariate.pca(s.df, w))


@command("sem")
def _sem(s, text: str) -> DataFrame:
    """`f =~ x1 + x2 + x3; y ~ f + z; x1 ~~ x2`, lines ended by ; or a line break. --method=ml|gls|uls|wls."""
    body, *rest = re.split(r"\s--", text, maxsplit=1)
    _, o = options("--" + rest[0] if rest else "")
    out = structural.sem(s.df, body, o.get("method", "ml"))
    o.check()
    return s.report(out)


@command("cfa")
def _cfa(s, text: str) -> DataFrame:
    """Factors with their indicators: `f =~ x1 + x2 + x3`, several joined by ; or by a + before the next factor."""
    body = re.split(r"\s--", text)[0].strip().strip('"')
    found = re.findall(r"(\w+)\s*=~\s*((?:\w+\s*\+?\s*)+?)(?=;|\n|\+?\s*\w+\s*=~|$)", body)
    if not found:
        raise ValueError("a factor is: f =~ x1 + x2 + x3")
    return s.report(multivariate.sem(s.df, {f: [x for x in re.split(r"[+\s]+", xs) if x] for f, xs in found}))


@command("network")
def _network(s, text: str) -> DataFrame:
    """build src dst [weight] [--directed]; describe; centrality degree|eigenvector|closeness|betweenness; clustering; community; distances node."""
    words, o = options(text)
    what, *rest = words
    if what == "build":
        s.network = network.build(s.df, *rest[:3], directed="directed" in o)
        return s.report(network.degree(s.network))
    if s.network is None:
        raise ValueError("network build comes first")
    kind = rest[0] if rest else ""
    known = {
        "describe": lambda: network.describe(s.network), "clustering": lambda: network.clustering(s.network), "community": lambda: _communities(s, o), "distances": lambda: network.distances(s.network, s.spark.createDataFrame([(kind,)], "node string")),
        "centrality": lambda: {"eigenvector": network.eigenvector, "closeness": network.closeness, "betweenness": network.betweenness}.get(kind, network.degree)(s.network), "plot": lambda: s.network,
    }
    if what != "community":
        o.check()
    if what not in known:
        raise ValueError(f"network {what}: there are build, {', '.join(known)}")
    return s.report(known[what]())


def _communities(s, o) -> DataFrame:
    """By greatest modularity (--louvain, --greedy, or no word), or by --labels."""
    by_labels = "labels" in o
    named = [k for k in ("louvain", "greedy") if k in o]
    o.check()
    if by_labels and named:
        raise ValueError("choose --labels or --louvain")
    return network.communities(s.network) if by_labels else network.louvain(s.network, int(s.settings["seed"]))
