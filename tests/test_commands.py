"""Commands of models, series, designs, views and of the session itself."""

from __future__ import annotations

import json
import math
import zipfile

import numpy as np
import pandas as pd
import pytest

from tallyfold.commands import host, views
from tallyfold.registry import COMMANDS, options, register_op
from tallyfold.session import Session


@pytest.fixture(scope="module")
def pdf():
    r = np.random.default_rng(1)
    n = 400
    x1, x2, u = r.normal(size=n), r.normal(size=n), r.normal(size=n)
    g = np.arange(n) % 20
    t = (r.random(n) < 0.5).astype(float)
    z = r.normal(size=n)
    slope = r.normal(0, 0.7, 20)[g]
    return pd.DataFrame({
        "id": np.arange(n), "t": np.arange(n), "g": [f"g{k:02d}" for k in g], "f1": np.array(["a", "b", "c"])[r.integers(0, 3, n)], "f2": np.array(["u", "v"])[r.integers(0, 2, n)], "x1": x1, "x2": x2, "z": z, "e": 0.8 * z + u,
        "y": 1 + 2 * x1 - x2 + 0.5 * r.normal(size=n), "yg": 1 + (1 + slope) * x1 + r.normal(0, 1, 20)[g] + 0.5 * r.normal(size=n), "iv": 1 + 1.5 * (0.8 * z + u) + u + 0.3 * r.normal(size=n), "d": t, "post": (np.arange(n) % 3 == 0).astype(float),
        "cnt": r.poisson(np.exp(0.3 + 0.2 * x1)).astype(float), "bin": (r.random(n) < 1 / (1 + np.exp(-x1))).astype(float), "w": r.uniform(1, 3, n), "ar": pd.Series(r.normal(size=n)).ewm(alpha=0.4).mean(),
        "time": r.exponential(1, n), "died": (r.random(n) < 0.7).astype(int), "w1": x1, "w2": x2,
    })


@pytest.fixture
def s(spark, pdf):
    s = Session(spark)
    s.use(spark.createDataFrame(pdf))
    s.run("tsset t")
    return s


def _rows(s, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in s.result.collect()}


def test_option_syntaxes():
    assert options("x --k --m=2 n=3 by(a b) on id") == (["x", "on", "id"], {"k": "true", "m": "2", "n": "3", "by": "a b", "on": "id"})


def test_tables(s):
    s.run("melt id x1 x2 id(id g) var_name=v")
    s.undo()
    s.run("select id w1 w2")
    s.run("reshape long w, i(id) j(k)")
    assert s.df.count() == 800
    s.run("reshape wide w, i(id) j(k)")
    assert s.df.count() == 400
    s.undo()
    s.run("duplicates drop id")
    assert s.df.count() == 400
    s.run("duplicates id")
    assert s.result.first().duplicates == 0
    s.run("validate w notnull between=-10,10")
    assert all(r.passed for r in s.result.collect())


def test_shift_and_smooth(s, spark):
    s.use(spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as d, 1 as t"))
    s.run("datetime shift d 2 days into(e)")
    assert str(s.df.first().e).startswith("2024-01-03")


def test_designs(s, pdf):
    s.run("anova2 y f1 f2")
    got = _rows(s, "source")
    # by least squares with and without a term
    def design(parts):
        cols = [np.ones(len(pdf))]
        a = [(pdf.f1 == v).astype(float).to_numpy() for v in ("b", "c")]
        b = [(pdf.f2 == "v").astype(float).to_numpy()]
        groups = {"f1": a, "f2": b, "f1:f2": [p * q for p in a for q in b]}
        x = np.column_stack(cols + [c for k in parts for c in groups[k]])
        beta = np.linalg.lstsq(x, pdf.y, rcond=None)[0]
        return float(((pdf.y - x @ beta) ** 2).sum())

    full = design(["f1", "f2", "f1:f2"])
    assert got["residual"].ss == pytest.approx(full)
    assert got["f1"].ss == pytest.approx(design(["f2", "f1:f2"]) - full, rel=1e-6)
    assert got["f1:f2"].df == 2
    s.run("svyset g [pw=w], strata(f2)")
    s.run("svy: ols y x1 x2")
    assert s.fit.params[1] == pytest.approx(2, abs=0.1)
    s.run("svy: logit bin x1")
    x = np.column_stack([np.ones(len(pdf)), pdf.x1])
    p = 1 / (1 + np.exp(-x @ s.fit.params))
    assert np.abs(x.T @ (pdf.w * (pdf.bin - p))).max() < 1e-4  # the weighted score is zero at the maximum
    s.run("svy: summarize y")
    assert s.result.first()["mean"] == pytest.approx((pdf.w * pdf.y).sum() / pdf.w.sum())


def test_models(s, pdf):
    s.run("ivregress 2sls iv ~ x1 (e = z)")
    assert _rows(s, "term")["e"].coef == pytest.approx(1.5, abs=0.2)
    s.run("estat firststage")
    assert s.result.first().f > 10
    s.run("estat endogtest")
    assert s.result.first().p < 0.01
    s.run("did y ~ d post")
    assert [r.term for r in s.result.collect()][-1] == "d:post"
    for line in ("leverage y x1 x2", "cooksd y x1", "dfbeta y x1", "outlier y x1 threshold(2)"):
        s.run(line)
        assert s.result.count()
    s.run("automodel y ~ x1 x2 z --criterion=bic")
    assert set(s.result.first().model.split(" + ")) == {"x1", "x2"}
    s.run("bayes: ols y x1 x2, samples(500)")
    assert _rows(s, "term")["x1"]["mean"] == pytest.approx(2, abs=0.1)
    s.run("hurdle cnt x1")
    assert {r.part for r in s.result.collect()} == {"zero", "count"}
    s.run("sureg (y x1) (iv x1 z)")
    assert _rows(s, "equation")["corr"].coef is not None
    s.run("nls time x1, fn(exp)") if (pdf.time > 0).all() else None
    s.run("mi impute y x1 x2, m(2) rounds(1)")
    s.run("mi estimate: ols y x1")
    assert s.result.count() == 2
    s.undo()
    s.run("xtset g t")
    s.run("xtreg y ~ x1, fe")
    s.run("hausman")
    assert s.result.first().df == 1
    s.run("mixed yg ~ x1 || g: x1")
    got = _rows(s, "term")
    assert got["x1"].coef == pytest.approx(1, abs=0.6) and got["var_x1"].coef == pytest.approx(0.49, abs=0.4) and got["var_residual"].coef == pytest.approx(0.25, abs=0.06)
    s.run("estat icc")
    assert 0 < s.result.first().coef < 1
    s.run("stset time, failure=died")
    s.settings.update(time="time", failure="died")
    s.run("stcox x1")
    s.run("estat phtest")
    assert 0 <= s.result.first().p <= 1


def test_power(s):
    s.run("power twomeans delta(0.5) power(0.8)")
    assert s.result.first().n == 63
    s.run("sampsi 0 0.5")
    assert s.result.first().n == 63


def test_stored_models(s, tmp_path):
    s.run("ols y ~ x1")
    s.run("estimates store a")
    s.run("ols y ~ x1 + x2")
    s.run("estimates store b")
    s.run("estimates table")
    assert s.result.columns == ["term", "a", "b"]
    s.run("esttab stats(coef,pval)")
    assert "***" in _rows(s, "term")["x1"].a
    s.run(f"outreg using {tmp_path}/m.tex")
    assert "tabular" in (tmp_path / "m.tex").read_text()
    s.run(f"outreg using {tmp_path}/m.html format(html)")
    assert "<table>" in (tmp_path / "m.html").read_text()
    s.run("estat all")
    assert s.result.count() == 3


def test_series(s, pdf):
    s.run("arima ar order(1,0,0)")
    assert 0.2 < _rows(s, "term")["ar1"].value < 1
    s.run("forecast 3")
    assert s.result.count() == 3
    s.run("var y x1 lags(1)")
    s.run("forecast 2")
    assert s.result.columns == ["step", "y", "x1"]
    s.run("irf steps=4")
    assert s.result.count() == 20
    s.run("tssmooth ar method(exp) alpha(0.5)")
    assert s.df.count() == len(pdf)


def test_latent_and_network(s, spark):
    s.run("cfa f =~ y + x1 + x2")
    assert s.result.where("op = '=~'").count() == 3
    s.run("learncurve y x1 x2")
    assert s.result.count() == 4
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]
    s.use(spark.createDataFrame(edges, "src string, dst string"))
    s.run("network build src dst")
    s.run("network centrality betweenness")
    assert {r.node: round(r.betweenness, 6) for r in s.result.collect()} == {"a": 0, "b": 0.5, "c": round(4 / 6, 6), "d": 0.5, "e": 0}
    s.run("network centrality closeness")
    assert {r.node: round(r.closeness, 6) for r in s.result.collect()}["c"] == round(4 / 6, 6)
    s.run("network distances a")
    assert s.result.agg({"hops": "max"}).first()[0] == 4


def test_umap_keeps_clusters_apart(s, spark):
    r = np.random.default_rng(0)
    x = np.concatenate((r.normal(0, 0.1, (30, 3)), r.normal(5, 0.1, (30, 3))))
    s.use(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])))
    s.run("umap a b c neighbors=8")
    z = np.array([[q.dim1, q.dim2] for q in s.result.orderBy("row").collect()])
    d = np.linalg.norm(z[:, None] - z[None], axis=2) + 1e9 * np.eye(60)
    assert ((d.argmin(axis=1) < 30) == (np.arange(60) < 30)).mean() > 0.95


def test_views(s, pdf, tmp_path):
    s.run(f"plot hist y bins=10 saving({tmp_path}/h.svg)")
    assert s.result.agg({"n": "sum"}).first()[0] == len(pdf) and "<svg" in (tmp_path / "h.svg").read_text()
    s.run("plot scatter y x1")
    assert s.result.count() == len(pdf)
    s.run("plot box y by f1")
    assert s.result.count() == 3 and {r.group: r.median for r in s.result.collect()}["a"] == pytest.approx(pdf.y[pdf.f1 == "a"].median())
    s.run("plot bar y by f2")
    assert s.result.count() == 2
    s.run("plot line y t")
    s.run("plot acf ar lags=5")
    v = pdf.ar - pdf.ar.mean()
    assert _rows(s, "lag")[1].value == pytest.approx((v[1:].to_numpy() * v[:-1].to_numpy()).sum() / (v**2).sum())
    s.run("plot pacf ar lags=5")
    assert _rows(s, "lag")[1].value == pytest.approx((v[1:].to_numpy() * v[:-1].to_numpy()).sum() / (v**2).sum())
    s.run("plot interaction y x1 x2")
    assert s.result.count() == 6
    s.run("ols y ~ x1 + x2")
    for line in ("plot coef", "plot diagnostics", "residplot y x1", "qqplot y", "violin y by f2", "pairplot y x1 x2", "plotmissing y x1", "plot3d y x1 x2"):
        s.run(line)
        assert s.result.count()
    s.run(f"corrplot y x1 x2 saving({tmp_path}/c.svg)")
    assert _rows(s, "variable")["y"].y == pytest.approx(1)
    s.run(f"plotanimated y x1 post --out={tmp_path}/a.html")
    for kind in ("md", "docx", "pptx", "pdf", "ipynb", "beamer", "apa"):
        s.run(f"export {kind} {tmp_path}/r.{kind}")
    assert json.loads((tmp_path / "r.ipynb").read_text())["cells"]
    assert zipfile.ZipFile(tmp_path / "r.docx").testzip() is None and zipfile.ZipFile(tmp_path / "r.pptx").testzip() is None
    assert (tmp_path / "r.pdf").read_bytes().startswith(b"%PDF")
    s.run(f"report eda {tmp_path}/e.html")
    assert "histogram of y" in (tmp_path / "e.html").read_text()


def test_session_commands(s, tmp_path, spark):
    s.run("alias su summarize")
    s.run("su y")
    assert s.result.first().variable == "y"
    s.run("bookmark save b count")
    s.run("bookmark load b")
    assert s.result.first()[0] == 400
    s.run("pipeline define p filter x1 > 0; count")
    s.run("pipeline run p")
    assert s.result.first()[0] < 400
    s.run("undo")
    s.run("display 2 + 3 * 4")
    assert s.result.first()[0] == "14"
    assert host.arithmetic("__import__('os')") is None
    s.run("forval i=1(2)5 : derive n`i' = x1 + `i'")
    assert {"n1", "n3", "n5"} <= set(s.df.columns)
    s.run("foreach v in x1 x2 : summarize `v'")
    s.run(f"log using {tmp_path}/l.txt")
    s.run("count")
    s.run("log close")
    assert "count" in (tmp_path / "l.txt").read_text()
    s.script("if N > 100 {\nderive big = 1\n} else {\nderive small = 1\n}\nif not col_exists nothing {\nderive ok = 1\n}")
    assert "big" in s.df.columns and "ok" in s.df.columns and "small" not in s.df.columns
    s.run("history search derive")
    assert s.result.count() >= 2
    s.run(f"session save {tmp_path}/s.txt")
    assert "count" in (tmp_path / "s.txt").read_text()
    s.run("session info")
    s.run("timer count")
    assert s.result.first().seconds >= 0
    s.run("help plot")
    assert s.result.count() >= 5
    s.run(f"set config_dir {tmp_path}")
    s.run("profile config save one")
    s.run("profile config load one")
    s.run("theme dark")
    s.run("ask \"what is the average of y\"")
    assert s.result.first().variable == "y"
    register_op("twice", lambda s, t: s.use(s.df.unionByName(s.df)))
    n = s.df.count()
    s.run("twice")
    assert s.df.count() == 2 * n
    COMMANDS.pop("twice")
    (tmp_path / "a.txt").write_text("count\n")
    s.run(f"batch {tmp_path}/a.txt {tmp_path}/none.txt")
    assert [r.state for r in s.result.collect()][0] == "done"
    s.run(f"watch {tmp_path}/a.txt --times=1")
    s.run("dashboard")
    s.run("version")
    s.run("plugin list")


def test_imports(s, tmp_path):
    (tmp_path / "d.csv").write_text("a;b\n1;x\n2;y\n")
    s.run(f"import url file://{tmp_path}/d.csv --sep=;")
    assert s.df.count() == 2 and dict(s.df.dtypes) == {"a": "bigint", "b": "string"}
    (tmp_path / "d.json").write_text('{"items": [{"a": 1}, {"a": 2}]}')
    s.run(f"webhook file://{tmp_path}/d.json")
    assert s.df.count() == 2
    (tmp_path / "s.do").write_text('use "data.csv", clear\ngen z = x + 1\nregress y x z, robust\nxyz\n')
    s.run(f"import do {tmp_path}/s.do")
    assert [r.line for r in s.result.collect()] == ["load data.csv", "derive z = x + 1", "ols y ~ x + z --robust", "# [untranslated] xyz"]
    (tmp_path / "s.sps").write_text("GET FILE='d.sav'.\nCOMPUTE z = x + 1.\nFREQUENCIES VARIABLES=g.\n")
    s.run(f"import spss {tmp_path}/s.sps")
    assert [r.line for r in s.result.collect()] == ["load d.sav", "derive z = x + 1", "tabulate g"]
    s.run("labels")
    assert s.result.count() == 0


def test_svg_of_nothing():
    assert "<svg" in views.svg([], "dots", "t") and not math.isnan(1)
