"""Views: frames that Spark aggregates, drawn as SVG where a path is given, and documents of the session's results."""

from __future__ import annotations

import html
import json
import math
import re
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.commands.models import as_latex
from tallyfold.functions.exprs import col
from tallyfold.operators import aggregate as A
from tallyfold.operators.ordered import order_statistics
from tallyfold.operators.transform import need, numeric_columns
from tallyfold.registry import command, options
from tallyfold.stats import dist, multivariate, regression
from tallyfold.stats.frames import complete, frame

#: Points of a scatter at most, drawn by a hash of the row; bars of a bar chart; rows of a table in a document.
POINTS, BARS, TABLE_ROWS = 5_000, 20, 50


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """low, high and n of equal bins (of each group)."""
    need(df, column)
    x = col(column).cast("double")
    rows = df.where(x.isNotNull())
    low, high = rows.agg(F.min(x), F.max(x)).first()
    width = ((high - low) / bins if low is not None else 0) or 1.0
    bin_ = F.least(F.floor((x - F.lit(low)) / width), F.lit(bins - 1))
    keys = [col(by).alias("group")] if by else []
    counts = rows.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select(*(["group"] if by else []), (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n").orderBy(*(["group"] if by else []), "low")


def points(df: DataFrame, columns: Sequence[str], n: int = POINTS) -> DataFrame:
    """At most n complete rows of the columns, the first by a hash."""
    need(df, *columns)
    rows = complete(df, {c: col(c) for c in columns}).select(*(col(c).cast("double").alias(c) for c in columns))
    return rows.orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in columns))).limit(n)


def box(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Quartiles, extremes and whiskers (1.5 times the spread of the quartiles) of each group."""
    x = col(column).cast("double")
    rows = df.where(x.isNotNull())
    keys = [col(by).alias("group")] if by else [F.lit("all").alias("group")]
    q = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(x).alias("high"))
    q = q.select("group", "n", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    return q.select("*", F.greatest("low", F.col("q1") - spread).alias("whisker_low"), F.least("high", F.col("q3") + spread).alias("whisker_high")).orderBy("group")


def bars(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Means of a column by group, or the most frequent values of a column."""
    if by:
        return df.where(col(by).isNotNull()).groupBy(col(by).cast("string").alias("label")).agg(F.avg(col(column)).alias("value")).orderBy("label")
    return df.where(col(column).isNotNull()).groupBy(col(column).cast("string").alias("label")).agg(F.count("*").cast("double").alias("value")).orderBy(F.desc("value"), "label").limit(BARS)


def line(df: DataFrame, y: str, x: str) -> DataFrame:
    """The mean of y at each x."""
    return df.where(col(y).isNotNull() & col(x).isNotNull()).groupBy(col(x).alias(x)).agg(F.avg(col(y)).alias(y)).orderBy(x)


def interaction(df: DataFrame, y: str, x: str, z: str) -> DataFrame:
    """Predicted y at the mean of x and a deviation around it, for the mean of z and a deviation around it."""
    fit = regression.ols(df, f"{y} ~ {x} * {z}")
    m = df.agg(F.avg(col(x)), F.stddev_samp(col(x)), F.avg(col(z)), F.stddev_samp(col(z))).first()
    b = dict(zip(fit.names, fit.params, strict=True))
    rows = [(m[0] + i * m[1], m[2] + j * m[3]) for j in (-1, 1) for i in (-1, 0, 1)]
    return frame(df.sparkSession, [{x: u, z: v, "predicted": b["const"] + b[x] * u + b[z] * v + b[f"{x}:{z}"] * u * v} for u, v in rows])


def autocorrelation(df: DataFrame, column: str, order: Sequence[str], most: int = 20, partial: bool = False) -> DataFrame:
    """lag and (partial) autocorrelation; all lagged products come from one pass."""
    from tallyfold.stats.timeseries import lagged

    mean = df.agg(F.avg(col(column))).first()[0]
    rows = lagged(df.withColumn("__x", col(column).cast("double") - F.lit(mean)), ["__x"], most, order)
    got = rows.agg(F.sum(F.col("__x") ** 2), *(F.sum(F.col("__x") * F.col(f"__x_l{k}")) for k in range(1, most + 1))).first()
    r = [(v or 0.0) / got[0] for v in got]
    if partial:  # Durbin and Levinson
        phi, out = [], [1.0]
        for k in range(1, most + 1):
            top = r[k] - sum(p * r[k - 1 - i] for i, p in enumerate(phi))
            last = top / (1 - sum(p * r[i + 1] for i, p in enumerate(phi)))
            phi = [p - last * phi[k - 2 - i] for i, p in enumerate(phi)] + [last]
            out.append(last)
        r = out
    return frame(df.sparkSession, [{"lag": k, "value": v} for k, v in enumerate(r)], "lag long, value double")


def normal_quantiles(df: DataFrame, column: str, n: int = 200) -> DataFrame:
    """Quantiles of the column beside those of the normal distribution."""
    qs = [(i + 0.5) / n for i in range(n)]
    got = order_statistics(df, column, qs, "linear").orderBy("q").collect()
    return frame(df.sparkSession, [{"theoretical": dist.norm_ppf(r["q"]), "sample": r["value"]} for r in got], "theoretical double, sample double")


def missing(df: DataFrame, columns: Sequence[str] = (), rows: int = 50) -> DataFrame:
    """The share of nulls of each column in `rows` hashed groups of rows."""
    columns = list(columns) or df.columns
    need(df, *columns)
    part = F.pmod(F.xxhash64(*(col(c) for c in df.columns)), F.lit(rows)).alias("part")
    return df.groupBy(part).agg(*(F.avg(col(c).isNull().cast("double")).alias(c) for c in columns)).orderBy("part")


def residual_points(df: DataFrame, spec: str) -> DataFrame:
    fit = regression.ols(df, spec)
    return points(regression.predict(regression.residuals(df, fit, "residual"), fit, "fitted"), ["fitted", "residual"])


# drawing


def svg(rows: Sequence[Sequence], kind: str, title: str, size: tuple[int, int] = (640, 420)) -> str:
    """Rows (x, y) as dots, a line or bars, or a matrix of numbers as shaded cells. Labels stand under bars and beside cells."""
    w, h, pad = *size, 48
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" font-family="sans-serif" font-size="11">', f'<text x="{w / 2}" y="18" text-anchor="middle">{html.escape(title)}</text>']
    if kind == "cells" and rows:
        n, m = len(rows), len(rows[0]) - 1
        cw, ch = (w - 2 * pad) / max(m, 1), (h - 2 * pad) / n
        for i, (label, *values) in enumerate(rows):
            out.append(f'<text x="{pad - 4}" y="{pad + (i + 0.6) * ch:.1f}" text-anchor="end">{html.escape(str(label))}</text>')
            for j, v in enumerate(values):
                v = 0.0 if v is None or not math.isfinite(v) else v
                out.append(f'<rect x="{pad + j * cw:.1f}" y="{pad + i * ch:.1f}" width="{cw:.1f}" height="{ch:.1f}" fill="{"#3b6ea5" if v >= 0 else "#b5533c"}" fill-opacity="{min(abs(v), 1):.3f}"><title>{v:.4g}</title></rect>')
        return "\n".join([*out, "</svg>"])
    labels = [r[0] for r in rows] if kind == "bars" else []
    data = [(float(i) if kind == "bars" else float(r[0]), float(r[1])) for i, r in enumerate(rows) if r[1] is not None and (kind == "bars" or r[0] is not None)]
    xs, ys = [p[0] for p in data] or [0.0], [p[1] for p in data] or [0.0]
    y0, y1 = min(0.0, *ys) if kind == "bars" else min(ys), max(ys)
    sx = lambda x: pad + (x - min(xs)) / ((max(xs) - min(xs)) or 1) * (w - 2 * pad)
    sy = lambda y: h - pad - (y - y0) / ((y1 - y0) or 1) * (h - 2 * pad)
    if kind == "dots":
        out += [f'<circle cx="{sx(x):.1f}" cy="{sy(y):.1f}" r="2.5" fill="#3b6ea5" fill-opacity="0.6"/>' for x, y in data]
    elif kind == "line":
        out.append('<polyline fill="none" stroke="#3b6ea5" stroke-width="2" points="' + " ".join(f"{sx(x):.1f},{sy(y):.1f}" for x, y in data) + '"/>')
    else:
        bw = max((w - 2 * pad) / max(len(data), 1) * 0.8, 1)
        out += [f'<rect x="{sx(x) - bw / 2:.1f}" y="{min(sy(y), sy(0)):.1f}" width="{bw:.1f}" height="{abs(sy(0) - sy(y)):.1f}" fill="#3b6ea5"><title>{html.escape(str(lb))}: {y:.6g}</title></rect>' for lb, (x, y) in zip(labels, data, strict=False)]
        out += [f'<text x="{sx(x):.1f}" y="{h - pad + 14}" text-anchor="middle">{html.escape(str(lb)[:9])}</text>' for lb, (x, _) in zip(labels, data, strict=False) if len(data) <= BARS]
    out += [f'<text x="{pad - 4}" y="{sy(v):.1f}" text-anchor="end">{v:.4g}</text>' for v in (y0, y1)]
    return "\n".join([*out, "</svg>"])


def _show(s, df: DataFrame, kind: str, title: str, o: dict[str, str], columns: Sequence[str] | None = None) -> DataFrame:
    """The frame as the result; drawn to the path of `saving(...)` or `--out=`. What is drawn is bounded by the view itself."""
    path = o.get("saving") or o.get("out")
    if path:
        rows = [[r[c] for c in columns or df.columns] for r in df.limit(POINTS).collect()]
        done = svg([(r[0], r[-1]) if kind != "cells" else r for r in rows], kind, title)
        Path(path).write_text(f"<!doctype html><meta charset='utf-8'>{done}" if path.endswith((".html", ".htm")) else done)
    s.views.append((title, df))
    return s.report(df)


def _plot(s, text: str) -> DataFrame:
    """hist x | scatter y x | line y x | box x [by g] | bar x [by g] | heatmap [x ...] | coef | interaction y x z | margins | diagnostics | acf x | pacf x."""
    words, o = options(text)
    kind, *w = words
    by = o.get("by")
    w = w[: w.index("by")] if "by" in w else w
    if kind == "hist":
        return _show(s, histogram(s.df, w[0], int(o.get("bins", 30)), by), "bars", f"histogram of {w[0]}", o, ["low", "n"])
    if kind == "scatter":
        return _show(s, points(s.df, [w[1], w[0]]), "dots", f"{w[0]} by {w[1]}", o)
    if kind == "line":
        return _show(s, line(s.df, w[0], w[1]), "line", f"{w[0]} over {w[1]}", o)
    if kind == "box":
        return _show(s, box(s.df, w[0], by), "bars", f"quartiles of {w[0]}", o, ["group", "median"])
    if kind == "bar":
        return _show(s, bars(s.df, w[0], by), "bars", f"{w[0]}" + (f" by {by}" if by else ""), o)
    if kind == "heatmap":
        return _corrplot(s, " ".join([*w, *(f"{k}({v})" for k, v in o.items())]))
    if kind == "coef":
        return _show(s, s.fit.tidy(s.df).select("term", "ci_low", "ci_high", "coef"), "bars", "coefficients", o)
    if kind == "interaction":
        return _show(s, interaction(s.df, *w[:3]), "dots", f"{w[0]}: {w[1]} by {w[2]}", o, [w[1], "predicted"])
    if kind == "margins":
        return _show(s, regression.margins(s.df, s.fit, o.get("at", "means")), "bars", "marginal effects", o, ["term", "effect"])
    if kind == "diagnostics":
        rows = regression.predict(regression.residuals(s.df, s.fit, "residual"), s.fit, "fitted")
        return _show(s, points(rows, ["fitted", "residual"]), "dots", "residuals by fitted values", o)
    if kind in ("acf", "pacf"):
        return _show(s, autocorrelation(s.df, w[0], s.order(), int(o.get("lags", 20)), kind == "pacf"), "bars", f"{kind} of {w[0]}", o)
    raise ValueError((_plot.__doc__ or "").strip())


command("plot", "plotinteractive")(_plot)


def _numeric(s, words: Sequence[str]) -> list[str]:
    return list(words) or [c for c in numeric_columns(s.df) if not c.startswith("_")]


@command("corrplot")
def _corrplot(s, text: str) -> DataFrame:
    words, o = options(text)
    names = _numeric(s, words)
    r = multivariate.correlation(s.df, names)[0]
    df = frame(s.spark, [{"variable": n, **dict(zip(names, r[i], strict=True))} for i, n in enumerate(names)], "variable string, " + ", ".join(f"`{n}` double" for n in names))
    return _show(s, df, "cells", "correlations", o)


command("plotmissing")(lambda s, t: _show(s, missing(s.df, options(t)[0]), "cells", "share of missing values", options(t)[1]))
command("plot3d")(lambda s, t: _show(s, points(s.df, options(t)[0][:3]), "dots", "points", options(t)[1]))
command("pairplot")(lambda s, t: _show(s, points(s.df, _numeric(s, options(t)[0])), "dots", "pairs", options(t)[1]))
command("violin")(lambda s, t: _show(s, histogram(s.df, options(t)[0][0], 40, options(t)[1].get("by")), "bars", f"density of {options(t)[0][0]}", options(t)[1], ["low", "n"]))
command("qqplot")(lambda s, t: _show(s, normal_quantiles(s.df, options(t)[0][0]), "dots", f"normal quantiles of {options(t)[0][0]}", options(t)[1]))
command("residplot")(lambda s, t: _show(s, residual_points(s.df, s.spec(options(t)[0])), "dots", "residuals by fitted values", options(t)[1]))


@command("plotanimated")
def _plotanimated(s, text: str) -> DataFrame:
    """Mean y by x in each moment; with a path, an HTML page that shows one moment after another."""
    (y, x, time, *_), o = options(text)
    df = s.df.groupBy(col(time).alias("frame"), col(x).alias(x)).agg(F.avg(col(y)).alias(y)).orderBy("frame", x)
    if path := o.get("out"):
        by: dict[str, list] = {}
        for r in df.limit(POINTS).collect():
            by.setdefault(str(r["frame"]), []).append((r[x], r[y]))
        pages = "\n".join(f'<div class="f">{svg(rows, "dots", f"{time} {k}")}</div>' for k, rows in by.items())
        script = "let i=0,f=document.querySelectorAll('.f');setInterval(()=>{f.forEach((e,j)=>e.hidden=j!=i);i=(i+1)%f.length},600)"
        Path(path).write_text(f"<!doctype html><meta charset='utf-8'>{pages}<script>{script}</script>")
    return s.report(df)


# documents


def _tables(s) -> list[tuple[str, list[list[str]]]]:
    """Titles and first rows of the session's results."""
    found = []
    for title, df in s.views:
        rows = [["" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r] for r in df.limit(TABLE_ROWS).collect()]
        found.append((title, [df.columns, *rows]))
    return found


def _markdown(s, title: str = "Results") -> str:
    out = [f"# {title}", ""]
    for name, rows in _tables(s):
        out += [f"## {name}", "", "| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:]), ""]
    return "\n".join(out)


def _html(s, title: str = "Results") -> str:
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, rows in _tables(s):
        cells = lambda r, tag: "<tr>" + "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in r) + "</tr>"
        out += [f"<h2>{html.escape(name)}</h2><table>", cells(rows[0], "th"), *(cells(r, "td") for r in rows[1:]), "</table>"]
    return "\n".join(out)


def _notebook(s) -> str:
    cells = [{"cell_type": "code", "execution_count": None, "metadata": {}, "outputs": [], "source": [f"session.run({line!r})"]} for line in s.history]
    first = {"cell_type": "code", "execution_count": None, "metadata": {}, "outputs": [], "source": ["from pyspark.sql import SparkSession\n", "from tallyfold.session import Session\n", "session = Session(SparkSession.builder.getOrCreate())"]}
    return json.dumps({"cells": [first, *cells], "metadata": {}, "nbformat": 4, "nbformat_minor": 5}, indent=1)


def _beamer(s, o: dict[str, str]) -> str:
    head = [r"\documentclass{beamer}", rf"\usetheme{{{o.get('theme', 'Madrid')}}}", rf"\title{{{o.get('title', 'Results')}}}", rf"\author{{{o.get('author', '')}}}", r"\begin{document}", r"\frame{\titlepage}"]
    pages = [f"\\begin{{frame}}{{{name}}}\n{as_latex(rows)}\\end{{frame}}" for name, rows in _tables(s)]
    return "\n".join([*head, *pages, r"\end{document}", ""])


def _office(s, path: str) -> None:
    """A minimal Word or PowerPoint file: a paragraph, or a slide, for each table."""
    text = lambda x: html.escape(x, quote=False)
    kinds = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{}</Types>'
    rels = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
    base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        if path.endswith("docx"):
            p = "".join(f"<w:p><w:r><w:t>{text(name)}</w:t></w:r></w:p><w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{text(x)}</w:t></w:r></w:p></w:tc>" for x in r) + "</w:tr>" for r in rows) + "</w:tbl><w:p/>" for name, rows in _tables(s))
            z.writestr("[Content_Types].xml", kinds.format('<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'))
            z.writestr("_rels/.rels", rels.format(f'<Relationship Id="r1" Type="{base}/officeDocument" Target="word/document.xml"/>'))
            z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{p}</w:body></w:document>')
            return
        pages, main = _tables(s), "application/vnd.openxmlformats-officedocument.presentationml."
        ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="' + base + '"'
        z.writestr("[Content_Types].xml", kinds.format(f'<Override PartName="/ppt/presentation.xml" ContentType="{main}presentation.main+xml"/>' + "".join(f'<Override PartName="/ppt/slides/slide{i}.xml" ContentType="{main}slide+xml"/>' for i in range(1, len(pages) + 1))))
        z.writestr("_rels/.rels", rels.format(f'<Relationship Id="r1" Type="{base}/officeDocument" Target="ppt/presentation.xml"/>'))
        z.writestr("ppt/presentation.xml", f'<?xml version="1.0"?><p:presentation {ns}><p:sldIdLst>' + "".join(f'<p:sldId id="{255 + i}" r:id="s{i}"/>' for i in range(1, len(pages) + 1)) + '</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels.format("".join(f'<Relationship Id="s{i}" Type="{base}/slide" Target="slides/slide{i}.xml"/>' for i in range(1, len(pages) + 1))))
        for i, (name, rows) in enumerate(pages, 1):
            body = "".join(f"<a:p><a:r><a:t>{text(x)}</a:t></a:r></a:p>" for x in [name, *("   ".join(r) for r in rows[:15])])
            z.writestr(f"ppt/slides/slide{i}.xml", f'<?xml version="1.0"?><p:sld {ns}><p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/><p:sp><p:nvSpPr><p:cNvPr id="2" name="t"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{body}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>')


def _pdf(lines: Sequence[str]) -> bytes:
    """Pages of plain text."""
    clean = lambda x: x.encode("latin-1", "replace").decode("latin-1").replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
    pages = [lines[i : i + 60] for i in range(0, len(lines), 60)] or [[]]
    parts = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"]
    for i, page in enumerate(pages):
        body = "BT /F1 9 Tf 36 800 Td 12 TL\n" + "\n".join(f"({clean(x[:110])}) Tj T*" for x in page) + "\nET"
        parts += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>", f"<< /Length {len(body.encode('latin-1'))} >>\nstream\n{body}\nendstream"]
    out, places = b"%PDF-1.4\n", []
    for i, p in enumerate(parts, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n{p}\nendobj\n".encode("latin-1")
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(parts) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(parts) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode("latin-1")


def _export(s, text: str) -> DataFrame:
    """docx, pptx, pdf, md, html, ipynb, apa or beamer, to a path."""
    words, o = options(text)
    kind = words[0]
    path = Path(words[1] if len(words) > 1 else f"results.{dict(beamer='tex', apa='html').get(kind, kind)}")
    if kind in ("docx", "pptx"):
        _office(s, str(path))
    elif kind == "pdf":
        path.write_bytes(_pdf(_markdown(s).split("\n")))
    else:
        makers = {"md": lambda: _markdown(s, o.get("title", "Results")), "html": lambda: _html(s), "ipynb": lambda: _notebook(s), "beamer": lambda: _beamer(s, o), "apa": lambda: re.sub(r">(-?)0\.(\d)", r">\1.\2", _html(s, o.get("title", "Tables")))}
        if kind not in makers:
            raise ValueError(f"export {kind}: there are docx, pptx, pdf, {', '.join(makers)}")
        path.write_text(makers[kind]())
    return s.report(frame(s.spark, [{"path": str(path), "tables": len(s.views)}], "path string, tables long"))


command("export")(_export)
for _k in ("beamer", "ipynb", "apa", "pdf", "md"):
    command(f"export {_k}")(lambda s, t, k=_k: _export(s, f"{k} {t}"))


@command("report")
def _report(s, text: str) -> DataFrame:
    """`report path.md` of the results, or `report eda [path.html]`: profile, missing values, correlations and histograms of the table."""
    words, _ = options(text)
    if words[:1] == ["eda"]:
        names = [c for c in numeric_columns(s.df) if not c.startswith("_")][:BARS]
        s.views += [("profile", A.profile(s.df)), ("missing values", A.missing_pattern(s.df))]
        if len(names) > 1:
            s.views.append(("correlations", A.corr(s.df, names)))
        s.views += [(f"histogram of {c}", histogram(s.df, c)) for c in names]
        path = Path(words[1] if len(words) > 1 else "eda.html")
        path.write_text(_html(s, "Overview"))
    else:
        path = Path(words[0] if words else "report.md")
        path.write_text(_markdown(s))
    return s.report(frame(s.spark, [{"path": str(path), "tables": len(s.views)}], "path string, tables long"))
