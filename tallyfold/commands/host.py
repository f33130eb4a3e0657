"""Commands of the session itself: aliases, history, macros, logs, named chains, imports and translators."""

from __future__ import annotations

import ast
import json
import operator
import re
import shlex
import shutil
import subprocess
import time
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame

import tallyfold
from tallyfold.operators import aggregate as A
from tallyfold.registry import COMMANDS, command, load_plugins, options, plugins, report
from tallyfold.sources import files
from tallyfold.stats.frames import frame


def _texts(s, rows: list[tuple], *names: str) -> DataFrame:
    return s.report(s.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)))


def _store(s, text: str, held: dict, make) -> DataFrame | None:
    """list, rm NAME, or `make` of the words."""
    words = text.split(None, 1)
    if not words or words[0] == "list":
        return _texts(s, sorted((k, str(v)) for k, v in held.items()), "name", "value")
    if words[0] == "rm":
        held.pop(words[1].strip())
        return None
    return make(words[0], words[1] if len(words) > 1 else "")


def _kept(held: dict, k: str, v: str) -> None:
    held[k] = v


command("alias")(lambda s, t: _store(s, t, s.aliases, lambda k, v: _kept(s.aliases, k, v)))


@command("bookmark")
def _bookmark(s, text: str) -> DataFrame | None:
    """save NAME command | load NAME | list | rm NAME."""

    def make(what: str, rest: str) -> DataFrame | None:
        name, _, line = rest.partition(" ")
        return s.run(s.bookmarks[name]) if what == "load" else _kept(s.bookmarks, name, line or s.history[-2])

    return _store(s, text, s.bookmarks, make)


@command("pipeline")
def _pipeline(s, text: str) -> DataFrame | None:
    """define NAME command; command | run NAME | show NAME | list | rm NAME."""

    def make(what: str, rest: str) -> DataFrame | None:
        name, _, lines = rest.partition(" ")
        if what == "define":
            s.pipelines[name] = [x.strip() for x in re.split(r"[;\n]", lines) if x.strip()]
        elif what == "show":
            return _texts(s, [(str(i + 1), x) for i, x in enumerate(s.pipelines[name])], "step", "command")
        else:
            for line in s.pipelines[name]:
                s.run(line)
        return s.result if what == "run" else None

    return _store(s, text, s.pipelines, make)


@command("profile config")
def _profile(s, text: str) -> DataFrame | None:
    """save NAME | load NAME | list | rm NAME, below the folder of `set config_dir`."""
    folder = Path(s.settings.get("config_dir", Path.home() / ".tallyfold"))
    what, _, name = text.strip().partition(" ")
    path = folder / f"{name.strip()}.json"
    if what == "save":
        folder.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"settings": {k: v for k, v in s.settings.items() if isinstance(v, (str, int, float))}, "aliases": s.aliases}))
    elif what == "load":
        got = json.loads(path.read_text())
        s.settings |= got["settings"]
        s.aliases |= got["aliases"]
    elif what == "rm":
        path.unlink()
    else:
        return _texts(s, sorted((p.stem, str(p)) for p in folder.glob("*.json")), "name", "path")
    return None


@command("batch")
def _batch(s, text: str) -> DataFrame:
    """Scripts in turn; with --stop-on-error the first failure ends the batch."""
    words, o = options(text)
    rows = []
    for path in words:
        try:
            s.script(Path(path).read_text())
            rows.append((path, "done"))
        except Exception as e:
            rows.append((path, str(e).split("\n")[0]))
            if "stop-on-error" in o:
                break
    return _texts(s, rows, "script", "state")


@command("watch")
def _watch(s, text: str) -> None:
    """Runs a script whenever its file changes, `--times` runs in all."""
    words, o = options(text)
    path, last, left = Path(words[0]), 0.0, int(o.get("times", 1 << 30))
    while left:
        if (now := path.stat().st_mtime) != last:
            s.script(path.read_text())
            last, left = now, left - 1
        if left:
            time.sleep(float(o.get("interval", 2)))


@command("timer", "progress")
def _timer(s, text: str) -> DataFrame:
    began = time.time()
    s.run(text)
    return s.report(frame(s.spark, [{"command": text, "seconds": time.time() - began}], "command string, seconds double"))


@command("history show", "history")
def _history(s, text: str) -> DataFrame:
    n = int(options(text)[1].get("n", 20))
    return _texts(s, [(str(i + 1), x) for i, x in enumerate(s.history)][-n:], "number", "command")


@command("history search")
def _search(s, text: str) -> DataFrame:
    words, o = options(text)
    return _texts(s, [(str(i + 1), x) for i, x in enumerate(s.history) if re.search(words[0], x)][-int(o.get("n", 20)) :], "number", "command")


@command("session")
def _session(s, text: str) -> DataFrame | None:
    """info | save PATH | replay PATH."""
    what, _, path = text.strip().partition(" ")
    if what == "save":
        Path(path.strip()).write_text("\n".join(x for x in s.history if not x.startswith("session ")) + "\n")
        return None
    if what == "replay":
        s.script(Path(path.strip()).read_text())
        return None
    rows = [("commands", len(s.history)), ("columns", len(s.df.columns) if s.df is not None else 0), ("undo", len(s._undo)), ("seed", s.settings["seed"]), ("models", len(s.stored))]
    return _texts(s, [(k, str(v)) for k, v in rows], "name", "value")


command("version")(lambda s, t: _texts(s, [("tallyfold", getattr(tallyfold, "__version__", "0")), ("pyspark", pyspark.__version__)], "name", "version"))


@command("log")
def _log(s, text: str) -> DataFrame | None:
    """using PATH | close | status | display | clear."""
    what, _, path = text.strip().partition(" ")
    if what == "using":
        s.log = Path(path.strip())
        s.log.touch()
    elif what == "close":
        s.log = None
    elif what == "clear":
        s.log.write_text("")
    elif what == "display":
        return _texts(s, [(x,) for x in s.log.read_text().splitlines()], "line")
    else:
        return _texts(s, [("open" if s.log else "closed", str(s.log or ""))], "state", "path")
    return None


_MATH = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.Mod: operator.mod, ast.USub: operator.neg}


def arithmetic(text: str) -> float | None:
    """The value of + - * / % ** over numbers; None for any other text."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _MATH:
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and abs(b) > 1000:
                raise ValueError
            return _MATH[type(node.op)](a, b)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _MATH:
            return _MATH[type(node.op)](value(node.operand))
        raise ValueError

    try:
        return value(ast.parse(text.strip(), mode="eval").body)
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError):
        return None


command("display")(lambda s, t: _texts(s, [(str(t.strip().strip('"') if (v := arithmetic(t)) is None else v),)], "text"))


def _loop(s, text: str, split) -> None:
    head, _, line = text.partition(":")
    name, _, rest = re.sub(r"\s*(=|\bin\b)\s*", "\n", head.strip(), count=1).partition("\n")
    for item in split(rest.strip()):
        s.macros[name] = item
        s.run(line.strip())
    s.macros.pop(name, None)


command("forval", "forvalues")(lambda s, t: _loop(s, t, s.values))
command("foreach")(lambda s, t: _loop(s, t, str.split))


@command("help")
def _help(s, text: str) -> DataFrame:
    """The commands with what they say of themselves, or those whose name begins with a word."""
    word = next((w for w in options(text)[0]), "")
    rows = [(k, ((f.__doc__ or "").strip().split("\n")[0] if f.__name__ != "<lambda>" else "")) for k, f in sorted(COMMANDS.items()) if k.startswith(word)]
    return _texts(s, rows, "command", "about")


command("multiline")(lambda s, t: _texts(s, [("A script block begins with foreach, forvalues or if and {, and ends with }.",)], "text"))


def _choice(key: str, known: tuple[str, ...]):
    def run(s, text: str) -> DataFrame:
        value = (text.replace("set ", "", 1).split() or [""])[0]
        if value in ("list", "get", ""):
            return _texts(s, [(k, "*" if k == s.settings.get(key, known[0]) else "") for k in known], key, "chosen")
        if value not in known:
            raise ValueError(f"{key}: one of {', '.join(known)}")
        s.settings[key] = value
        return _texts(s, [(value, "*")], key, "chosen")

    return run


command("theme")(_choice("theme", ("light", "dark", "plain")))
command("locale")(_choice("locale", ("en", "tr")))


@command("plugin")
def _plugin(s, text: str) -> DataFrame:
    """list | info NAME | load."""
    what, _, name = text.strip().partition(" ")
    if what == "load":
        load_plugins()
    found = plugins()
    return _texts(s, [(k, v) for k, v in sorted(found.items()) if what != "info" or k == name.strip()], "name", "target")


@command("git")
def _git(s, text: str) -> DataFrame:
    """init, status, add, commit, log or diff in the working folder."""
    words = shlex.split(text)
    if words[:1] and words[0] not in ("init", "status", "add", "commit", "log", "diff"):
        raise ValueError("git: init, status, add, commit, log or diff")
    done = subprocess.run(["git", *words], capture_output=True, text=True, timeout=60, check=False)
    return _texts(s, [(x,) for x in (done.stdout + done.stderr).splitlines()], "line")


@command("r")
def _r(s, text: str) -> DataFrame:
    """Runs code with Rscript, if it is installed; what it prints is the result."""
    program = shutil.which("Rscript")
    if not program:
        raise ValueError("Rscript is not installed")
    done = subprocess.run([program, "-e", text.strip().strip('"')], capture_output=True, text=True, timeout=600, check=False)
    return _texts(s, [(x,) for x in (done.stdout + done.stderr).splitlines()], "line")


#: Fixed words of `ask`, and the command that each stands for; {0}, {1} are columns in the order of the question.
ASKED = (
    (r"\b(correlat|related)", "corr {0} {1}"), (r"\bmedian|\bquartile|\bsummar|\baverage|\bmean", "summarize {0}"), (r"\b(frequen|how many .* each|distribution of)", "tabulate {0}"),
    (r"\b(predict|explain|regress|effect of)", "ols {0} ~ {1}"), (r"\bmissing", "mdpattern"), (r"\bhow many|\bcount", "count"), (r"\bcolumns|\bdescribe", "describe"),
)


@command("ask")
def _ask(s, text: str) -> DataFrame | None:
    """A question in English, by fixed rules: the columns that it names and what it asks of them. No service is called."""
    question = text.strip().strip('"').lower()
    names = sorted((c for c in s.df.columns if re.search(rf"\b{re.escape(c.lower())}\b", question)), key=lambda c: question.index(c.lower()))
    for pattern, line in ASKED:
        if re.search(pattern, question) and line.count("{") <= len(names):
            return s.run(line.format(*names))
    raise ValueError("the question names no known column or no known measure")


@command("dashboard")
def _dashboard(s, text: str) -> DataFrame:
    """The session at a glance: table, settings and the last commands."""
    rows = [("column", f"{n}: {t}") for n, t in (s.df.dtypes if s.df is not None else [])]
    rows += [("setting", f"{k} = {v}") for k, v in s.settings.items()] + [("command", x) for x in s.history[-10:]]
    return _texts(s, rows, "kind", "text")


# sources


def _params(text: str) -> dict[str, str]:
    return dict(p.split(":", 1) for p in text.split(",") if ":" in p)


def _raw(text: str) -> tuple[list[str], dict[str, str]]:
    """Words and --options; `=` and `:` inside a word stay."""
    words, found = [], {}
    for w in shlex.split(text):
        k, _, v = w[2:].partition("=")
        found.update({k: v or "true"}) if w.startswith("--") else words.append(w)
    return words, found


command("import url")(lambda s, t: (lambda w, o: s.use(files.load_url(s.spark, w[0], o.get("format"), o.get("sep", ","))))(*_raw(t)))
command("webhook")(lambda s, t: (lambda w, o: s.use(files.web_json(s.spark, w[0], o.get("method", "GET"), _params(o.get("params", "")), o.get("json_path", ""))))(*_raw(t)))
command("import clipboard")(lambda s, t: s.use(files.load_text(s.spark, files.clipboard(), _raw(t)[1].get("sep"))))
report("labels", lambda s, w, o: _labels(s, w))
report("datadict", lambda s, w, o: _datadict(s, o))


def _labels(s, words: list[str]) -> DataFrame:
    rows = [(c, k, v) for c in words or s.df.columns for k, v in files.labels_of(s.df, c).items()]
    return s.spark.createDataFrame(rows, "column string, value string, label string")


def _datadict(s, o: dict[str, str]) -> DataFrame:
    df = A.data_dictionary(s.df)
    if "out" in o:
        rows = [df.columns, *([("" if x is None else str(x)) for x in r] for r in df.collect())]
        Path(o["out"]).write_text("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]) + "\n")
    return df


# translators of foreign scripts

#: Lines of Stata, and the commands that they become.
STATA = (
    (r'use\s+"?([^",]+)"?.*', r"load \1"), (r'import delimited\s+(?:using\s+)?"?([^",]+)"?.*', r"load \1"), (r"gen(?:erate)?\s+(\w+)\s*=\s*(.+)", r"derive \1 = \2"), (r"keep if\s+(.+)", r"filter \1"),
    (r"drop if\s+(.+)", r"filter not (\1)"), (r"keep\s+(.+)", r"select \1"), (r"su(?:m(?:marize)?)?\s+(.+)", r"summarize \1"), (r"tab(?:ulate)?\s+(\w+)\s+(\w+).*", r"crosstab \1 \2"), (r"tab(?:ulate)?\s+(\w+).*", r"tabulate \1"),
    (r"reg(?:ress)?\s+(\w+)\s+([^,]+)(?:,\s*(?:vce\()?r(?:obust)?\)?)", r"ols \1 ~ \2 --robust"), (r"(?:reg(?:ress)?)\s+(\w+)\s+([^,]+)", r"ols \1 ~ \2"), (r"(logit|probit|poisson)\s+(\w+)\s+([^,]+).*", r"\1 \2 ~ \3"),
    (r"ren(?:ame)?\s+(\w+)\s+(\w+)", r"rename \1 \2"), (r"(?:g)?sort\s+(.+)", r"sort \1"), (r"corr(?:elate)?\s+(.+)", r"corr \1"), (r"(?:save)\s+\"?([^\",]+)\"?.*", r"save \1"), (r"egen\s+(\w+)\s*=\s*(\w+)\((\w+)\)(?:,\s*by\((\w+)\))?", r"egen \1 = \2(\3) by(\4)"),
    (r"ttest\s+(\w+)\s*,\s*by\((\w+)\)", r"ttest \1 by \2"), (r"predict\s+(\w+)\s*$", r"predict \1"), (r"merge\s+1:1\s+(\w+)\s+using\s+\"?([^\",]+)\"?.*", r"merge \2 on \1"),
)
#: Statements of SPSS syntax, and the commands that they become.
SPSS = (
    (r"GET FILE\s*=\s*['\"]([^'\"]+)['\"].*", r"load \1"), (r"SAVE OUTFILE\s*=\s*['\"]([^'\"]+)['\"].*", r"save \1"), (r"COMPUTE\s+(\w+)\s*=\s*(.+)", r"derive \1 = \2"), (r"SELECT IF\s*\(?(.+?)\)?$", r"filter \1"),
    (r"FREQUENCIES\s+(?:VARIABLES\s*=\s*)?(\w+).*", r"tabulate \1"), (r"DESCRIPTIVES\s+(?:VARIABLES\s*=\s*)?([\w ]+?)(?:\s*/.*)?$", r"summarize \1"), (r"CORRELATIONS\s+(?:/?VARIABLES\s*=\s*)?([\w ]+?)(?:\s*/.*)?$", r"corr \1"),
    (r"CROSSTABS\s+(?:/?TABLES\s*=\s*)?(\w+)\s+BY\s+(\w+).*", r"crosstab \1 \2"), (r"REGRESSION.*?/DEPENDENT\s*=?\s*(\w+).*?/METHOD\s*=\s*ENTER\s+([\w ]+).*", r"ols \1 ~ \2"), (r"SORT CASES\s+(?:BY\s+)?([\w ]+).*", r"sort \1"),
)


def translate(statements: list[str], rules: tuple[tuple[str, str], ...]) -> list[str]:
    """A command for each statement that a rule knows; the others stay as comments."""
    out = []
    for line in statements:
        for pattern, to in rules:
            if re.fullmatch(pattern, line, re.IGNORECASE | re.DOTALL):
                done = re.sub(r"\s*by\(\)$", "", re.sub(f"^{pattern}$", to, line, count=1, flags=re.IGNORECASE | re.DOTALL)).strip()
                if " ~ " in done:
                    left, _, right = done.partition(" ~ ")
                    terms, mark, rest = right.partition(" --")
                    done = f"{left} ~ {' + '.join(terms.split())}{mark}{rest}"
                out.append(re.sub(r"\s&\s", " and ", re.sub(r"\s\|\s", " or ", done)))
                break
        else:
            out.append(f"# [untranslated] {line}")
    return out


def from_stata(text: str) -> list[str]:
    lines = [re.sub(r"//.*$", "", x).strip() for x in re.sub(r"/\*.*?\*/", "", text, flags=re.DOTALL).replace("///\n", " ").splitlines()]
    return translate([x for x in lines if x and not x.startswith("*")], STATA)


def from_spss(text: str) -> list[str]:
    parts = [" ".join(x.split()) for x in re.split(r"\.\s*(?:\n|$)", text)]
    return translate([x for x in parts if x and not x.startswith("*")], SPSS)


def _import(reader):
    def run(s, text: str) -> DataFrame:
        words, o = _raw(text)
        lines = reader(Path(words[0]).read_text())
        if "out" in o:
            Path(o["out"]).write_text("\n".join(lines) + "\n")
        if "run" in o:
            s.script("\n".join(lines))
        return _texts(s, [(x,) for x in lines], "line")

    return run


command("import do")(_import(from_stata))
command("import spss")(_import(from_spss))
