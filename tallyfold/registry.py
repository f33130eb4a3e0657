"""Commands by name, the option syntaxes that they share, and commands of other packages."""

from __future__ import annotations

import re
import shlex
from collections.abc import Callable, ItemsView, Iterator
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import DataFrame

Command = Callable[[Any, str], DataFrame | None]
COMMANDS: dict[str, Command] = {}
#: Entry points of other packages that add commands: each is a function of a session and the rest of the line.
PLUGINS = "tallyfold.commands"
#: Words that begin a clause.
CLAUSES = ("by", "on", "over", "using", "as")


class Options(dict):
    """The options of a line, which knows the ones that a command has looked at; clauses stay positional words and need no look."""

    def __init__(self) -> None:
        super().__init__()
        self.seen: set[str] = set()

    def __contains__(self, key: object) -> bool:
        self.seen.add(str(key))
        return super().__contains__(key)

    def __getitem__(self, key: str) -> str:
        self.seen.add(key)
        return super().__getitem__(key)

    def get(self, key: str, default: Any = None) -> Any:
        self.seen.add(key)
        return super().get(key, default)

    def pop(self, key: str, *default: Any) -> Any:
        self.seen.add(key)
        return super().pop(key, *default)

    def __iter__(self) -> Iterator[str]:
        self.seen.update(super().keys())
        return super().__iter__()

    def items(self) -> ItemsView:
        self.seen.update(super().keys())
        return super().items()

    def check(self) -> None:
        """Raises on options that the command did not look at."""
        left = [k for k in super().keys() if k not in self.seen and k not in CLAUSES]
        if left:
            raise ValueError(f"option not known here: {', '.join(left)}")


def options(text: str) -> tuple[list[str], Options]:
    """Positional words, and options of the forms --k, --k=v, k=v, k(v), and of clauses (`on id`), whose words stay positional too."""
    found = Options()

    def take(m: re.Match) -> str:
        found[m[1]] = m[2]
        return " "

    text = re.sub(r"(\w+)\(([^()]*)\)", take, text)
    words = []
    for w in shlex.split(text.replace(",", " ")):
        if w.startswith("--"):
            k, _, v = w[2:].partition("=")
            found[k] = v or "true"
        elif "=" in w[1:] and not w.startswith("="):
            k, _, v = w.partition("=")
            found[k] = v
        else:
            words.append(w)
    for i, w in enumerate(words[:-1]):
        if i and w in CLAUSES and not dict.__contains__(found, w):
            rest = words[i + 1 :]
            found[w] = " ".join(rest[: next((j for j, x in enumerate(rest) if x in CLAUSES), len(rest))])
    return words, found


def trailing(text: str) -> Options:
    """The options behind a formula's comma or first `--`: words without a value are options that are on."""
    words, found = options(text)
    for w in words:
        found[w] = "true"
    return found


def command(*names: str) -> Callable[[Command], Command]:
    """Registers a function of the session and the rest of the line."""

    def add(f: Command) -> Command:
        COMMANDS.update(dict.fromkeys(names, f))
        return f

    return add


def _checked(f: Callable[..., DataFrame], s: Any, text: str) -> DataFrame:
    words, found = options(text)
    out = f(s, words, found)
    found.check()
    return out


def table(name: str, f: Callable[..., DataFrame]) -> None:
    """A command whose table becomes the active one; f takes the session, words and options, and must look at every option that it knows."""
    COMMANDS[name] = lambda s, t: s.use(_checked(f, s, t))


def report(name: str, f: Callable[..., DataFrame]) -> None:
    """A command whose table becomes the session's result; options as for `table`."""
    COMMANDS[name] = lambda s, t: s.report(_checked(f, s, t))


def register_op(name: str, f: Command) -> None:
    """Adds a command at run time."""
    command(name)(f)


def plugins() -> dict[str, str]:
    """Names and targets of the installed plugin commands."""
    return {p.name: p.value for p in entry_points(group=PLUGINS)}


def load_plugins() -> list[str]:
    """Registers every installed plugin command; returns their names."""
    found = list(entry_points(group=PLUGINS))
    for p in found:
        register_op(p.name, p.load())
    return [p.name for p in found]
