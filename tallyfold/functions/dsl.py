"""The expression language of filter and derive, and the formula language of models.

Expressions become Columns. Precedence, from loosest: or, and, not, one comparison, + -,
* / %, ** (one exponent), unary minus. There are numbers, quoted strings, `quoted
names`, true, false and null.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.exprs import col, floor_mod, ieee_div, safe_log, safe_log10, strip


class ExpressionError(ValueError):
    """An expression that cannot be read, or names a column that is not there."""


_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>"[^"]*"|'[^']*')|`(?P<tick>[^`]+)`|(?P<id>[^\W\d]\w*)|(?P<op>\*\*|>=|<=|==|!=|[-+*/%<>(),]))""")


@dataclass(frozen=True)
class Value:
    """A Column with what the parser must know of it: whether it is text, and the number if it is a literal."""

    column: Column
    text: bool = False
    whole: bool = False
    literal: float | int | str | None = None


_ONE = {
    "log": safe_log, "log10": safe_log10, "sqrt": lambda x: F.sqrt(x.cast("double")), "abs": F.abs, "exp": lambda x: F.exp(x.cast("double")),
    "upper": F.upper, "lower": F.lower, "len_chars": lambda x: F.char_length(x).cast("long"), "strip": strip,
    "is_null": lambda x: x.isNull(), "is_not_null": lambda x: x.isNotNull(),
    "cast_float": lambda x: x.cast("double"), "cast_int": lambda x: x.cast("long"), "cast_str": lambda x: x.cast("string"),
    "year": lambda x: F.year(x).cast("long"), "month": lambda x: F.month(x).cast("long"), "day": lambda x: F.dayofmonth(x).cast("long"),
}
_TEXT = {"upper", "lower", "strip", "cast_str"}
_WHOLE = {"len_chars", "cast_int", "year", "month", "day"}
FUNCTIONS = sorted({*_ONE, "round", "contains", "fill_null", "date", "ts"})


class _Parser:
    def __init__(self, text: str, df: DataFrame) -> None:
        self.fields = {f.name: f.dataType for f in df.schema.fields}
        self.tokens, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def word(self, *words: str) -> str | None:
        kind, value = self.peek()
        low = value.lower()
        if (kind == "op" and value in words) or (kind == "id" and low in words):
            self.at += 1
            return low
        return None

    def need(self, word: str) -> None:
        if not self.word(word):
            raise ExpressionError(f"expected {word!r}, found {self.peek()[1]!r}")

    def parse(self) -> Value:
        out = self.either()
        if self.peek()[0] != "end":
            raise ExpressionError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self) -> Value:
        out = self.both()
        while self.word("or"):
            out = Value(out.column | self.both().column)
        return out

    def both(self) -> Value:
        out = self.negation()
        while self.word("and"):
            out = Value(out.column & self.negation().column)
        return out

    def negation(self) -> Value:
        return Value(~self.negation().column) if self.word("not") else self.comparison()

    def comparison(self) -> Value:
        a = self.sum()
        if op := self.word(">", "<", ">=", "<=", "==", "!="):
            x, y = a.column, self.sum().column
            return Value({">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y, "==": x == y, "!=": x != y}[op])
        return a

    def sum(self) -> Value:
        a = self.product()
        while op := self.word("+", "-"):
            b = self.product()
            if op == "+" and (a.text or b.text):
                a = Value(F.concat(a.column, b.column), text=True)
            else:
                a = Value(a.column + b.column if op == "+" else a.column - b.column, whole=a.whole and b.whole)
        return a

    def product(self) -> Value:
        a = self.power()
        while op := self.word("*", "/", "%"):
            b = self.power()
            c = {"*": lambda: a.column * b.column, "/": lambda: ieee_div(a.column, b.column), "%": lambda: floor_mod(a.column, b.column)}[op]()  # noqa: B023
            a = Value(c, whole=op != "/" and a.whole and b.whole)
        return a

    def power(self) -> Value:
        a = self.unary()
        if self.word("**"):
            b = self.unary()
            whole = a.whole and isinstance(b.literal, int) and b.literal >= 0
            p = F.pow(a.column, b.column)
            return Value(p.cast("long") if whole else p, whole=whole)
        return a

    def unary(self) -> Value:
        if self.word("-"):
            a = self.unary()
            return Value(-a.column, whole=a.whole, literal=-a.literal if isinstance(a.literal, (int, float)) else None)
        return self.atom()

    def atom(self) -> Value:
        kind, value = self.peek()
        self.at += 1
        if kind == "num":
            n = float(value) if "." in value else int(value)
            return Value(F.lit(n), whole=isinstance(n, int), literal=n)
        if kind == "str":
            return Value(F.lit(value[1:-1]), text=True, literal=value[1:-1])
        if kind == "op" and value == "(":
            out = self.either()
            self.need(")")
            return out
        if kind == "id" and self.word("("):
            return self.call(value)
        if kind == "id" and value.lower() in ("true", "false", "null") and value not in self.fields:
            return Value(F.lit({"true": True, "false": False, "null": None}[value.lower()]))
        if kind in ("id", "tick"):
            if value not in self.fields:
                raise ExpressionError(f"no column {value!r}; there are {', '.join(self.fields)}")
            t = self.fields[value]
            return Value(col(value), text=isinstance(t, T.StringType), whole=isinstance(t, T.IntegralType))
        raise ExpressionError(f"unexpected {value!r}" if value else "the expression ends too early")

    def call(self, f: str) -> Value:
        args = []
        if not self.word(")"):
            args.append(self.either())
            while self.word(","):
                args.append(self.either())
            self.need(")")
        if f in _ONE and len(args) == 1:
            return Value(_ONE[f](args[0].column), text=f in _TEXT, whole=f in _WHOLE)
        if f == "round" and len(args) in (1, 2):
            if len(args) == 2 and not isinstance(args[1].literal, int):
                raise ExpressionError("round takes a whole number of digits")
            return Value(F.round(args[0].column, args[1].literal if len(args) == 2 else 0))
        if f == "contains" and len(args) == 2:
            return Value(F.rlike(args[0].column, args[1].column))
        if f == "fill_null" and len(args) == 2:
            return Value(F.coalesce(args[0].column, args[1].column), text=args[0].text)
        if f == "date" and len(args) == 1:
            return Value(args[0].column.cast("date"))
        if f == "ts" and len(args) == 1:
            return Value(args[0].column.cast("timestamp_ntz"))
        raise ExpressionError(f"no function {f} of {len(args)} arguments; there are {', '.join(FUNCTIONS)}")


def expression(text: str, df: DataFrame) -> Column:
    """The Column that an expression over df's columns means."""
    return _Parser(text, df).parse().column


@dataclass(frozen=True)
class Formula:
    """y, and terms: each a tuple of column names whose product is a regressor."""

    y: str
    terms: tuple[tuple[str, ...], ...]

    @property
    def names(self) -> list[str]:
        return [":".join(t) for t in self.terms]


def formula(text: str) -> Formula:
    """Reads `y ~ a + b + a:b + c*d`; c*d stands for c + d + c:d. Repeated terms count once."""
    left, mark, right = text.partition("~")
    if not mark or not left.strip() or not right.strip():
        raise ExpressionError("a formula is: y ~ x1 + x2")
    terms: list[tuple[str, ...]] = []
    for part in right.split("+"):
        factors = [x.strip() for x in part.split("*")]
        if not all(factors):
            raise ExpressionError(f"an empty term in {text!r}")
        for size in range(1, len(factors) + 1):
            for chosen in itertools.combinations(factors, size):
                terms.append(tuple(x.strip() for c in chosen for x in c.split(":")))
    return Formula(left.strip(), tuple(dict.fromkeys(terms)))


def term_column(term: tuple[str, ...]) -> Column:
    """The product of a term's columns, in double."""
    out = col(term[0]).cast("double")
    for x in term[1:]:
        out = out * col(x).cast("double")
    return out
