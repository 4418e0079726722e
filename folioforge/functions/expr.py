"""A small arithmetic language compiled to Column expressions (or SQL text).

Numbers, names, ``pi``, ``+ - * / ^``, unary signs, parentheses and the
functions below; everything else is rejected when the text is read.  The result
is a plain expression tree, so Catalyst folds it and generates code for it; no
function of Python runs for a row.  A division by zero, or a function outside
its domain, gives null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """The text isn't an expression of this language."""


_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(\*\*|[-+*/^(),]))")
_ARITY = {"sin": 1, "cos": 1, "tan": 1, "asin": 1, "acos": 1, "atan": 1, "atan2": 2, "sqrt": 1, "abs": 1, "radians": 1, "degrees": 1, "inv": 1, "inv_inverse": 1, "min": 2, "max": 2, "fmod": 2}
_POWER = {"+": 10, "-": 10, "*": 20, "/": 20, "^": 40}


def parse(text: str) -> tuple:
    """The expression as nested tuples: ('num', x), ('name', n), ('neg', e), (op, a, b), ('call', f, args)."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ExpressionError(f"unexpected {text[at : at + 10]!r}")
        tokens.append(("num", m[1]) if m[1] else ("name", m[2]) if m[2] else ("op", "^" if m[3] == "**" else m[3]))
        at = m.end()
    place = 0

    def peek() -> tuple:
        return tokens[place] if place < len(tokens) else ("end", "")

    def take(value: str | None = None) -> tuple:
        nonlocal place
        t = peek()
        if t[0] == "end" or value is not None and t[1] != value:
            raise ExpressionError(f"expected {value or 'a value'}, found {t[1] or 'the end'}")
        place += 1
        return t

    def expression(power: int) -> tuple:
        kind, value = take()
        if kind == "num":
            left = ("num", float(value))
        elif kind == "name" and peek() == ("op", "("):
            if value not in _ARITY:
                raise ExpressionError(f"unknown function {value}")
            take("(")
            args = [expression(0)]
            while peek() == ("op", ","):
                take(",")
                args.append(expression(0))
            take(")")
            if len(args) != _ARITY[value]:
                raise ExpressionError(f"{value} takes {_ARITY[value]} values")
            left = ("call", value, tuple(args))
        elif kind == "name":
            left = ("pi",) if value == "pi" else ("name", value)
        elif value == "(":
            left = expression(0)
            take(")")
        elif value in "+-":
            inner = expression(30)
            left = ("neg", inner) if value == "-" else inner
        else:
            raise ExpressionError(f"unexpected {value!r}")
        while peek()[0] == "op" and _POWER.get(peek()[1], -1) > power:
            op = take()[1]
            left = (op, left, expression(_POWER[op] - (op == "^")))
        return left

    tree = expression(0)
    if peek()[0] != "end":
        raise ExpressionError(f"unexpected {peek()[1]!r}")
    return tree


def names(tree: tuple) -> set[str]:
    """Variables of an expression."""
    if tree[0] == "name":
        return {tree[1]}
    parts = tree[2] if tree[0] == "call" else tree[1:]
    return set().union(*(names(p) for p in parts if isinstance(p, tuple)))


def _guard(column: Column, ok: Column) -> Column:
    return F.when(ok, column)


def _inverse_involute(value: Column, rounds: int = 60) -> Column:
    """Bisection as a fold over a constant array: monotone, so each round halves the bracket."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.5707963267938966).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = F.tan(mid) - mid < value
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    return F.when(value >= 0, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: (s["lo"] + s["hi"]) / 2))


_COLUMNS: dict[str, Callable[..., Column]] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "atan": F.atan, "atan2": F.atan2, "abs": F.abs, "radians": F.radians, "degrees": F.degrees,
    "asin": lambda x: _guard(F.asin(x), F.abs(x) <= 1), "acos": lambda x: _guard(F.acos(x), F.abs(x) <= 1), "sqrt": lambda x: _guard(F.sqrt(x), x >= 0),
    "inv": lambda x: F.tan(x) - x, "inv_inverse": _inverse_involute, "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b), "fmod": lambda a, b: _guard(a % b, b != 0),
}


def compile_column(text: str, values: Mapping[str, Column] | None = None) -> Column:
    """The expression as a Column; names are looked up in ``values``, or are columns if that is None."""

    def build(t: tuple) -> Column:
        if t[0] == "num":
            return F.lit(t[1])
        if t[0] == "pi":
            return F.pi()
        if t[0] == "name":
            if values is None:
                return F.col(t[1]).cast("double")
            if t[1] not in values:
                raise ExpressionError(f"unknown variable {t[1]}")
            return values[t[1]]
        if t[0] == "neg":
            return -build(t[1])
        if t[0] == "call":
            return _COLUMNS[t[1]](*map(build, t[2]))
        a, b = build(t[1]), build(t[2])
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "^": lambda: F.pow(a, b)}[t[0]]()

    return build(parse(text))


def to_sql(text: str) -> str:
    """The expression as SQL text over columns of the same names (all but ``inv_inverse``)."""

    def build(t: tuple) -> str:
        if t[0] == "num":
            return f"{t[1]!r}::double"
        if t[0] == "pi":
            return "pi()"
        if t[0] == "name":
            return t[1]
        if t[0] == "neg":
            return f"(-{build(t[1])})"
        if t[0] == "call":
            args = [build(a) for a in t[2]]
            if t[1] in ("asin", "acos"):
                return f"case when abs({args[0]}) <= 1 then {t[1]}({args[0]}) end"
            if t[1] == "sqrt":
                return f"case when {args[0]} >= 0 then sqrt({args[0]}) end"
            if t[1] == "inv":
                return f"(tan({args[0]}) - {args[0]})"
            return f"{ {'min': 'least', 'max': 'greatest'}.get(t[1], t[1])}({', '.join(args)})"
        a, b = build(t[1]), build(t[2])
        return f"pow({a}, {b})" if t[0] == "^" else f"({a} / nullif({b}, 0))" if t[0] == "/" else f"({a} {t[0]} {b})"

    return build(parse(text))


def variables_known(text: str, known: set[str]) -> Iterator[str]:
    """Variables an expression uses that aren't declared."""
    return iter(sorted(names(parse(text)) - known))
