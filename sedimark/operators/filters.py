"""Filter expressions of a search, such as ``source eq 'a''b' and (page ge 3 or not deleted)``, as column conditions.

A filter becomes one Spark condition, so what a source can take of it is pushed down to
its scan. Names have to be columns of the table that is searched, and values
literals; nothing of a filter's text reaches Spark as SQL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^']|'')*')|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(?P<word>[A-Za-z_][\w./]*)|(?P<mark>[(),]))")
#: Comparisons of two values.
_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
_CONSTANTS = {"true": True, "false": False, "null": None}


class FilterError(ValueError):
    """A filter that can't be read, with the place where reading stopped."""


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"not understood at {at}: {text[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str, columns: Iterable[str]) -> None:
        self.tokens, self.at, self.end = _tokens(text), 0, len(text)
        self.columns = set(columns)

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "", self.end)

    def take(self, *values: str) -> bool:
        """Step over the next token if it is one of ``values``."""
        kind, value, _ = self.peek()
        if kind in ("word", "mark") and value in values:
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            self.stop(f"{value!r} expected")

    def stop(self, why: str):
        kind, value, at = self.peek()
        raise FilterError(f"{why} at {at}" + (f", not {value!r}" if kind != "end" else ", where the filter ends"))

    def either(self) -> Column:
        left = self.both()
        while self.take("or"):
            left = left | self.both()
        return left

    def both(self) -> Column:
        left = self.negated()
        while self.take("and"):
            left = left & self.negated()
        return left

    def negated(self) -> Column:
        if self.take("not"):
            # what is null is not true, and its negation holds
            return ~F.coalesce(self.negated(), F.lit(False))
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        return self.condition()

    def condition(self) -> Column:
        name = self.field()
        kind, value, _ = self.peek()
        if kind == "word" and value in _COMPARE:
            self.at += 1
            other = self.literal()
            if other is None:
                if value not in ("eq", "ne"):
                    raise FilterError(f"null has no order: {value}")
                return name.isNull() if value == "eq" else name.isNotNull()
            # null differs from every value
            return ~name.eqNullSafe(F.lit(other)) if value == "ne" else _COMPARE[value](name, F.lit(other))
        if self.take("in"):
            self.need("(")
            values = [self.literal()]
            while self.take(","):
                values.append(self.literal())
            self.need(")")
            known = name.isin([v for v in values if v is not None])
            return known | name.isNull() if None in values else known
        return name.eqNullSafe(F.lit(True))

    def field(self) -> Column:
        kind, value, _ = self.peek()
        if kind != "word" or value in _CONSTANTS or value in _COMPARE or value in ("and", "or", "not", "in"):
            self.stop("a field expected")
        if value.split("/")[0] not in self.columns:
            raise FilterError(f"no field is called {value!r}")
        self.at += 1
        first, *inner = value.split("/")
        out = F.col(f"`{first}`")
        for part in inner:
            out = out.getField(part)
        return out

    def literal(self):
        kind, value, _ = self.peek()
        if kind == "string":
            out = value[1:-1].replace("''", "'")
        elif kind == "number":
            out = float(value) if any(c in value for c in ".eE") else int(value)
        elif kind == "word" and value in _CONSTANTS:
            out = _CONSTANTS[value]
        else:
            self.stop("a value expected")
        self.at += 1
        return out


def condition(text: str | None, columns: Iterable[str]) -> Column:
    """The condition that the filter ``text`` states over ``columns``; true for none or a blank one.

    ``not`` binds closest, then ``and``, then ``or``; comparisons are eq, ne, gt, ge, lt, le and
    ``in ('a', 'b')``; strings are in single quotes, doubled inside; ``a/b`` is a field of
    a structure; a field alone stands for its being true.
    """
    if not (text or "").strip():
        return F.lit(True)
    reader = _Reader(text, columns)
    out = reader.either()
    if reader.peek()[0] != "end":
        reader.stop("'and' or 'or' expected")
    return out
