"""Field conditions as Spark predicates: ranges, comparisons, membership, and a small expression language."""

from __future__ import annotations

import functools
import math
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import globs, values

OPS = ("<", "<=", ">", ">=", "==", "!=")


def _bound(text: str) -> tuple[values.Value, bool]:
    """(value, whether the bound itself is out)."""
    t = str(text)
    out = t.startswith("(")
    t = t[1:] if out else t
    v = values.parse(t)
    return v, out


def in_range(name: str, lo, hi) -> Column:
    """lo <= field <= hi; a bound that starts with `(` is out itself; +inf and -inf are open ends."""
    (a, a_out), (b, b_out) = _bound(lo), _bound(hi)
    low, high = a.column(), b.column()

    def test(v: Column) -> Column:
        least = values.less(low, v) if a_out else ~values.less(v, low)
        return least & (values.less(v, high) if b_out else ~values.less(high, v))

    return values.tested(name, test)


def compare(name: str, op: str, value) -> Column:
    if op not in OPS:
        raise ValueError(f"invalid operator {op!r}")
    x = values.parse(str(value)).column()
    test = {
        "<": lambda v: values.less(v, x),
        "<=": lambda v: ~values.less(x, v),
        ">": lambda v: values.less(x, v),
        ">=": lambda v: ~values.less(v, x),
        "==": lambda v: values.equal(v, x),
        "!=": lambda v: ~values.equal(v, x),
    }[op]
    return values.tested(name, test)


def member(name: str, options: list) -> Column:
    """Equal to one of the options, each typed by itself."""
    known = [values.parse(str(x)).column() for x in options]
    return values.tested(name, lambda v: functools.reduce(operator.or_, [values.equal(v, x) for x in known], F.lit(False)))


# Expressions.

_TOKEN = re.compile(
    r"""\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")"""
    r"""|(?P<op>\|\||&&|===|!==|==|!=|<=|>=|=~|[-+*/%<>!().,])|(?P<id>[A-Za-z_$][A-Za-z0-9_$]*))"""
)


@dataclass
class _X:
    """An expression's column and its type: num, str, bool, or val for a typed value."""

    kind: str
    col: Column

    def num(self) -> Column:
        if self.kind == "num":
            return self.col
        if self.kind == "bool":
            return F.when(self.col, 1.0).otherwise(0.0)
        if self.kind == "str":
            return F.coalesce(self.col.try_cast("double"), F.lit(math.nan))
        k, v = self.col["kind"], self.col
        text = F.coalesce(v["data"].try_cast("double"), F.lit(math.nan))
        return F.when(k == values.NUMBER, v["num"]).when(k == values.TRUE, 1.0).when(k < values.NUMBER, 0.0).otherwise(text)

    def text(self) -> Column:
        if self.kind == "str":
            return self.col
        if self.kind == "num":
            return F.regexp_replace(self.col.cast("string"), r"\.0$", "")
        return self.col.cast("string") if self.kind == "bool" else self.col["data"]

    def true(self) -> Column:
        if self.kind == "bool":
            return F.coalesce(self.col, F.lit(False))
        if self.kind == "num":
            return (self.col != 0) & ~F.isnan(self.col)
        if self.kind == "str":
            return self.col != ""
        k, v = self.col["kind"], self.col
        number = (v["num"] != 0) & ~F.isnan(v["num"])
        return F.when(k == values.NUMBER, number).when(k == values.STRING, v["data"] != "").otherwise(k >= values.TRUE)

    def is_text(self) -> Column:
        return F.lit(self.kind == "str") if self.kind != "val" else self.col["kind"].isin(values.STRING, values.JSON)


class Expression:
    """A parsed expression. `||`, `&&`, comparisons, `=~`, arithmetic, `!`, parentheses, `.match(glob)`.

    Names are fields, members of the object, `id`, `type` or `this`; a missing one is 0. Texts compare without case.
    """

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"invalid expression at {at}: {text!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def column(self) -> Column:
        self.at = 0
        out = self._or()
        if self.at != len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return F.coalesce(out.true(), F.lit(False))

    def _peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else None

    def _take(self, *ops: str) -> str | None:
        op = self._peek()
        if op in ops:
            self.at += 1
            return op
        return None

    def _or(self) -> _X:
        left = self._and()
        while self._take("||"):
            left = _X("bool", left.true() | self._and().true())
        return left

    def _and(self) -> _X:
        left = self._equal()
        while self._take("&&"):
            left = _X("bool", left.true() & self._equal().true())
        return left

    def _equal(self) -> _X:
        left = self._order()
        while op := self._take("==", "!=", "===", "!==", "=~"):
            right = self._order()
            if op == "=~":
                left = _X("bool", self._regex(left, right))
            else:
                same = F.when(left.is_text() & right.is_text(), values.folded(left.text()) == values.folded(right.text()))
                same = same.otherwise(left.num() == right.num())
                left = _X("bool", same if op.startswith("=") else ~same)
        return left

    def _regex(self, left: _X, right: _X) -> Column:
        """A pattern that doesn't compile matches nothing."""
        kind, token = self.tokens[self.at - 1]
        if kind != "str":
            raise ValueError("a pattern must be a string")
        pattern = _unquote(token)
        try:
            re.compile(pattern)
        except re.error:
            return F.lit(False)
        return left.text().rlike(pattern)

    def _order(self) -> _X:
        left = self._sum()
        while op := self._take("<", "<=", ">", ">="):
            right = self._sum()
            texts = left.is_text() & right.is_text()
            a, b, x, y = values.folded(left.text()), values.folded(right.text()), left.num(), right.num()
            real = ~F.isnan(x) & ~F.isnan(y)
            pairs = {"<": (a < b, x < y), "<=": (a <= b, x <= y), ">": (a > b, x > y), ">=": (a >= b, x >= y)}[op]
            left = _X("bool", F.when(texts, pairs[0]).otherwise(pairs[1] & real))
        return left

    def _sum(self) -> _X:
        left = self._product()
        while op := self._take("+", "-"):
            right = self._product()
            left = _X("num", left.num() + right.num() if op == "+" else left.num() - right.num())
        return left

    def _product(self) -> _X:
        left = self._unary()
        while op := self._take("*", "/", "%"):
            a, b = left.num(), self._unary().num()
            left = _X("num", a * b if op == "*" else F.coalesce(F.try_divide(a, b) if op == "/" else F.try_mod(a, b), F.lit(math.nan)))
        return left

    def _unary(self) -> _X:
        if self._take("!"):
            return _X("bool", ~self._unary().true())
        if self._take("-"):
            return _X("num", -self._unary().num())
        return self._atom()

    def _atom(self) -> _X:
        if self.at >= len(self.tokens):
            raise ValueError(f"unexpected end of {self.text!r}")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return _X("num", F.lit(float(token)))
        if kind == "str":
            out = _X("str", F.lit(_unquote(token)))
        elif token == "(":
            out = self._or()
            if not self._take(")"):
                raise ValueError(f"missing ) in {self.text!r}")
        elif kind == "id":
            if token in ("true", "false"):
                return _X("bool", F.lit(token == "true"))
            if token == "null":
                return _X("val", values.Value(values.NULL, 0.0, "null").column())
            return self._name(token)
        else:
            raise ValueError(f"unexpected {token!r} in {self.text!r}")
        return self._method(out)

    def _name(self, first: str) -> _X:
        path = [first]
        while self._peek() == "." and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][0] in ("id", "num"):
            if self.tokens[self.at + 1][1] == "match" and self.at + 2 < len(self.tokens) and self.tokens[self.at + 2][1] == "(":
                break
            path.append(self.tokens[self.at + 1][1])
            self.at += 2
        if path[0] == "this" and len(path) > 1:
            path = path[1:]
        if path == ["id"]:
            out = _X("str", F.col("id"))
        elif path == ["type"]:
            out = _X("str", F.coalesce(F.col("gtype"), F.lit("String")))
        elif path[0] in ("properties", "z"):
            out = _X("val", values.field(".".join(path)))
        else:
            out = _X("val", values.field(".".join(path)))
        return self._method(out)

    def _method(self, x: _X) -> _X:
        while self._peek() == "." and self.at + 2 < len(self.tokens) and self.tokens[self.at + 1][1] == "match":
            self.at += 2
            if not self._take("("):
                raise ValueError("match needs arguments")
            kind, token = self.tokens[self.at]
            if kind != "str":
                raise ValueError("match needs a string")
            self.at += 1
            if not self._take(")"):
                raise ValueError("missing )")
            x = _X("bool", globs.matches(x.text(), _unquote(token), nocase=True))
        return x


def _unquote(token: str) -> str:
    return re.sub(r"\\(.)", r"\1", token[1:-1])


def expression(text: str) -> Column:
    return Expression(text).column()
