"""Shell globs as Spark predicates: `*`, `?`, `[a-z]`, `[^x]`, `\\c`; `*` crosses every character."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = "*?["


class BadPattern(ValueError):
    """A glob that ends inside a class or an escape."""


def prefix(pattern: str) -> str:
    """The literal text that every match begins with."""
    out, i = "", 0
    while i < len(pattern) and pattern[i] not in _SPECIAL:
        if pattern[i] == "\\":
            i += 1
            if i == len(pattern):
                raise BadPattern(pattern)
        out += pattern[i]
        i += 1
    return out


def is_literal(pattern: str) -> bool:
    return not any(c in pattern for c in _SPECIAL + "\\")


def to_regex(pattern: str) -> str:
    """An anchored regular expression, valid in Java and Python; `(?s)` lets `.` match line ends."""
    out, i = "(?s)^", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "\\":
            i += 1
            if i == len(pattern):
                raise BadPattern(pattern)
            out += re.escape(pattern[i])
        elif c == "[":
            i += 1
            inner = "["
            if i < len(pattern) and pattern[i] in "^!":
                inner, i = "[^", i + 1
            first = True
            while True:
                if i >= len(pattern):
                    raise BadPattern(pattern)
                c = pattern[i]
                if c == "]" and not first:
                    break
                if c == "\\":
                    i += 1
                    if i >= len(pattern):
                        raise BadPattern(pattern)
                    c = pattern[i]
                    inner += re.escape(c)
                elif c == "-" and not first:
                    inner += "-"
                else:
                    inner += re.escape(c)
                first = False
                i += 1
            out += inner + "]"
        else:
            out += re.escape(c)
        i += 1
    # Not `$`, which also matches before a last line end.
    return out + "(?!.)"


def match(pattern: str, text: str) -> bool:
    return re.match(to_regex(pattern), text) is not None


def matches(column: Column, pattern: str, nocase: bool = False) -> Column:
    """Whether the column matches. A literal prefix becomes a `startswith`, which reaches the file scan."""
    if nocase:
        return F.lower(column).rlike(to_regex(pattern.lower()))
    if pattern == "*":
        return column.isNotNull()
    if is_literal(pattern):
        return column == pattern
    if pattern.endswith("*") and is_literal(pattern[:-1]):
        return column.startswith(pattern[:-1])
    start = prefix(pattern)
    full = column.rlike(to_regex(pattern))
    return column.startswith(start) & full if start else full


def any_match(column: Column, patterns: list[str]) -> Column:
    """Several globs are alternatives; none means all."""
    if not patterns:
        return F.lit(True)
    return functools.reduce(operator.or_, [matches(column, p) for p in patterns])
