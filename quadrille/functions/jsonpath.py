"""Reading, writing and deleting inside JSON texts by dotted paths: `a.b.0`, and `a.-1` to append."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.session import ship

_NUMBER = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")




def _load(text: str):
    return json.loads(text, parse_float=lambda t: _Number(t), parse_int=lambda t: _Number(t))


class _Number(float):
    """Keeps its own spelling when written again."""

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.text = text
        return self


def dump(x) -> str:
    """Compact JSON; numbers as they were spelled."""
    if isinstance(x, _Number):
        return x.text
    if isinstance(x, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + dump(v) for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(dump(v) for v in x) + "]"
    return json.dumps(x, ensure_ascii=False)


def _value(text: str, kind: str | None):
    """A value to write: raw JSON, or a number if it is spelled as JSON has them, else a string."""
    if kind == "raw":
        return _load(text)
    if kind != "str":
        if _NUMBER.fullmatch(text):
            return _Number(text)
        if text in ("true", "false", "null"):
            return json.loads(text)
    return text


def get(text: str, path: str = "", raw: bool = False) -> str | None:
    """What stands at the path, strings without quotes unless raw; None if nothing does."""
    x = _load(text)
    for step in path.split(".") if path else []:
        if isinstance(x, dict) and step in x:
            x = x[step]
        elif isinstance(x, list) and step == "#":
            x = _Number(str(len(x)))
        elif isinstance(x, list) and step.isdigit() and int(step) < len(x):
            x = x[int(step)]
        else:
            return None
    return x if isinstance(x, str) and not raw else dump(x)


def put(text: str | None, path: str, value: str, kind: str | None = None) -> str:
    """The text with a value at the path; missing parents are made, arrays grow with nulls."""
    root = _load(text) if text else {}
    new, steps = _value(value, kind), path.split(".")
    if not isinstance(root, (dict, list)):
        root = {}
    x = root
    for i, step in enumerate(steps):
        last = i == len(steps) - 1
        fresh = new if last else ([] if steps[i + 1] == "-1" or steps[i + 1].isdigit() else {})
        if isinstance(x, list):
            at = len(x) if step == "-1" else int(step)
            x.extend([None] * (at - len(x)))
            if at == len(x):
                x.append(fresh)
            elif last or not isinstance(x[at], (dict, list)):
                x[at] = fresh
            x = x[at]
        else:
            if last or not isinstance(x.get(step), (dict, list)):
                x[step] = fresh
            x = x[step]
    return dump(root)


def remove(text: str, path: str) -> tuple[str, int]:
    """(text without what stands at the path, how many were removed)."""
    root, steps = _load(text), path.split(".")
    x = root
    for step in steps[:-1]:
        if isinstance(x, dict) and step in x:
            x = x[step]
        elif isinstance(x, list) and step.isdigit() and int(step) < len(x):
            x = x[int(step)]
        else:
            return text, 0
    last = steps[-1]
    if isinstance(x, dict) and last in x:
        del x[last]
    elif isinstance(x, list) and (last == "-1" or last.isdigit()) and x and int(last) < len(x):
        del x[int(last)]
    else:
        return text, 0
    return dump(root), 1


# Columns.


def get_column(text: Column, path: str) -> Column:
    """JSON reads stay in Spark: dots become a JSON path."""
    steps = "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in path.split(".")) if path else ""
    return F.get_json_object(text, "$" + steps)


def put_column(text: Column, path: str, value: str, kind: str | None = None) -> Column:
    ship()

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: put(x, path, value, kind))

    return run(text)


def remove_column(text: Column, path: str) -> Column:
    ship()

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else remove(x, path)[0])

    return run(text)
