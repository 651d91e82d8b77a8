"""Typed field values: struct(kind, num, data). Kinds order Null < False < Number < String < True < JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bound

NULL, FALSE, NUMBER, STRING, TRUE, JSON = range(6)
TYPE = "struct<kind:int,num:double,data:string>"
FIELDS = f"map<string,{TYPE}>"

#: How anything but a plain string begins.
_MAYBE = r'^[-+0-9nNiItf{\["]'
_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
#: Spellings of numbers that JSON doesn't have.
_ODD = {"nan": "NaN", "+nan": "NaN", "-nan": "NaN", "inf": "+Inf", "+inf": "+Inf", "infinity": "+Inf", "+infinity": "+Inf", "-inf": "-Inf", "-infinity": "-Inf"}
_FLOAT = {"NaN": math.nan, "+Inf": math.inf, "-Inf": -math.inf}


@dataclass(frozen=True)
class Value:
    kind: int
    num: float
    data: str

    def column(self) -> Column:
        num = F.lit(float(self.num))
        return F.struct(F.lit(self.kind).alias("kind"), num.alias("num"), F.lit(self.data).alias("data"))


ZERO = Value(NUMBER, 0.0, "0")


def parse(text: str) -> Value:
    """The value that a raw field text stands for. Numbers must be JSON numbers: `000123` is a string."""
    t = text.strip()
    if t.lower() in _ODD:
        odd = _ODD[t.lower()]
        return Value(NUMBER, _FLOAT[odd], odd)
    if re.match(_NUMBER, t):
        num = float(t)
        return Value(NUMBER, num, t if math.isfinite(num) else ("+Inf" if num > 0 else "-Inf"))
    if t in ("null", "true", "false"):
        return {"null": Value(NULL, 0.0, t), "true": Value(TRUE, 0.0, t), "false": Value(FALSE, 0.0, t)}[t]
    if t[:1] in "{[\"" and t:
        try:
            x = json.loads(t)
        except ValueError:
            return Value(STRING, 0.0, t)
        if isinstance(x, str):
            return Value(STRING, 0.0, x)
        return Value(JSON, 0.0, json.dumps(x, separators=(",", ":"), ensure_ascii=False))
    return Value(STRING, 0.0, t)


def _make(kind, num, data) -> Column:
    cast = (("kind", kind, "int"), ("num", num, "double"), ("data", data, "string"))
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast(t).alias(n) for n, x, t in cast])


def typed(text: Column) -> Column:
    """`parse` for a column; a null text is the zero that a missing field reads as."""
    t = F.trim(text)
    low = F.lower(t)
    odd = F.create_map(*[F.lit(x) for kv in _ODD.items() for x in kv])[low]
    num = F.when(odd == "NaN", float("nan")).when(odd == "+Inf", math.inf).when(odd == "-Inf", -math.inf)
    is_json = t.rlike(r"(?s)^[\[{].*") & F.get_json_object(t, "$").isNotNull()
    quoted = F.when(t.rlike('(?s)^".*"$'), F.get_json_object(F.concat(F.lit('{"a":'), t, F.lit("}")), "$.a"))
    return (
        F.when(t.isNull(), ZERO.column())
        .when(~t.rlike(_MAYBE), _make(STRING, 0.0, t))
        .when(odd.isNotNull(), _make(NUMBER, num, odd))
        .when(t.rlike(_NUMBER), _make(NUMBER, t.try_cast("double"), t))
        .when(t == "null", _make(NULL, 0.0, t))
        .when(t == "true", _make(TRUE, 0.0, t))
        .when(t == "false", _make(FALSE, 0.0, t))
        .when(is_json, _make(JSON, 0.0, F.get_json_object(t, "$")))
        .when(quoted.isNotNull(), _make(STRING, 0.0, quoted))
        .otherwise(_make(STRING, 0.0, t))
    )


def number(x: Column) -> Column:
    """A number's value; null is the zero that a missing field reads as."""
    x = F.coalesce(x.cast("double"), F.lit(0.0))
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    text = F.when(whole, x.cast("long").cast("string")).when(F.isnan(x), "NaN").when(F.abs(x) == math.inf, F.when(x > 0, "+Inf").otherwise("-Inf"))
    return _make(NUMBER, x, text.otherwise(x.cast("string")))


def folded(text: Column) -> Column:
    """A-Z in lower case; no other letter is touched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def less(a: Column, b: Column) -> Column:
    """a before b. Strings compare without ASCII case; a NaN is before nothing and after nothing."""
    nums = (a["num"] < b["num"]) & ~F.isnan(a["num"]) & ~F.isnan(b["num"])
    return (
        F.when(a["kind"] != b["kind"], a["kind"] < b["kind"])
        .when(a["kind"] == NUMBER, nums)
        .when(a["kind"] == STRING, folded(a["data"]) < folded(b["data"]))
        .otherwise(a["data"] < b["data"])
    )


def equal(a: Column, b: Column) -> Column:
    """Neither before the other; so NaN equals every number."""
    return ~less(a, b) & ~less(b, a)


def is_zero(v: Column) -> Column:
    return (v["kind"] == NUMBER) & (v["num"] == 0)


def field_map(pairs: dict[str, Column], numeric: frozenset[str] | set[str] = frozenset()) -> Column:
    """A fields column from raw texts, or for names in `numeric` from number columns; fields that are zero are not stored."""
    full = F.create_map(*[x for name, v in pairs.items() for x in (F.lit(name), number(v) if name in numeric else typed(v.cast("string")))])
    return F.map_filter(full, lambda _, v: ~is_zero(v))


def merge(old: Column, new: Column) -> Column:
    """Fields after a write: new ones replace old ones, zeros delete."""
    none = F.create_map().cast(FIELDS)
    kept = F.map_filter(F.coalesce(old, none), lambda k, _: ~F.map_contains_key(F.coalesce(new, none), k))
    return F.map_filter(F.map_concat(kept, F.coalesce(new, none)), lambda _, v: ~is_zero(v))


def field(name: str, fields: Column | None = None) -> Column:
    """A field's value, zero if missing; `a.b` descends into a JSON field a; `z` and `properties.x` read the geometry."""
    fields = F.col("fields") if fields is None else fields
    if name == "z":
        return number(F.coalesce(F.col("z"), F.lit(0.0)))
    head, _, path = name.partition(".")
    if head == "properties":
        return bound(F.get_json_object(F.col("properties"), "$." + path if path else "$"), typed)
    own = fields[name]
    if not path:
        return F.coalesce(own, ZERO.column())
    inner = F.get_json_object(F.when(fields[head]["kind"] == JSON, fields[head]["data"]), "$." + path)
    return F.coalesce(own, bound(inner, lambda t: F.when(t.isNotNull(), typed(t))), ZERO.column())


def field_exact(name: str) -> Column:
    """A stored field's value, zero if missing, without descending."""
    return F.coalesce(F.col("fields")[name], ZERO.column())


def tested(name: str, test: Callable[[Column], Column]) -> Column:
    """test(field). A stored field is looked up where it is used, in generated code; a path into JSON is read once."""
    return bound(field(name), test) if "." in name else test(field(name))


def to_json(v: Column) -> Column:
    """A value as JSON text; infinities and NaN are strings there."""
    quoted = F.concat(F.lit('"'), v["data"], F.lit('"'))
    escaped = F.regexp_extract(F.to_json(F.struct(v["data"].alias("a"))), r"(?s)^\{\"a\":(.*)\}$", 1)
    odd = (v["kind"] == NUMBER) & v["data"].isin("NaN", "+Inf", "-Inf")
    return F.when(odd, quoted).when(v["kind"] == STRING, escaped).otherwise(v["data"])
