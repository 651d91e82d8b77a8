"""Command logs as change tables: files of commands as arrays of length-prefixed words, or rows of command words.

A log's tail may be torn and zero bytes may stand between commands; what a command means for the current objects is a
change row, which `operators.kv.fold` turns into a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, geometry, globs, values
from ..operators.kv import CHANGE, CHANGE_NAMES
from ..plans.session import ship
from .objects import GEOMETRY_NAMES, geometry_row


class BadLog(ValueError):
    """Bytes inside a log that are no command, or a command that no log holds."""


#: Commands that a log may hold and that change no object: hooks and channels, scripts' loading, and reads.
NO_CHANGE = frozenset(
    "sethook setchan delhook delchan pdelhook pdelchan publish get fget exists fexists scan search nearby within intersects test bounds stats "
    "keys ttl type jget hooks chans server info ping echo timeout output auth config readonly gc script aof aofmd5 aofshrink healthz".split()
)


def write(commands: list[list[str]]) -> bytes:
    """Commands in the log's form."""
    out = b""
    for args in commands:
        out += b"*%d\r\n" % len(args)
        for a in args:
            raw = str(a).encode()
            out += b"$%d\r\n%s\r\n" % (len(raw), raw)
    return out


def read(data: bytes) -> Iterator[list[str]]:
    """The commands of a log; a torn last one is left out, zero bytes between commands are skipped."""
    at = 0

    def number(mark: bytes) -> int | None:
        nonlocal at
        if data[at : at + 1] != mark:
            if at >= len(data):
                return None
            raise BadLog(f"unexpected byte {data[at : at + 1]!r} at {at}")
        end = data.find(b"\r\n", at)
        if end < 0:
            return None
        n, at = int(data[at + 1 : end]), end + 2
        return n

    while True:
        while at < len(data) and data[at] == 0:
            at += 1
        n = number(b"*") if at < len(data) else None
        if n is None:
            return
        words = []
        for _ in range(n):
            size = number(b"$")
            if size is None or at + size + 2 > len(data):
                return
            words.append(data[at : at + size].decode("utf-8", "replace"))
            at += size + 2
        yield words


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(seq, args) of all log files under a path, a file a task; seq orders files by name, then commands."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(read(bytes(content)))
                yield pd.DataFrame({"path": name, "n": range(len(rows)), "args": rows})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(run, "path string, n long, args array<string>")
    order = files.select("path").distinct()
    order = order.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("file"))  # one row a file
    return rows.join(F.broadcast(order), "path").select((F.col("file") * (1 << 40) + F.col("n")).alias("seq"), "args")


def change(args: list[str]) -> dict | None:
    """The change row of one command, without seq and ts; None for commands that change no object, BadLog for unknown ones."""
    words = [str(a) for a in args]
    name = words[0].lower() if words else ""
    row: dict = dict.fromkeys(CHANGE_NAMES) | {"command": name}
    if name == "flushdb":
        return row
    if name in ("jset", "jdel"):
        row |= {"key": words[1], "id": words[2], "pattern": words[3]}
        if name == "jset":
            row |= {"value": words[4], "new_key": words[5].lower() if len(words) > 5 else None}
        return row
    if name in ("drop", "pdel", "del", "persist", "expire", "rename", "renamenx"):
        row["key"] = words[1]
        if name == "pdel":
            row["pattern"] = globs.to_regex(words[2])
        elif name in ("rename", "renamenx"):
            row["new_key"] = words[2]
        elif name != "drop":
            row["id"] = words[2]
        if name == "expire":
            row["ex_seconds"] = float(words[3])
        return row
    if name in NO_CHANGE or not name:
        return None
    if name not in ("set", "fset"):
        raise BadLog(f"unknown command {words[0]!r}")
    row["key"], row["id"], fields, i = words[1], words[2], {}, 3
    if name == "fset":
        rest = words[3:]
        rest = rest[1:] if rest and rest[0].lower() == "xx" else rest
        fields = dict(zip(rest[::2], rest[1::2], strict=True))
    while name == "set" and i < len(words):
        o = words[i].lower()
        if o == "field":
            fields[words[i + 1]] = words[i + 2]
            i += 3
        elif o == "ex":
            row["ex_seconds"] = float(words[i + 1])
            i += 2
        elif o in ("nx", "xx"):
            i += 1
        else:
            break
    row["fields"] = {k: {"kind": v.kind, "num": v.num, "data": v.data} for k, v in ((k, values.parse(t)) for k, t in fields.items())}
    if name == "set":
        row |= _geometry(words[i].lower(), words[i + 1 :])
    return row


def _geometry(kind: str, rest: list[str]) -> dict:
    short = lambda t: int(float(t)) if float(t) == int(float(t)) else float(t)
    if kind == "string":
        return {"kind": "string", "value": rest[0], "npoints": 0}
    if kind == "point":
        g = {"type": "Point", "coordinates": [short(rest[1]), short(rest[0]), *(short(z) for z in rest[2:3])]}
    elif kind == "bounds":
        a, b, c, d = (short(t) for t in rest)
        g = geometry.rect(b, a, d, c)
    elif kind == "hash":
        lat, lon = geo.geohash_center(rest[0])
        g = {"type": "Point", "coordinates": [lon, lat]}
    elif kind == "object":
        g = geometry.load(rest[0])
    else:
        raise BadLog(f"unknown geometry {kind!r}")
    row = dict(zip(GEOMETRY_NAMES, geometry_row(g), strict=True))
    return row | {"kind": "rect"} if kind == "bounds" else row


def changes(commands: DataFrame) -> DataFrame:
    """Change rows of a table (seq, args[, ts]); commands that change no object fall out."""
    ship(commands.sparkSession)
    ts = F.col("ts") if "ts" in commands.columns else F.current_timestamp()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for seq, at, args in zip(pdf["seq"], pdf["ts"], pdf["args"], strict=True):
                row = change(list(args))
                if row is not None:
                    out.append(row | {"seq": seq, "ts": at})
            yield pd.DataFrame(out, columns=CHANGE_NAMES)

    return commands.select("seq", ts.alias("ts"), "args").mapInPandas(run, CHANGE)
