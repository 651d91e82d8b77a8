"""Geofences on a stream of changes: the same rules as the batch form, with an object's last version as state."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geometry, globs
from ..operators.fences import Fence, in_area
from ..operators.search import condition
from ..plans.session import ship

SCHEMA = (
    "seq long, ts timestamp, hook string, key string, id string, command string, rank int, detect string, lat double, "
    "lon double, geojson string, `group` string"
)


def detect(old: bool, new: bool, command: str, passes: bool, crossed: bool) -> str | None:
    """`operators.fences.detection` for one change; the tests hold the two against each other."""
    fset = command == "fset"
    if old and new:
        return "inside"
    if old:
        return "exit"
    if new:
        return "inside" if fset else "enter"
    if not fset and not passes:
        return None
    return "cross" if crossed and not fset else "outside"


def requested(found: str | None, names: list[str] | None) -> list[str]:
    """`operators.fences.requested` for one detection."""
    if found is None:
        return []
    wanted = lambda d: names is None or d in names
    second = {"enter": "inside", "exit": "outside", "cross": "outside"}.get(found)
    if not wanted(found):
        return [second] if second and wanted(second) else []
    return [found] + [second] * bool(second and wanted(second))


class _Machine:
    """Per object: the last version's place and, for each fence, whether it was in and passed, and the group."""

    def __init__(self, fences: list[Fence], saved: str | None):
        self.fences, self.state = fences, json.loads(saved) if saved else {"f": {}, "at": None}

    def change(self, row: dict) -> list[tuple]:
        out, command = [], row["command"]
        spot = (row["x"], row["y"]) if row["x"] is not None and row["x"] == row["x"] else None
        flags = {f["hook"]: f for f in row["flags"]}
        for f in self.fences:
            if f.key != row["key"] or (command != "drop" and not _any(f.match, row["id"])):
                continue
            own = self.state["f"].setdefault(f.name, {"in": False, "pass": False, "group": -1})
            now = flags.get(f.name, {"inside": False, "passes": False})
            is_set = command == "set"
            inside, passes = bool(now["inside"]), bool(now["passes"])
            if command in ("del", "drop"):
                found, names = None, [None]
            else:
                old = is_set and own["in"] and own["pass"]
                blocked = (is_set and own["in"] and not own["pass"]) or (inside and not passes)
                crossed = False
                if is_set and self.state["at"] and spot and not blocked and not inside and not own["in"]:
                    crossed = geometry.intersects([("L", [tuple(self.state["at"]), spot])], f.area.parts)
                found = detect(old, inside and passes, command, passes, crossed)
                names = requested(found, f.detect)
            if found in ("enter", "cross"):
                own["group"] = row["seq"]
            allowed = f.commands is None or command in f.commands
            if allowed and not (f.nofields and command == "fset"):
                group = hashlib.sha1(f"{f.name}|{row['key']}|{row['id']}|{own['group']}".encode()).hexdigest()
                out += [
                    (row["seq"], row["ts"], f.name, row["key"], row["id"], command, i, d, row["y"], row["x"], row["geojson"], group)
                    for i, d in enumerate(names)
                ]
            own["in"], own["pass"] = (False, False) if command in ("del", "drop") else (inside, passes)
        self.state["at"] = None if command in ("del", "drop") else spot
        return out

    def saved(self) -> str:
        return json.dumps(self.state)


def _any(patterns: list[str], text: str) -> bool:
    return not patterns or any(globs.match(p, text) for p in patterns)


def _step(fences: list[Fence]):
    columns = [c.split()[0].strip("`") for c in SCHEMA.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = _Machine(fences, state.get[0] if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = [e for row in rows.to_dict("records") for e in machine.change(row)]
        state.update((machine.saved(),))
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def _replay(fences: list[Fence]):
    columns = [c.split()[0].strip("`") for c in SCHEMA.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        machine = _Machine(fences, None)
        return pd.DataFrame([e for row in rows.sort_values("seq").to_dict("records") for e in machine.change(row)], columns=columns)

    return run


def stream_events(changes: DataFrame, fences: list[Fence], points_only: bool = False) -> DataFrame:
    """Events of a streaming change log; a batch one is replayed, an object's changes at a time.

    Whether a version is in a fence and passes its filters is computed by columns before the state is touched; the state
    of an object is a few numbers a fence. Rows of one object are taken by `seq` within a micro-batch.
    """
    ship(changes.sparkSession)
    rows = changes.filter("kind is null or kind != 'string'")
    flags = []
    for f in fences:
        passes = F.lit(True)
        for w in f.where:
            passes = passes & condition(w)
        inside = (F.col("key") == f.key) & in_area(f, points_only)
        flags.append(F.struct(F.lit(f.name).alias("hook"), F.coalesce(inside, F.lit(False)).alias("inside"), F.coalesce(passes, F.lit(False)).alias("passes")))
    rows = rows.select("seq", "ts", "command", "key", "id", "x", "y", "geojson", F.array(*flags).alias("flags"))
    if not changes.isStreaming:
        return rows.groupBy("key", "id").applyInPandas(_replay(fences), SCHEMA)
    return rows.groupBy("key", "id").applyInPandasWithState(_step(fences), SCHEMA, "saved string", "append", GroupStateTimeout.NoTimeout)


def messages(events: DataFrame, fences: list[Fence]) -> DataFrame:
    """Events as JSON texts for sinks: (hook, key, id, seq, detect, message)."""
    meta = {f.name: f.meta for f in fences if f.meta}
    base = ("command", "group", "detect", "hook", "key", F.col("ts").alias("time"), "id")
    body = F.regexp_replace(F.to_json(F.struct(*base)), r"\}$", "")
    parts = [body, F.when(F.col("geojson").isNotNull(), F.concat(F.lit(',"object":'), F.col("geojson"))).otherwise("")]
    if meta:
        texts = F.create_map(*[F.lit(x) for k, v in meta.items() for x in (k, json.dumps(v))])
        parts.append(F.coalesce(F.concat(F.lit(',"meta":'), texts[F.col("hook")]), F.lit("")))
    return events.select("hook", "key", "id", "seq", "detect", F.concat(*parts, F.lit("}")).alias("message"))


def live_fence(changes: DataFrame, fence: Fence, name: str, checkpoint: str, points_only: bool = False) -> StreamingQuery:
    """A running query whose events collect in the in-memory table `name`, as one client's subscription."""
    rows = stream_events(changes, [fence], points_only)
    return rows.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").start()
