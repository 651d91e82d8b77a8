"""Geofences over a change log: enter, exit, inside, outside, cross, del and drop events.

Fences are rows; changes meet them by collection key and bounding box. One table of rules (`detection`) serves the
batch form, which sees an object's previous version with lag, and the streaming form, which keeps it as state.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, geometry, globs
from ..plans.session import ship
from ..plans.spec import Area, Where
from .search import condition, point_test

ORDER = ("exit", "outside", "enter", "inside", "cross", "roam")
WEIGHT = {"exit": 1, "outside": 2, "enter": 3, "inside": 4}


@dataclass
class Fence:
    name: str
    key: str
    area: Area | None = None
    inside: bool = True  # whether objects must be within the area, or may only meet it
    match: list[str] = field(default_factory=list)
    where: list[Where] = field(default_factory=list)
    detect: list[str] | None = None
    commands: list[str] | None = None
    nofields: bool = False
    channel: bool = False
    meta: dict[str, str] = field(default_factory=dict)
    endpoints: list[str] = field(default_factory=list)
    expires_at: float | None = None
    roam: dict | None = None
    nodwell: bool = False

    def check(self) -> Fence:
        for d in self.detect or []:
            if d not in ("inside", "outside", "enter", "exit", "cross"):
                raise ValueError(f"invalid argument '{d}'")
        if self.roam and self.detect:
            raise ValueError("DETECT is not allowed with ROAM")
        return self

    def same(self, other: Fence) -> bool:
        """Whether registering the other again would change nothing."""
        pick = lambda f: {**f.__dict__, "area": f.area and f.area.geojson}
        return pick(self) == pick(other)


class Registry:
    """Hooks and channels by name. One name is either a hook or a channel."""

    def __init__(self):
        self.fences: dict[str, Fence] = {}

    def add(self, f: Fence) -> bool:
        """Register or replace; False if the same is there already."""
        f.check()
        old = self.fences.get(f.name)
        if old and old.channel != f.channel:
            raise ValueError(f"{'channel' if old.channel else 'hook'} '{f.name}' already exists")
        if old and old.same(f):
            return False
        self.fences[f.name] = f
        return True

    def remove(self, name: str, channel: bool) -> bool:
        if name in self.fences and self.fences[name].channel == channel:
            del self.fences[name]
            return True
        return False

    def remove_matching(self, pattern: str, channel: bool) -> int:
        names = [n for n, f in self.fences.items() if f.channel == channel and globs.match(pattern, n)]
        for n in names:
            del self.fences[n]
        return len(names)

    def listed(self, pattern: str = "*", channel: bool = False) -> list[Fence]:
        return [f for n, f in sorted(self.fences.items()) if f.channel == channel and globs.match(pattern, n)]

    def live(self, now: float) -> list[Fence]:
        return [f for f in self.fences.values() if f.expires_at is None or f.expires_at > now]

    def uses(self, key: str) -> bool:
        return any(f.key == key or (f.roam or {}).get("key") == key for f in self.fences.values())


# The rules.


def detection(old: Column, new: Column, command: Column, new_filters: Column, crossed: Column) -> Column:
    """What a change means: old and new are whether the versions lie in the fence and pass its filters."""
    fset = command == "fset"
    away = F.when(~fset & ~new_filters, F.lit(None).cast("string")).when(~fset & crossed, "cross").otherwise("outside")
    return F.when(old & new, "inside").when(old, "exit").when(new & fset, "inside").when(new, "enter").otherwise(away)


def requested(detect: Column, names: list[str] | Column | None) -> Column:
    """The events that go out, in order: the detection or what it falls back to, then its second message.

    `names` are the events asked for, null for all; or a column of them, for fences that are rows.
    """
    if names is None:
        wanted = lambda c: F.lit(True)
    elif isinstance(names, Column):
        wanted = lambda c: names.isNull() | F.array_contains(names, c)
    else:
        wanted = lambda c: c.isin(names)
    fallen = F.when(wanted(detect), detect)
    fallen = fallen.when((detect == "enter") & wanted(F.lit("inside")), "inside")
    fallen = fallen.when(detect.isin("exit", "cross") & wanted(F.lit("outside")), "outside")
    second = F.when((fallen == "enter") & wanted(F.lit("inside")), "inside")
    second = second.when(fallen.isin("exit", "cross") & wanted(F.lit("outside")), "outside")
    return F.filter(F.array(fallen, second), lambda x: x.isNotNull())


def _shape_test(area: Area, inside: bool) -> Column:
    parts, test = area.parts, geometry.within if inside else geometry.intersects

    @F.pandas_udf("boolean")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([t is not None and test(geometry.parts(geometry.load(t)), parts) for t in text], dtype=bool)

    return run(F.col("geojson"))


def in_area(f: Fence, points_only: bool) -> Column:
    """Whether the row's geometry lies in the fence; null geometry doesn't."""
    box = f.area.bbox
    near = (F.col("minx") <= box[2]) & (F.col("maxx") >= box[0]) & (F.col("miny") <= box[3]) & (F.col("maxy") >= box[1])
    if points_only:
        return F.coalesce(near & point_test(f.area), F.lit(False))
    # Both tests run where Python is needed, so points take the kernel of their own only with point tables.
    return F.coalesce(near & _shape_test(f.area, f.inside), F.lit(False))


def _crosses(f: Fence) -> Column:
    """Whether the way from the old to the new centre meets the area."""
    parts = f.area.parts
    box = f.area.bbox

    @F.pandas_udf("boolean")
    def run(ox: pd.Series, oy: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d in zip(ox, oy, x, y, strict=True):
            apart = any(v != v for v in (a, b, c, d)) or max(a, c) < box[0] or min(a, c) > box[2] or max(b, d) < box[1] or min(b, d) > box[3]
            out.append(not apart and geometry.intersects([("L", [(a, b), (c, d)])], parts))
        return pd.Series(out, dtype=bool)

    return run(F.col("_ox"), F.col("_oy"), F.col("x"), F.col("y"))


def events(changes: DataFrame, fences: list[Fence], points_only: bool = False) -> DataFrame:
    """All events of a change log: seq, ts, hook, key, id, command, detect, rank, lat, lon, geojson, fields, group.

    A change row must hold the object's whole new version (`fields` folded). The log is read and ordered by (key, id, seq)
    once for all fences: what a row means to each is an array beside it, of which only what is told, or begins a group,
    becomes rows. Every change is tested against every fence of its key, as for a client that listens live; `hook_events`
    finds the candidates of very many fences first. Roaming fences go through `roam`.
    """
    ship(changes.sparkSession)
    by = Window.partitionBy("key", "id").orderBy("seq")
    flags = []
    for f in fences:
        passes = F.lit(True)
        for w in f.where:
            passes = passes & condition(w)
        inside = (F.col("key") == f.key) & in_area(f, points_only)
        flags.append(F.struct(F.coalesce(inside, F.lit(False)).alias("in"), F.coalesce(passes, F.lit(False)).alias("pass")))
    rows = changes.filter(F.col("key").isin([f.key for f in fences])).filter("kind is null or kind != 'string'")
    rows = rows.withColumn("_now", F.array(*flags))
    # A deleted or set object's version before this change; an fset doesn't hand it on.
    past = lambda c: F.when(F.lag("command").over(by) != "del", F.lag(c).over(by))
    rows = rows.withColumns({"_was": past("_now"), "_ox": past("x"), "_oy": past("y")})
    found = []
    for i, f in enumerate(fences):
        now, was, is_set = F.col("_now")[i], F.col("_was")[i], F.col("command") == "set"
        old = F.coalesce(is_set & was["in"] & was["pass"], F.lit(False))
        filtered = (is_set & F.coalesce(was["in"] & ~was["pass"], F.lit(False))) | (now["in"] & ~now["pass"])
        moved = is_set & F.col("_ox").isNotNull() & ~filtered
        wants_cross = f.detect is None or bool({"cross", "outside"} & set(f.detect))
        crossed = moved & _crosses(f) if wants_cross else F.lit(False)
        written = ~F.col("command").isin("del", "drop")
        detect = F.when(written, detection(old, now["in"] & now["pass"], F.col("command"), now["pass"], crossed))
        names = requested(detect, f.detect)
        names = F.when(F.col("command") == "del", F.array(F.lit("del"))).when(F.col("command") == "drop", F.array(F.lit("drop"))).otherwise(names)
        own = F.col("key") == f.key
        kept = own & (globs.any_match(F.col("id"), f.match) | (F.col("command") == "drop"))
        if f.commands is not None:
            kept = kept & F.col("command").isin(f.commands)
        if f.nofields:
            kept = kept & (F.col("command") != "fset")
        starts = own & F.coalesce(detect.isin("enter", "cross"), F.lit(False))
        found.append(F.struct(F.lit(f.name).alias("hook"), names.alias("names"), F.coalesce(kept, F.lit(False)).alias("kept"), starts.alias("starts")))
    told = rows.withColumn("_f", F.explode(F.filter(F.array(*found), lambda x: x["kept"] | x["starts"])))
    return _as_events(told, F.col("_f.hook"), F.col("_f.starts"), F.col("_f.kept"), F.col("_f.names"))


# Many fences: the candidates of a change come from a join by grid cell.

#: Sides of grid cells in degrees. A box belongs to the first level whose cells are at least as large as it is.
LEVELS = (0.25, 1.0, 4.0, 16.0, 64.0, 512.0)

HOOK = (
    "hook string, fkey string, fminx double, fminy double, fmaxx double, fmaxy double, flat double, flon double, fmeters double, rect boolean, "
    "shape string, inside boolean, detect array<string>, commands array<string>, nofields boolean, regex string, conditions int"
)


def _level(box: list[Column]) -> Column:
    span = F.greatest(box[2] - box[0], box[3] - box[1])
    out = F.lit(len(LEVELS) - 1)
    for i in reversed(range(len(LEVELS) - 1)):
        out = F.when(span <= LEVELS[i], i).otherwise(out)
    return out


def _listed(base: Column, level: Column, box: list[Column]) -> Column:
    """The cells of a box at a level, four at most where the level is the box's own or above; each with the box's first cell."""
    size = F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)
    lx, ly, hx, hy = (F.floor((c + d) / size) for c, d in zip(box, (180, 90, 180, 90), strict=True))
    cell = lambda x, y: F.struct(base.alias("base"), level.alias("at"), x.alias("cx"), y.alias("cy"), lx.alias("lx"), ly.alias("ly"))
    return F.flatten(F.transform(F.sequence(lx, hx), lambda x: F.transform(F.sequence(ly, hy), lambda y: cell(x, y))))


def _tag(kind: int) -> Callable[[Column], Column]:
    return lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("c"))


@functools.lru_cache(4096)
def _parts(text: str) -> list:
    return geometry.parts(geometry.load(text))


def _in_shape(text: pd.Series, shape: pd.Series, inside: pd.Series) -> pd.Series:
    test = lambda t, s, i: t is not None and s is not None and (geometry.within if i else geometry.intersects)(geometry.parts(geometry.load(t)), _parts(s))
    return pd.Series([test(*r) for r in zip(text, shape, inside, strict=True)], dtype=bool)


def _way_meets(ox: pd.Series, oy: pd.Series, x: pd.Series, y: pd.Series, shape: pd.Series) -> pd.Series:
    # A null shape is a way that needn't be tested.
    test = lambda a, b, c, d, s: s is not None and geometry.intersects([("L", [(a, b), (c, d)])], _parts(s))
    return pd.Series([test(*r) for r in zip(ox, oy, x, y, shape, strict=True)], dtype=bool)


def hook_events(changes: DataFrame, fences: list[Fence], points_only: bool = False) -> DataFrame:
    """Events as `events` gives them, for any number of fences, each told only of changes that concern it.

    A fence that asks for `outside` (or for everything) is told of all changes of its key. Any other is a candidate where
    its box meets the box of the new or the old version, or, if it asks for `cross`, the box around both; so a delete
    reaches only fences near the object, and a drop none of these. Candidates come from a join by key and grid cell: the
    log is ordered once, a version is listed under at most four cells for each size of fence, a fence under at most four
    for each larger size, and the plan doesn't grow with the fences but with their different conditions. Where the table
    of fences is small Spark broadcasts it; a larger one is shuffled.
    """
    ship(changes.sparkSession)
    wheres = list({repr(f.where): f.where for f in fences}.values())
    rows = []
    for f in fences:
        regex = "|".join(f"(?:{globs.to_regex(p)})" for p in f.match) or None
        shape = json.dumps(f.area.geojson)
        numbers = [None if c is None else float(c) for c in (*f.area.bbox, *(f.area.circle or (None, None, None)))]
        rows.append((f.name, f.key, *numbers, f.area.rect, shape, f.inside, f.detect, f.commands, f.nofields, regex, [repr(w) for w in wheres].index(repr(f.where))))
    table = changes.sparkSession.createDataFrame(rows, HOOK)
    f_box = [F.col(c) for c in ("fminx", "fminy", "fmaxx", "fmaxy")]
    everything = F.col("detect").isNull() | F.array_contains("detect", "outside")
    levels = sorted({int(r[0]) for r in table.filter(~everything).select(_level(f_box)).distinct().collect()})

    by = Window.partitionBy("key", "id").orderBy("seq")
    passes = [F.coalesce(functools.reduce(operator.and_, map(condition, w), F.lit(True)), F.lit(False)) for w in wheres]
    log = changes.filter(F.col("key").isin(sorted({f.key for f in fences}))).filter("kind is null or kind != 'string'")
    names = ["seq", "ts", "command", "key", "id", "x", "y", "minx", "miny", "maxx", "maxy", "geojson", "fields"]
    log = log.select(*names, F.array(*passes).alias("_p")).withColumn("_prev", F.lag(F.struct("command", *names[5:12], "_p")).over(by))
    log = log.withColumn("_prev", F.when(F.col("_prev.command") != "del", F.col("_prev")))
    new, old = ([F.col(p + c) for c in ("minx", "miny", "maxx", "maxy")] for p in ("", "_prev."))
    way = [(F.least if i < 2 else F.greatest)(new[i], old[i]) for i in range(4)]
    way = [F.when(new[i].isNotNull() & old[i].isNotNull(), way[i]) for i in range(4)]
    near = lambda b: F.coalesce((b[0] <= f_box[2]) & (b[2] >= f_box[0]) & (b[1] <= f_box[3]) & (b[3] >= f_box[1]), F.lit(False))

    told = log.join(table.filter(everything), F.col("key") == F.col("fkey"))
    if levels:
        lists = []
        for kind, box in enumerate([new, old, way]):
            for base in levels:
                cells = _listed(F.lit(base), F.greatest(_level(box), F.lit(base)), box)
                cells = F.coalesce(cells, F.array().cast("array<struct<base:int,at:int,cx:bigint,cy:bigint,lx:bigint,ly:bigint>>"))
                lists.append(F.transform(cells, _tag(kind)))
        seen = log.withColumn("_c", F.explode(F.concat(*lists)))
        base = _level(f_box)
        own = [F.when(base <= i, _listed(base, F.lit(i), f_box)) for i in range(len(LEVELS))]
        listed = table.filter(~everything).withColumn("_l", F.explode(F.flatten(F.filter(F.array(*own), lambda x: x.isNotNull()))))
        same = [F.col(f"_c.c.{n}") == F.col(f"_l.{n}") for n in ("base", "at", "cx", "cy")]
        hit = seen.join(listed, functools.reduce(operator.and_, same, F.col("key") == F.col("fkey")))
        # Each pair once: in the first cell that both boxes share, by the first kind of box that meets the fence's.
        hit = hit.filter((F.col("_l.cx") == F.greatest("_c.c.lx", "_l.lx")) & (F.col("_l.cy") == F.greatest("_c.c.ly", "_l.ly")))
        first = F.when(near(new), 0).when(near(old), 1).when(near(way) & F.array_contains("detect", "cross"), 2)
        told = told.unionByName(hit.filter(F.col("_c.kind") == first).drop("_c", "_l"))

    native = points_only and all(f.area.circle or f.area.rect for f in fences)
    kernel = F.pandas_udf(_in_shape, "boolean")

    def lies(p: str, box: list[Column]) -> Column:
        x, y = F.col(f"{p}x"), F.col(f"{p}y")
        round_ = geo.haversine(y, x, F.col("flat"), F.col("flon")) <= F.col("fmeters")
        if native:
            test = F.when(F.col("fmeters").isNotNull(), round_).otherwise(F.lit(True))
        elif points_only:
            text = F.when(x.isNotNull() & F.col("fmeters").isNull() & ~F.col("rect"), F.format_string('{"type":"Point","coordinates":[%s,%s]}', x, y))
            test = F.when(F.col("fmeters").isNotNull(), round_).when(F.col("rect"), True).otherwise(kernel(text, F.col("shape"), F.lit(True)))
        else:
            test = kernel(F.when(near(box), F.col(f"{p}geojson")), F.col("shape"), F.col("inside"))
        return F.coalesce(near(box) & test, F.lit(False))

    at = F.col("conditions")
    told = told.withColumns({"_in": lies("", new), "_was": lies("_prev.", old), "_pass": F.col("_p")[at], "_waspass": F.coalesce(F.col("_prev._p")[at], F.lit(False))})
    is_set = F.col("command") == "set"
    before = is_set & F.col("_was") & F.col("_waspass")
    filtered = (is_set & F.col("_was") & ~F.col("_waspass")) | (F.col("_in") & ~F.col("_pass"))
    wants = F.col("detect").isNull() | F.arrays_overlap("detect", F.array(F.lit("cross"), F.lit("outside")))
    open_ = is_set & F.col("_prev.x").isNotNull() & F.col("x").isNotNull() & ~filtered & wants & ~F.col("_in") & ~F.col("_was") & near(way)
    crossed = F.lit(False)
    if any(f.detect is None or {"cross", "outside"} & set(f.detect) for f in fences):
        crossed = F.pandas_udf(_way_meets, "boolean")("_prev.x", "_prev.y", "x", "y", F.when(open_, F.col("shape")))
    told = told.withColumn("_crossed", crossed)
    written = ~F.col("command").isin("del", "drop")
    found = F.when(written, detection(before, F.col("_in") & F.col("_pass"), F.col("command"), F.col("_pass"), F.col("_crossed")))
    told = told.withColumn("_found", found)
    names = F.when(written, requested(F.col("_found"), F.col("detect"))).otherwise(F.array(F.col("command")))
    kept = F.coalesce(F.col("regex").isNull() | F.rlike("id", F.col("regex")) | (F.col("command") == "drop"), F.lit(False))
    kept = kept & (F.col("commands").isNull() | F.array_contains("commands", F.col("command"))) & ~(F.col("nofields") & (F.col("command") == "fset"))
    starts = F.coalesce(F.col("_found").isin("enter", "cross"), F.lit(False))
    told = told.withColumns({"_names": names, "_kept": kept, "_starts": starts}).filter("_kept or _starts")
    return _as_events(told, F.col("hook"), F.col("_starts"), F.col("_kept"), F.col("_names"))


def _as_events(told: DataFrame, hook: Column, starts: Column, kept: Column, names: Column) -> DataFrame:
    """Rows of (change, fence) as events, one a name; a group begins with the change that `starts` marks."""
    upto = Window.partitionBy("key", "id", hook).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    first = F.last(F.when(starts, F.col("seq")), ignorenulls=True).over(upto)
    told = told.withColumn("_group", F.coalesce(first, F.lit(-1))).filter(kept)
    out = told.select(
        "seq", "ts", hook.alias("hook"), "key", "id", "command", F.posexplode(names).alias("rank", "detect"),
        F.col("y").alias("lat"), F.col("x").alias("lon"), "geojson", "fields",
        F.sha1(F.concat_ws("|", hook, "key", "id", F.col("_group").cast("string"))).alias("group"),
    )
    return out.withColumn("detect", F.when(~F.col("detect").isin("del", "drop"), F.col("detect")))


def message_order() -> list[Column]:
    """How messages of one change are ordered: exit, outside, enter, inside, then by hook."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv])[F.col("detect")], F.lit(0))
    return [F.col("seq"), weight, F.col("hook"), F.col("rank")]


def fence_rows(spark: SparkSession, fences: list[Fence]) -> DataFrame:
    """Fences as a table with their boxes, for the join below."""
    rows = [(f.name, f.key, *f.area.bbox, *(f.area.circle or (None, None, None))) for f in fences]
    return spark.createDataFrame(
        rows, "hook string, fence_key string, fminx double, fminy double, fmaxx double, fmaxy double, flat double, flon double, fmeters double"
    )


def _cells(level: float, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The grid cells of a box, as one array of longs."""
    lo_x, hi_x = F.floor((minx + 180) / level).cast("long"), F.floor((maxx + 180) / level).cast("long")
    lo_y, hi_y = F.floor((miny + 90) / level).cast("long"), F.floor((maxy + 90) / level).cast("long")
    return F.flatten(F.transform(F.sequence(lo_x, hi_x), lambda x: F.transform(F.sequence(lo_y, hi_y), lambda y: x * 1_000_003 + y)))


def join_many(objects: DataFrame, fences: DataFrame, cell_degrees: float = 1.0) -> DataFrame:
    """(hook, key, id) of point objects in box or circle fences, for any number of fences.

    Fences are listed under the grid cells that their boxes touch and objects under their own cell, so the join is by
    equal cell, spread over the cluster, with the exact test after it; a fence larger than a cell is listed several times.
    """
    boxes = fences.withColumn("cell_id", F.explode(_cells(cell_degrees, *(F.col(c) for c in ("fminx", "fminy", "fmaxx", "fmaxy")))))
    at = F.floor((F.col("x") + 180) / cell_degrees).cast("long") * 1_000_003 + F.floor((F.col("y") + 90) / cell_degrees).cast("long")
    joined = objects.withColumn("cell_id", at).join(boxes, (F.col("key") == F.col("fence_key")) & (objects["x"].isNotNull()) & (boxes["cell_id"] == at))
    box = (F.col("x") >= F.col("fminx")) & (F.col("x") <= F.col("fmaxx")) & (F.col("y") >= F.col("fminy")) & (F.col("y") <= F.col("fmaxy"))
    near = geo.haversine(F.col("y"), F.col("x"), F.col("flat"), F.col("flon")) <= F.col("fmeters")
    return joined.filter(F.when(F.col("fmeters").isNull(), box).otherwise(box & near)).select("hook", "key", "id")

