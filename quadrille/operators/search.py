"""Searches over object tables: scan, value search, nearest, within, intersects.

Boxes are compared as plain columns before any exact test, so that file statistics can skip row groups; exact tests of
points stay in Spark's own functions for boxes and circles and go through Arrow kernels for other areas.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, geometry, globs, values, where
from ..plans.session import ship
from ..plans.spec import UNLIMITED, Area, Search, Where


def alive(objects: DataFrame, now: Column | None = None) -> DataFrame:
    """Without the objects whose time is up."""
    now = F.current_timestamp() if now is None else now
    return objects.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def condition(w: Where) -> Column:
    if w.kind == "range":
        return where.in_range(w.name, *w.args)
    if w.kind == "op":
        return where.compare(w.name, *w.args)
    if w.kind == "in":
        return where.member(w.name, list(w.args))
    return where.expression(w.name)


def _all(conditions: list[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def _evaluated(test: Callable[[pd.DataFrame], pd.Series]) -> Column:
    """A Python predicate over id, fields and properties, in batches."""
    ship()

    @F.pandas_udf("boolean")
    def run(id_: pd.Series, fields: pd.Series, properties: pd.Series) -> pd.Series:
        return test(pd.DataFrame({"id": id_, "fields": fields, "properties": properties})).astype(bool)

    numbers = F.transform_values("fields", lambda _, v: values.to_json(v))
    return run(F.col("id"), F.to_json(numbers), F.col("properties"))


# Exact tests.


def _overlaps(box: tuple | None) -> Column:
    if box is None:
        return F.lit(False)
    return (F.col("minx") <= box[2]) & (F.col("maxx") >= box[0]) & (F.col("miny") <= box[3]) & (F.col("maxy") >= box[1])


def _points_kernel(area: Area):
    ship()
    areas = [c for k, c in area.parts if k == "A"]
    rest = [p for p in area.parts if p[0] != "A"]

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        px, py = x.to_numpy(), y.to_numpy()
        out = np.zeros(len(px), bool)
        for rings in areas:
            out |= geometry.points_in_rings(px, py, rings)
        if rest:
            out |= [geometry.intersects([("P", (a, b))], rest) for a, b in zip(px, py, strict=True)]
        return pd.Series(out)

    return run


def _shapes_kernel(area: Area, inside: bool):
    ship()
    test = geometry.within if inside else geometry.intersects
    parts = area.parts

    @F.pandas_udf("boolean")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([test(geometry.parts(geometry.load(t)), parts) for t in text], dtype=bool)

    return run


def point_test(area: Area) -> Column:
    """Whether a point object lies in the area. Circles go by great-circle distance."""
    if area.circle:
        lat, lon, meters = area.circle
        return geo.haversine(F.col("y"), F.col("x"), F.lit(lat), F.lit(lon)) <= meters
    if area.rect:
        return _overlaps(area.bbox)
    return _points_kernel(area)(F.col("x"), F.col("y"))


def matching(objects: DataFrame, area: Area, inside: bool, points_only: bool = False) -> DataFrame:
    """Objects within the area, or meeting it. Objects without geometry never match."""
    box = area.bbox
    near = objects.filter(F.col("minx").isNotNull() & _overlaps(box))
    points = near.filter((F.col("gtype") == "Point") & point_test(area))
    if points_only or box is None:
        return points
    others = near.filter(F.col("gtype") != "Point")
    if area.rect and inside:
        held = (F.col("minx") >= box[0]) & (F.col("maxx") <= box[2]) & (F.col("miny") >= box[1]) & (F.col("maxy") <= box[3])
        others = others.filter(held)
    else:
        others = others.filter(_shapes_kernel(area, inside)(F.col("geojson")))
    return points.unionByName(others)


def with_distance(objects: DataFrame, lat: float, lon: float, points_only: bool = False) -> DataFrame:
    """Add `distance`, metres from a point to each object's box."""
    if points_only:
        meters = geo.haversine(F.col("y"), F.col("x"), F.lit(lat), F.lit(lon))
    else:
        meters = geo.rect_distance(lat, lon, *(F.col(c) for c in ("miny", "minx", "maxy", "maxx")))
    return objects.filter("minx is not null").withColumn("distance", meters)


def sparse(matches: DataFrame, box: tuple, level: int) -> DataFrame:
    """At most one match, the smallest id, in each of 4 ** level equal parts of the box."""
    n = 1 << level

    def cell(v: str, lo: float, hi: float) -> Column:
        share = (F.col(v) - lo) / ((hi - lo) or 1.0)
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(share * n)))

    row = F.struct(*matches.columns)
    kept = matches.groupBy(cell("x", box[0], box[2]), cell("y", box[1], box[3])).agg(F.min_by(row, "id").alias("r"))
    return kept.select("r.*")


# Searches.


class Result:
    """A search's rows (`df`, ordered and limited), and on request its next cursor, field header and JSON."""

    def __init__(self, spec: Search, df: DataFrame, candidates: DataFrame, order: list[str]):
        self.spec, self.df, self._candidates, self._order = spec, df, candidates, order

    def count(self) -> int:
        """Matches, at most the limit."""
        return self.df.count()

    def cursor(self) -> int:
        """How many candidates were visited if the limit was reached, else 0."""
        s = self.spec
        if s.output == "count" or s.sparse or s.most >= UNLIMITED:
            return 0
        ends = self.df.agg(F.count(F.lit(1)).alias("n"), (F.min if s.desc else F.max)(F.struct(*self._order)).alias("last")).first()
        if ends.n < s.most:
            return 0
        last = F.struct(*[F.lit(v) for v in ends["last"]])
        key = F.struct(*self._order)
        return self._candidates.filter(key >= last if s.desc else key <= last).count()

    def header(self) -> list[str]:
        """The names of all fields in the result, sorted."""
        if self.spec.nofields or "fields" not in self.df.columns:
            return []
        names = self.df.select(F.explode(F.map_keys("fields")).alias("n")).distinct().orderBy("n")
        return [r.n for r in names.toLocalIterator()]

    def aligned(self, header: list[str] | None = None) -> DataFrame:
        """The rows with `fields` as an array beside the header, missing ones the number 0."""
        header = self.header() if header is None else header
        texts = [values.to_json(values.field_exact(n)) for n in header]
        return self.df.withColumn("fields", F.array(*texts) if texts else F.array().cast("array<string>"))


def compile(spec: Search, objects: DataFrame) -> Result:
    """The DataFrame of a search; nothing runs but a lookup of the cursor's place, if there is a cursor."""
    spec.check()
    own = objects.filter(F.col("key") == spec.key)
    order = ["id"]
    box = spec.area.bbox if spec.area else None
    if spec.cmd == "scan":
        candidates = own
        tested = candidates
    elif spec.cmd == "search":
        candidates = tested = own.filter("kind = 'string'")
        order = ["value", "id"]
    elif spec.cmd == "nearby" and not spec.sparse:
        lat, lon = spec.area.circle[:2] if spec.area.circle else geometry.center(spec.area.parts)[::-1]
        if spec.radius > 0:
            minlat, minlon, maxlat, maxlon = geo.rect_around(lat, lon, spec.radius)
            if maxlon - minlon < 360:
                own = own.filter(_overlaps((minlon, minlat, maxlon, maxlat)))
        candidates = with_distance(own, lat, lon, spec.points_only)
        if spec.radius > 0:
            candidates = candidates.filter(F.col("distance") <= spec.radius)
        tested, order = candidates, ["distance", "id"]
    else:
        candidates = own.filter(F.col("minx").isNotNull() & _overlaps(box))
        order = ["cell", "id"]
        tested = None
    if spec.cmd in ("scan", "search") and len(spec.match) == 1:
        # Candidates of a scan with one pattern are those with the pattern's literal start.
        start = globs.prefix(spec.match[0])
        if start:
            candidates = candidates.filter(F.col("id" if spec.cmd == "scan" else "value").startswith(start))
            tested = candidates
    if spec.cursor:
        asc = [F.col(c).desc() if spec.desc else F.col(c).asc() for c in order]
        skipped = candidates.select(*order).orderBy(*asc).limit(spec.cursor)
        last = skipped.agg((F.min if spec.desc else F.max)(F.struct(*order)).alias("last"), F.count(F.lit(1)).alias("n")).first()
        if last.n < spec.cursor:
            candidates_left = candidates.limit(0)
        else:
            bound, key = F.struct(*[F.lit(v) for v in last["last"]]), F.struct(*order)
            candidates_left = candidates.filter(key < bound if spec.desc else key > bound)
        tested = candidates_left
    if spec.cmd in ("within", "intersects") or (spec.cmd == "nearby" and spec.sparse):
        source = candidates if tested is None else tested
        tested = matching(source, spec.area, spec.cmd == "within", spec.points_only)
    subject = F.col("value" if spec.cmd == "search" else "id")
    found = tested.filter(_all([globs.any_match(subject, spec.match), *[condition(w) for w in spec.where]]))
    for test in spec.whereeval:
        found = found.filter(_evaluated(test))
    if spec.sparse:
        found = sparse(found, box, spec.sparse)
    if spec.output == "count":
        if spec.most < UNLIMITED:
            found = found.limit(spec.most)
        return Result(spec, found, candidates, order)
    asc = [F.col(c).desc() if spec.desc else F.col(c).asc() for c in order]
    found = found.orderBy(*asc)
    if spec.most < UNLIMITED:
        found = found.limit(spec.most)
    return Result(spec, _shaped(found, spec), candidates, order)


def _clip_kernel(area: Area):
    ship()
    box = area.bbox

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([geometry.dumps(geometry.clip(geometry.load(t), box)) for t in text])

    return run


def _shaped(df: DataFrame, spec: Search) -> DataFrame:
    """Keep what the output asks for, beside the order's columns."""
    if spec.clip:
        df = df.withColumn("geojson", F.when(F.col("minx").isNotNull(), _clip_kernel(spec.area)(F.col("geojson"))))
    if spec.output == "hashes":
        df = df.withColumn("hash", geo.geohash_column(F.col("y"), F.col("x"), spec.precision))
    if spec.nofields:
        df = df.drop("fields")
    if spec.cmd != "nearby" and spec.distance and spec.area is not None:
        lat, lon = geometry.center(spec.area.parts)[::-1]
        meters = geo.rect_distance(lat, lon, *(F.col(c) for c in ("miny", "minx", "maxy", "maxx")))
        df = df.withColumn("distance", meters)
    return df


def area_bounds(objects: DataFrame, key: str) -> DataFrame:
    """The bounding box of a collection: minlat, minlon, maxlat, maxlon; null where nothing has a geometry."""
    return objects.filter(F.col("key") == key).agg(
        F.min("miny").alias("minlat"), F.min("minx").alias("minlon"), F.max("maxy").alias("maxlat"), F.max("maxx").alias("maxlon")
    )
