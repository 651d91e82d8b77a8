"""What a search asks for, as plain data: the compiler in `operators.search` turns it into a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd

from ..functions import geo, geometry

UNLIMITED = 1 << 62
DEFAULT_LIMIT = 100


@dataclass
class Area:
    """A query geometry; a circle also keeps its centre and radius, which points are tested by."""

    geojson: dict
    circle: tuple[float, float, float] | None = None
    rect: bool = False

    def __post_init__(self):
        self.parts = geometry.parts(self.geojson)

    @property
    def bbox(self) -> tuple[float, float, float, float] | None:
        """(minx, miny, maxx, maxy)."""
        box = geometry.bbox(self.parts)
        if self.circle and self.circle[2] > 0:
            minlat, minlon, maxlat, maxlon = geo.rect_around(*self.circle)
            box = (min(box[0], minlon), min(box[1], minlat), max(box[2], maxlon), max(box[3], maxlat))
        return box


def point(lat: float, lon: float) -> Area:
    return Area({"type": "Point", "coordinates": [lon, lat]})


def circle(lat: float, lon: float, meters: float) -> Area:
    if meters < 0:
        raise ValueError(f"invalid argument '{meters:g}'")
    return Area(geometry.circle(lat, lon, meters), circle=(lat, lon, meters))


def bounds(minlat: float, minlon: float, maxlat: float, maxlon: float) -> Area:
    return Area(geometry.rect(minlon, minlat, maxlon, maxlat), rect=True)


def geojson(text: str | dict) -> Area:
    return Area(geometry.load(text))


def sector(lat: float, lon: float, meters: float, start: float, end: float) -> Area:
    return Area(geometry.sector(lat, lon, meters, start, end))


def geohash(text: str) -> Area:
    return bounds(*geo.geohash_bounds(text))


def quadkey(text: str) -> Area:
    return bounds(*geo.tile_bounds(*geo.quadkey_tile(text)))


def tile(x: int, y: int, z: int) -> Area:
    if not 0 <= z <= 23:
        raise ValueError(f"invalid argument '{z}'")
    return bounds(*geo.tile_bounds(x, y, z))


def mvt(x: int, y: int, z: int) -> Area:
    return bounds(*geo.margin_bounds(x, y, z))


def clipped(area: Area, by: Area) -> Area:
    """The area inside the other's bounding box."""
    out = Area(geometry.clip(area.geojson, by.bbox))
    out.rect = area.rect and bool(out.parts)
    return out


def buffered(area: Area, meters: float) -> Area:
    return Area(geometry.buffer(area.geojson, meters)) if meters > 0 else area


@dataclass
class Where:
    """A condition: (name, low, high), (name, op, value), (name, options) or an expression."""

    kind: str
    name: str = ""
    args: tuple = ()


@dataclass
class Search:
    cmd: str
    key: str
    match: list[str] = field(default_factory=list)
    where: list[Where] = field(default_factory=list)
    whereeval: list[Callable[[pd.DataFrame], pd.Series]] = field(default_factory=list)
    cursor: int = 0
    limit: int | None = None
    sparse: int = 0
    desc: bool = False
    output: str = "objects"
    precision: int = 0
    distance: bool = False
    nofields: bool = False
    clip: bool = False
    area: Area | None = None
    radius: float = 0.0
    tile: tuple[int, int, int] | None = None
    points_only: bool = False
    fence: dict | None = None

    def check(self) -> Search:
        """Raise on options that don't go together."""
        spatial = self.cmd in ("nearby", "within", "intersects")
        if self.cmd not in ("scan", "search", "nearby", "within", "intersects"):
            raise ValueError(f"unknown command '{self.cmd}'")
        if (self.sparse or self.fence is not None) and not spatial:
            raise ValueError(f"SPARSE and FENCE are not allowed for {self.cmd.upper()}")
        if self.desc and spatial:
            raise ValueError(f"DESC is not allowed for {self.cmd.upper()}")
        if self.sparse and (self.limit is not None or self.cursor):
            raise ValueError("LIMIT and CURSOR are not allowed when SPARSE is specified")
        if self.cursor and self.fence is not None:
            raise ValueError("CURSOR is not allowed when FENCE is specified")
        if not 0 <= self.sparse <= 16:
            raise ValueError(f"invalid argument '{self.sparse}'")
        if self.clip and self.cmd != "intersects":
            raise ValueError(f"CLIP is not allowed for {self.cmd.upper()}")
        if self.cmd == "nearby" and self.sparse and self.radius <= 0:
            raise ValueError("SPARSE needs a radius")
        if spatial and self.area is None and not (self.fence or {}).get("roam"):
            raise ValueError("wrong number of arguments")
        return self

    @property
    def most(self) -> int:
        if self.limit is not None:
            return self.limit
        return UNLIMITED if self.output == "count" or self.sparse else DEFAULT_LIMIT
