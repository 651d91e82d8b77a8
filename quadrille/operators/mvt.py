"""Vector tiles: objects that meet a tile become one layer of a Mapbox vector tile, encoded by hand."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, geometry
from ..plans import spec as specs
from ..plans.session import ship
from .search import compile

EXTENT = 4096
LAYER = "objects"
#: Fixed values of the tile format: geometry types and drawing commands.
POINT, LINE, POLYGON = 1, 2, 3
MOVE, DRAW, CLOSE = 1, 2, 7


def _varint(n: int) -> bytes:
    out = b""
    while True:
        low, n = n & 127, n >> 7
        out += bytes([low | 128 if n else low])
        if not n:
            return out


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _number(number: int, n: int) -> bytes:
    return _varint(number << 3) + _varint(n)


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def tile_xy(lat: float, lon: float, x: int, y: int, z: int) -> tuple[int, int]:
    """A place's coordinates within a tile, in units of the extent."""
    lat = max(geo.MIN_LAT, min(geo.MAX_LAT, lat))
    s = math.sin(math.radians(lat))
    n = 1 << z
    px = ((lon + 180) / 360 * n - x) * EXTENT
    py = ((0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * n - y) * EXTENT
    return math.floor(px), math.floor(py)


class _Pen:
    def __init__(self):
        self.words: list[int] = []
        self.at = (0, 0)

    def path(self, pts: list[tuple[int, int]], close: bool) -> None:
        for i, p in enumerate(pts):
            if i == 0:
                self.words.append(MOVE | 1 << 3)
            elif i == 1:
                self.words.append(DRAW | (len(pts) - 1) << 3)
            self.words += [_zigzag(p[0] - self.at[0]), _zigzag(p[1] - self.at[1])]
            self.at = p
        if close:
            self.words.append(CLOSE | 1 << 3)

    def data(self) -> bytes:
        return b"".join(_varint(w) for w in self.words)


def _signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def encode(rows: list[tuple[str, dict]], x: int, y: int, z: int, layer: str = LAYER) -> bytes:
    """A tile of (id, GeoJSON) rows; each simple part is a feature with tags `type` and `id`."""
    keys, texts, index, features = ["type", "id"], [], {}, []

    def value(t: str) -> int:
        if t not in index:
            index[t] = len(texts)
            texts.append(t)
        return index[t]

    names = {"P": ("point", POINT), "L": ("linestring", LINE), "A": ("polygon", POLYGON)}
    for id_, g in rows:
        for kind, c in geometry.parts(g):
            pen, (name, code) = _Pen(), names[kind]
            to_tile = lambda p: tile_xy(p[1], p[0], x, y, z)
            if kind == "P":
                pen.path([to_tile(c)], close=False)
            elif kind == "L":
                pen.path([to_tile(p) for p in c], close=False)
            else:
                for i, ring in enumerate(c):
                    # Outer rings run clockwise on the map, holes the other way.
                    ring = ring if (_signed_area(ring) < 0) == (i == 0) else ring[::-1]
                    pen.path([to_tile(p) for p in ring], close=True)
            tags = b"".join(_varint(n) for n in (0, value(name), 1, value(id_)))
            features.append(_field(2, _field(2, tags) + _number(3, code) + _field(4, pen.data())))
    body = _number(15, 2) + _field(1, layer.encode()) + b"".join(features)
    body += b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _field(1, t.encode())) for t in texts) + _number(5, EXTENT)
    return _field(3, body)


def tile(objects: DataFrame, key: str, x: int, y: int, z: int, limit: int = 100_000_000, sparse: int = 0) -> DataFrame:
    """One row: the tile's bytes. Objects that meet the tile and its margin are clipped to it."""
    search = specs.Search("intersects", key, area=specs.mvt(x, y, z), clip=True, sparse=sparse, limit=None if sparse else limit, tile=(x, y, z))
    rows = compile(search, objects).df.select("id", "geojson")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        own = [(i, geometry.load(g)) for i, g in zip(pdf["id"], pdf["geojson"], strict=True)]
        return pd.DataFrame({"x": [x], "y": [y], "z": [z], "mvt": [encode(own, x, y, z)]})

    return rows.withColumn("_tile", F.lit(0)).groupBy("_tile").applyInPandas(run, "x int, y int, z int, mvt binary")


def tiles(objects: DataFrame, key: str, z: int) -> DataFrame:
    """All tiles of a level that hold points: (x, y, z, features, mvt), one task's work a tile."""
    spark: SparkSession = objects.sparkSession
    ship(spark)
    tx, ty = geo.tile_columns(F.col("y"), F.col("x"), z)
    rows = objects.filter((F.col("key") == key) & (F.col("gtype") == "Point")).select("id", "geojson", tx.alias("tx"), ty.alias("ty"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, y = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        own = [(i, geometry.load(g)) for i, g in zip(pdf["id"], pdf["geojson"], strict=True)]
        return pd.DataFrame({"x": [x], "y": [y], "z": [z], "features": [len(pdf)], "mvt": [encode(own, x, y, z)]})

    return rows.groupBy("tx", "ty").applyInPandas(run, "x int, y int, z int, features long, mvt binary")
