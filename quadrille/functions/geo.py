"""Geodesic and tiling arithmetic, once as Spark columns and once as plain functions for query areas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres.
EARTH = 6371000.0
MIN_LAT, MAX_LAT, MIN_LON, MAX_LON = -85.05112878, 85.05112878, -180.0, 180.0
#: Fixed value: the digits of geohashes.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"
_BASE32 = [str(i) if i < 10 else chr(55 + i) for i in range(32)]


def _arc(lat1, lon1, lat2, lon2) -> Column:
    """Angle between points given in radians."""
    a, b = F.sin((lat1 - lat2) / 2), F.sin((lon1 - lon2) / 2)
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), a * a + b * b * F.cos(lat1) * F.cos(lat2))))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between points in degrees."""
    return F.lit(EARTH) * _arc(*(F.radians(x) for x in (lat1, lon1, lat2, lon2)))


def distance(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    a, b = math.sin((p - q) / 2), math.sin(math.radians(lon1 - lon2) / 2)
    return 2 * EARTH * math.asin(math.sqrt(min(1.0, a * a + b * b * math.cos(p) * math.cos(q))))


def rect_distance(lat: float, lon: float, miny: Column, minx: Column, maxy: Column, maxx: Column) -> Column:
    """Metres from a fixed point to a latitude-longitude rectangle, 0 inside; a point rectangle is a point.

    Between the rectangle's meridians the nearest place is due north or south. Else it is on the nearer meridian edge:
    at a corner, or where the great circle meets the edge at a right angle.
    """
    q, l_q = F.radians(F.lit(float(lat))), F.radians(F.lit(float(lon)))
    lo, hi, west, east = (F.radians(x) for x in (miny, maxy, minx, maxx))
    turn = 2 * math.pi
    to_west, to_east = F.pmod(west - l_q + turn, F.lit(turn)), F.pmod(l_q - east + turn, F.lit(turn))
    nearer = to_west <= to_east
    off, edge = F.least(to_west, to_east), F.when(nearer, west).otherwise(east)
    north, south = _arc(q, l_q, hi, edge), _arc(q, l_q, lo, edge)
    slope, bend = F.tan(q), F.cos(off)
    far = F.when(slope >= F.tan((lo + hi) / 2) * bend, north).otherwise(south)
    near = F.when(slope >= F.tan(hi) * bend, north).when(slope <= F.tan(lo) * bend, south)
    near = near.otherwise(F.asin(F.cos(q) * F.sin(off)))
    beside = F.when(off >= math.pi / 2, far).otherwise(near)
    upright = F.when(q < lo, lo - q).when(q > hi, q - hi).otherwise(F.lit(0.0))
    arc = F.when((lo >= hi) & (west >= east), _arc(lo, west, q, l_q))
    arc = arc.when((west <= l_q) & (l_q <= east), upright).otherwise(beside)
    return F.lit(EARTH) * arc


def destination(lat: float, lon: float, meters: float, bearing: float) -> tuple[float, float]:
    """(lat, lon) reached from a point along a bearing in degrees."""
    d, p, l_, b = meters / EARTH, math.radians(lat), math.radians(lon), math.radians(bearing)
    sin_p = math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(b)
    q = math.asin(max(-1.0, min(1.0, sin_p)))
    m = l_ + math.atan2(math.sin(b) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(q))
    return math.degrees(q), (math.degrees(m) + 540) % 360 - 180


def bearing(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p, q, d = math.radians(lat1), math.radians(lat2), math.radians(lon2 - lon1)
    y, x = math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d)
    return (math.degrees(math.atan2(y, x)) + 360) % 360


def rect_around(lat: float, lon: float, meters: float) -> tuple[float, float, float, float]:
    """(minlat, minlon, maxlat, maxlon) of the circle's bounding box."""
    r, p = meters / EARTH, math.radians(lat)
    lo, hi = p - r, p + r
    if lo <= -math.pi / 2 or hi >= math.pi / 2:
        return max(-90.0, math.degrees(lo)), -180.0, min(90.0, math.degrees(hi)), 180.0
    d = math.degrees(math.asin(min(1.0, math.sin(r) / math.cos(p))))
    if lon - d < -180 or lon + d > 180:
        return math.degrees(lo), -180.0, math.degrees(hi), 180.0
    return math.degrees(lo), lon - d, math.degrees(hi), lon + d


def half_width(lat: Column, meters: float) -> Column:
    """Degrees of longitude from a point to the sides of its `rect_around_columns`."""
    return F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(meters / EARTH)) / F.cos(F.radians(lat)))))


def rect_around_columns(lat: Column, lon: Column, meters: float) -> tuple[Column, Column, Column, Column]:
    """`rect_around` for a column of points (no wrap at the poles)."""
    d, step = half_width(lat, meters), math.degrees(meters / EARTH)
    return lat - step, lon - d, lat + step, lon + d


# Tiles of the spherical Mercator pyramid.


def pixel_columns(lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    size = float(256 << level)
    lat = F.greatest(F.lit(MIN_LAT), F.least(F.lit(MAX_LAT), lat))
    lon = F.greatest(F.lit(MIN_LON), F.least(F.lit(MAX_LON), lon))
    s = F.sin(F.radians(lat))
    y = F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)
    x = (lon + 180) / 360

    def whole(v: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(size - 1), v * size + 0.5)).cast("long")

    return whole(x), whole(y)


def tile_columns(lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    x, y = pixel_columns(lat, lon, level)
    return F.shiftright(x, 8), F.shiftright(y, 8)


def quadkey_column(lat: Column, lon: Column, level: int) -> Column:
    """One base-4 digit a level, from the coarsest."""
    x, y = tile_columns(lat, lon, level)
    return F.lpad(F.conv((_spread(x) + 2 * _spread(y)).cast("string"), 10, 4), level, "0") if level else F.lit("")


def _spread(v: Column) -> Column:
    """A number's bits with a zero bit between neighbours: its binary digits read as base 4."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def pixel(lat: float, lon: float, level: int) -> tuple[int, int]:
    size = float(256 << level)
    lat, lon = max(MIN_LAT, min(MAX_LAT, lat)), max(MIN_LON, min(MAX_LON, lon))
    s = math.sin(math.radians(lat))
    x, y = (lon + 180) / 360, 0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)
    return tuple(int(max(0.0, min(size - 1, v * size + 0.5))) for v in (x, y))


def tile_of(lat: float, lon: float, level: int) -> tuple[int, int]:
    x, y = pixel(lat, lon, level)
    return x >> 8, y >> 8


def quadkey(x: int, y: int, level: int) -> str:
    return "".join(str((x >> i & 1) + 2 * (y >> i & 1)) for i in range(level - 1, -1, -1))


def quadkey_tile(key: str) -> tuple[int, int, int]:
    if any(c not in "0123" for c in key):
        raise ValueError("invalid quadkey")
    x = y = 0
    for c in key:
        x, y = x << 1 | int(c) & 1, y << 1 | int(c) >> 1
    return x, y, len(key)


def _tile_corner(x: int, y: int, level: int) -> tuple[float, float]:
    size = float(256 << level)
    a = max(0.0, min(size - 1, float(x << 8))) / size - 0.5
    b = 0.5 - max(0.0, min(size - 1, float(y << 8))) / size
    return 90 - 360 * math.atan(math.exp(-b * 2 * math.pi)) / math.pi, 360 * a


def tile_bounds(x: int, y: int, level: int) -> tuple[float, float, float, float]:
    """(minlat, minlon, maxlat, maxlon); the outermost tiles reach the map's edge."""
    n = 1 << level
    maxlat, minlon = _tile_corner(x, y, level)
    minlat, maxlon = _tile_corner(x + 1, y + 1, level)
    minlon = MIN_LON if x % n == 0 else minlon
    maxlon = MAX_LON if x % n == n - 1 else maxlon
    return (MIN_LAT if y >= n - 1 else minlat), minlon, (MAX_LAT if y <= 0 else maxlat), maxlon


def margin_bounds(x: int, y: int, level: int, share: float = 0.0625) -> tuple[float, float, float, float]:
    """A vector tile's bounds with its margin: the lower sides move first, and the upper ones by the grown extent."""
    minlat, minlon, maxlat, maxlon = tile_bounds(x, y, level)
    minlat -= (maxlat - minlat) * share
    maxlat += (maxlat - minlat) * share
    minlon -= (maxlon - minlon) * share
    maxlon += (maxlon - minlon) * share
    return max(minlat, MIN_LAT), max(minlon, MIN_LON), min(maxlat, MAX_LAT), min(maxlon, MAX_LON)


# Geohashes.


def geohash_column(lat: Column, lon: Column, precision: int) -> Column:
    """Interleaved bits of longitude and latitude, five to a digit."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2

    def cell(v: Column, lo: float, n: int) -> Column:
        whole = F.floor((v - lo) / (-2 * lo) * float(1 << n)).cast("long")
        return F.greatest(F.lit(0), F.least(F.lit((1 << n) - 1), whole))

    x, y = _spread(cell(lon, -180.0, n_lon)), _spread(cell(lat, -90.0, n_lat))
    # Longitude has the first bit, so it has the last one if their number is odd.
    mixed = x + 2 * y if bits % 2 else 2 * x + y
    text = F.lpad(F.conv(mixed.cast("string"), 10, 32), precision, "0")
    return F.translate(text, "".join(_BASE32), GEOHASH)


def geohash(lat: float, lon: float, precision: int) -> str:
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    x = max(0, min((1 << n_lon) - 1, math.floor((lon + 180) / 360 * (1 << n_lon))))
    y = max(0, min((1 << n_lat) - 1, math.floor((lat + 90) / 180 * (1 << n_lat))))
    out = ""
    for i in range(precision):
        v = 0
        for at in range(5 * i, 5 * i + 5):
            v = v << 1 | ((x >> (n_lon - 1 - at // 2)) & 1 if at % 2 == 0 else (y >> (n_lat - 1 - at // 2)) & 1)
        out += GEOHASH[v]
    return out


def geohash_bounds(text: str) -> tuple[float, float, float, float]:
    """(minlat, minlon, maxlat, maxlon) of a geohash cell."""
    lat, lon, even = [-90.0, 90.0], [-180.0, 180.0], True
    for c in text.lower():
        if c not in GEOHASH:
            raise ValueError("invalid geohash")
        for b in (16, 8, 4, 2, 1):
            side = lon if even else lat
            mid = (side[0] + side[1]) / 2
            side[0 if GEOHASH.index(c) & b else 1] = mid
            even = not even
    return lat[0], lon[0], lat[1], lon[1]


def geohash_center(text: str) -> tuple[float, float]:
    a, b, c, d = geohash_bounds(text)
    return (a + c) / 2, (b + d) / 2
