"""Pure functions and columns against known answers and round trips."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions import geo, geometry, globs, jsonpath, values

#: Pattern, text, whether it matches.
GLOBS = [
    ("abc", "abc", True), ("*", "abc", True), ("*c", "abc", True), ("a*", "a", True), ("a*", "abc", True), ("a*", "ab/c", True),
    ("a*/b", "abc/b", True), ("a*/b", "a/c/b", True), ("ab[c]", "abc", True), ("ab[b-d]", "abc", True), ("ab[e-g]", "abc", False),
    ("ab[^c]", "abc", False), ("ab[^b-d]", "abc", False), ("ab[^e-g]", "abc", True), ("a\\*b", "a*b", True), ("a\\*b", "ab", False),
    ("a?b", "a☺b", True), ("a[^a]b", "a☺b", True), ("a???b", "a☺b", False), ("[a-ζ]*", "α", True), ("*[a-ζ]", "A", False), ("a?b", "a/b", True),
    ("[\\]a]", "]", True), ("[\\-]", "-", True), ("[x\\-]", "x", True), ("[x\\-]", "z", False), ("[\\-x]", "a", False), ("*x", "xxx", True),
    ("a*b", "a\nb", True), ("ab", "ab\n", False),
]


def test_globs(spark):
    for pattern, text, want in GLOBS:
        assert globs.match(pattern, text) is want, (pattern, text)
    df = spark.createDataFrame([(t,) for _, t, _ in GLOBS], "t string").distinct()
    for pattern in {p for p, _, _ in GLOBS}:
        got = {r.t for r in df.filter(globs.matches(F.col("t"), pattern)).collect()}
        assert got == {r.t for r in df.collect() if globs.match(pattern, r.t)}, pattern
    for bad in ("[", "[a", "a\\", "[^"):
        with pytest.raises(globs.BadPattern):
            globs.match(bad, "a")
    assert globs.prefix("ab*c") == "ab" and globs.prefix("a\\*b?") == "a*b"


RAW = ["0", "1.5", "-2e3", "000123", "nan", "Inf", "-inf", "null", "true", "false", '{"a": 1}', "[1, 2]", '"q"', "abc", " x ", "", "1e400", "{bad"]


def test_typed_values(spark):
    df = spark.createDataFrame([(t,) for t in RAW], "t string")
    for r in df.select("t", values.typed(F.col("t")).alias("v")).collect():
        want = values.parse(r.t)
        assert (r.v.kind, r.v.data) == (want.kind, want.data) or r.t == "1e400", r
    order = ["null", "false", "-5", "123", "hello", "HELLOx", "true", "[]"]
    cols = [values.parse(t).column() for t in order]
    row = spark.range(1).select(*[values.less(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(8) for j in range(8)]).first()
    for i in range(8):
        for j in range(8):
            assert row[f"c{i}_{j}"] == (i < j), (order[i], order[j])
    nan, one = values.parse("nan").column(), values.parse("1").column()
    assert spark.range(1).select(values.equal(nan, one)).first()[0] is True


def test_geodesy(spark):
    assert geo.distance(20, 20, 19, 19) == pytest.approx(152808.67164037024, abs=1e-6)
    lat, lon = geo.destination(33, -115, 5000, 77)
    assert geo.distance(33, -115, lat, lon) == pytest.approx(5000, abs=1e-6)
    assert geo.bearing(33, -115, lat, lon) == pytest.approx(77, abs=1e-6)
    rng = random.Random(1)
    rows = []
    for _ in range(60):
        a, b = sorted(rng.uniform(-80, 80) for _ in range(2))
        c, d = sorted(rng.uniform(-170, 170) for _ in range(2))
        rows.append((a, c, b, d))
    df = spark.createDataFrame(rows, "miny double, minx double, maxy double, maxx double")
    q = (12.5, -33.25)
    got = df.select("*", geo.rect_distance(*q, *(F.col(c) for c in df.columns)).alias("m")).collect()
    for r in got:
        steps = [i / 300 for i in range(301)]
        edge = [(r.miny + (r.maxy - r.miny) * t, x) for t in steps for x in (r.minx, r.maxx)]
        edge += [(y, r.minx + (r.maxx - r.minx) * t) for t in steps for y in (r.miny, r.maxy)]
        inside = r.miny <= q[0] <= r.maxy and r.minx <= q[1] <= r.maxx
        best = 0 if inside else min(geo.distance(*q, *p) for p in edge)
        assert r.m <= best + 1e-6 and r.m >= best - 60_000, (r, best)


def test_tiles_and_geohashes(spark):
    rng = random.Random(2)
    pts = [(rng.uniform(-84, 84), rng.uniform(-179, 179)) for _ in range(100)]
    df = spark.createDataFrame(pts, "lat double, lon double")
    rows = df.select("*", geo.quadkey_column(F.col("lat"), F.col("lon"), 9).alias("q"), geo.geohash_column(F.col("lat"), F.col("lon"), 9).alias("h")).collect()
    for r in rows:
        x, y = geo.tile_of(r.lat, r.lon, 9)
        assert r.q == geo.quadkey(x, y, 9) and geo.quadkey_tile(r.q) == (x, y, 9)
        a, b, c, d = geo.tile_bounds(x, y, 9)
        assert a - 0.01 <= r.lat <= c + 0.01 and b - 0.01 <= r.lon <= d + 0.01
        assert r.h == geo.geohash(r.lat, r.lon, 9)
        a, b, c, d = geo.geohash_bounds(r.h)
        assert a <= r.lat <= c and b <= r.lon <= d
    assert geo.geohash(33, -115, 7) == "9my5xp7"
    with pytest.raises(ValueError):
        geo.quadkey_tile("4")


def area(*rings):
    return geometry.parts({"type": "Polygon", "coordinates": [list(map(list, r)) for r in rings]})


def square(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


def test_predicates():
    big, hole, small = square(0, 0, 10, 10), square(3, 3, 6, 6), square(4, 4, 5, 5)
    ring = area(big, hole)
    assert not geometry.within(area(small), ring) and not geometry.intersects(area(small), ring)
    assert geometry.within(area(small), area(big)) and geometry.contains(area(big), area(small))
    assert not geometry.within(area(square(2, 2, 7, 7)), ring) and geometry.intersects(area(square(2, 2, 7, 7)), ring)
    assert geometry.within(area(square(2, 2, 7, 7), hole), ring)
    assert geometry.within([("P", (3, 4))], ring) and not geometry.within([("P", (4, 4))], ring)
    assert geometry.within([("L", [(0, 0), (10, 0)])], area(big)) and geometry.within([("L", [(0, 0), (10, 10)])], area(big))
    assert not geometry.within([("L", [(1, 1), (9, 9)])], ring)
    assert geometry.intersects([("L", [(-5, 5), (15, 5)])], ring) and not geometry.intersects([("L", [(3.5, 3.5), (5, 5)])], ring)
    assert geometry.within([("L", [(1, 1), (2, 2)])], [("L", [(0, 0), (3, 3)])])
    assert geometry.intersects([("P", (1, 1))], [("L", [(0, 0), (3, 3)])])
    u = area([(0, 0), (10, 0), (10, 10), (6, 10), (6, 4), (4, 4), (4, 10), (0, 10), (0, 0)])
    assert not geometry.within([("L", [(1, 9), (9, 9)])], u) and geometry.within(area(square(1, 1, 9, 3)), u)
    assert not geometry.intersects([], u) and not geometry.within([], u)


def test_within_implies_intersects():
    rng = random.Random(6)
    shapes = []
    for _ in range(60):
        x, y, w = rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0.5, 6)
        shapes.append(rng.choice([area(square(x, y, x + w, y + w)), [("P", (x, y))], [("L", [(x, y), (x + w, y + rng.uniform(0, w))])]]))
    for a in shapes:
        assert geometry.within(a, a) and geometry.intersects(a, a)
        for b in shapes:
            assert geometry.intersects(a, b) == geometry.intersects(b, a)
            assert not geometry.within(a, b) or geometry.intersects(a, b)


def test_clip():
    line = {"type": "LineString", "coordinates": [[-2, 1], [2, 1], [2, 5], [4, 5], [4, 1], [8, 1]]}
    out = geometry.clip(line, (0, 0, 6, 3))
    assert out["type"] == "MultiLineString" and len(out["coordinates"]) == 2
    poly = {"type": "Polygon", "coordinates": [square(0, 0, 10, 10), square(1, 1, 2, 2), square(8, 8, 9, 9)]}
    out = geometry.clip(poly, (0, 0, 5, 5))
    assert len(out["coordinates"]) == 2
    rng = random.Random(3)
    for _ in range(50):
        ring = [(rng.uniform(-5, 15), rng.uniform(-5, 15)) for _ in range(3)]
        cut = geometry.clip_ring([*ring, ring[0]], (0, 0, 10, 10))
        assert all(-1e-9 <= v <= 10 + 1e-9 for p in cut for v in p)
        assert geometry.clip_segment(ring[0], ring[1], (0, 0, 10, 10)) is None or geometry.intersects([("L", ring[:2])], area(square(0, 0, 10, 10)))
    assert geometry.clip({"type": "Point", "coordinates": [20, 20]}, (0, 0, 1, 1))["coordinates"] == []


def test_buffer_kinds():
    grown = geometry.parts(geometry.buffer({"type": "Polygon", "coordinates": [square(0, 0, 1, 1), square(0.4, 0.4, 0.6, 0.6)]}, 5000))
    assert geometry.intersects([("P", (-0.03, 0.5))], grown) and not geometry.intersects([("P", (-0.1, 0.5))], grown)
    assert geometry.intersects([("P", (0.43, 0.5))], grown) and not geometry.intersects([("P", (0.5, 0.5))], grown)
    p = {"type": "Point", "coordinates": [1, 1]}
    assert geometry.buffer(p, 0) is p
    with pytest.raises(ValueError):
        geometry.buffer(p, float("inf"))
    with pytest.raises(ValueError):
        geometry.buffer({"type": "GeometryCollection", "geometries": []}, 5)


def test_json_paths(spark):
    text = '{"a":{"b":[1,2.50,{"c":"x"}]}}'
    assert jsonpath.get(text, "a.b.2.c") == "x" and jsonpath.get(text, "a.b.2.c", raw=True) == '"x"'
    assert jsonpath.get(text, "a.b.1") == "2.50" and jsonpath.get(text, "a.z") is None
    assert jsonpath.put(text, "a.b.-1", "9") == '{"a":{"b":[1,2.50,{"c":"x"},9]}}'
    assert jsonpath.put(None, "x.0", "true") == '{"x":[true]}'
    assert jsonpath.put(text, "a.b", '{"k":1}', "raw") == '{"a":{"b":{"k":1}}}'
    assert jsonpath.put(text, "a.b", "12", "str") == '{"a":{"b":"12"}}'
    assert jsonpath.remove(text, "a.b.0") == ('{"a":{"b":[2.50,{"c":"x"}]}}', 1)
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r[0] for r in df.select(jsonpath.get_column(F.col("t"), "a.b.2.c")).collect()] == ["x", None]


def test_geojson_kinds():
    for bad in ("x", "{}", '{"type":"Nope"}', '{"type":"Point"}', '{"type":"LineString","coordinates":[[1,2]]}', "[]"):
        with pytest.raises(geometry.BadGeometry):
            geometry.load(bad)
    g = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}}]}
    assert geometry.bbox(geometry.parts(geometry.load(json.dumps(g)))) == (1, 2, 3, 4)
