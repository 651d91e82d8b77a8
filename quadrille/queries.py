"""One query for each operator over the driver's tables, and the SQL that must give the same rows.

The tables have no coordinates. Whole-number arithmetic on ids, exact in both engines, makes some: events are points of
a fleet and, grouped by user, a change log; customers are standing points; documents are string objects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, geometry, jsonpath, values
from .operators import fences, kv, mvt, roam
from .operators import search as ops
from .plans import spec as S
from .plans.spec import Search, Where
from .plans.session import ship
from .sources import objects as src
from .sources.objects import GEOMETRY_NAMES
from .streaming import fences as stream

LAT = "((event_id * 7919) % 180000)::DOUBLE / 1000 - 90"
LON = "((event_id * 104729) % 360000)::DOUBLE / 1000 - 180"
FLEET_SQL = f"fleet AS (SELECT 'e' || event_id AS id, event_id, user_id, event_type, value, props, {LAT} AS lat, {LON} AS lon FROM events)"


def _coords(id_: Column) -> tuple[Column, Column]:
    return F.pmod(id_ * 7919, F.lit(180000)).cast("double") / 1000 - 90, F.pmod(id_ * 104729, F.lit(360000)).cast("double") / 1000 - 180


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a point object with fields value, event_type and props."""
    df = events(spark, sf_dir)
    lat, lon = _coords(F.col("event_id"))
    id_ = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    fields = {"value": F.col("value"), "event_type": F.col("event_type"), "props": F.col("props")}
    return src.objects(F.lit("fleet"), id_, src.point_geometry(lat, lon), df, fields)


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as string objects: the value is the source."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    return src.objects(F.lit("docs"), F.col("doc_id").cast("string"), src.string_geometry(F.col("source")), df, {"n_chars": F.col("n_chars")})


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log of users: every tenth deletes, every seventh sets fields only."""
    df = events(spark, sf_dir)
    lat, lon = _coords(F.col("event_id"))
    e = F.col("event_id")
    command = F.when(e % 10 == 9, "del").when(e % 7 == 3, "fset").otherwise("set")
    # A field of value 0 deletes: every fifth event writes speed 0.
    fields = values.field_map({"value": F.col("value"), "event_type": F.col("event_type")}, {"value"})
    speed = values.typed(F.when(e % 5 == 0, "0").otherwise((e % 5).cast("string")))
    fields = F.map_concat(fields, F.create_map(F.lit("speed"), speed))
    id_ = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return df.select(
        e.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), command.alias("command"), F.lit("fleet").alias("key"), id_.alias("id"),
        *src.point_geometry(lat, lon), F.when(command != "del", fields).alias("fields"),
    )


LOG_SQL = f"""log AS (
  SELECT event_id AS seq, CASE WHEN event_id % 10 = 9 THEN 'del' WHEN event_id % 7 = 3 THEN 'fset' ELSE 'set' END AS command,
    'u' || user_id AS id, {LAT} AS lat, {LON} AS lon, value, event_type, event_id % 5 AS speed FROM events)"""

#: Lives of an id: a new one begins after each delete; only changes from its first set on count.
LIVES_SQL = """
e AS (SELECT *, coalesce(sum(CASE WHEN prev = 'del' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seq), 0) AS epoch
      FROM (SELECT *, lag(command) OVER (PARTITION BY id ORDER BY seq) AS prev FROM log)),
l AS (SELECT id, max(epoch) AS epoch, arg_max(command, seq) AS final FROM e GROUP BY id),
b AS (SELECT e.*, min(CASE WHEN command = 'set' THEN seq END) OVER (PARTITION BY e.id, e.epoch ORDER BY seq) AS born
      FROM e JOIN l ON e.id = l.id AND e.epoch = l.epoch WHERE l.final <> 'del'),
live AS (SELECT * FROM b WHERE seq >= born)"""

HAVERSINE = (
    "12742000 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians({lat})) / 2), 2) + "
    "pow(sin((radians(lon) - radians({lon})) / 2), 2) * cos(radians(lat)) * cos(radians({lat})))))"
)


def _meters(lat: float, lon: float) -> str:
    return HAVERSINE.format(lat=lat, lon=lon)


def _run(spec: Search, objects: DataFrame) -> DataFrame:
    spec.points_only = True
    return ops.compile(spec, objects).df


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Scans and value searches.


def _scan(**kw) -> Query:
    return lambda spark, sf: _run(Search("scan", "fleet", limit=S.UNLIMITED, **kw), fleet(spark, sf)).select("id")


query("scan_match", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE regexp_full_match(id, 'e[1-3].*7')")(_scan(match=["e[1-3]*7"]))
query("scan_match_prefix", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE starts_with(id, 'e12') OR id = 'e7'")(_scan(match=["e12*", "e7"]))
query("scan_where_range", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE value > 10 AND value <= 20")(_scan(where=[Where("range", "value", ("(10", "20"))]))
query("scan_where_op", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE event_type <> 'click' AND value >= 15")(
    _scan(where=[Where("op", "event_type", ("!=", "CLICK")), Where("op", "value", (">=", "15"))])
)
query("scan_wherein", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE event_type IN ('view', 'error')")(_scan(where=[Where("in", "event_type", ("View", "error", "3"))]))
query("scan_where_expr", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE (event_type = 'view' AND value < 5) OR regexp_matches(event_type, 'pur.*') AND value / 2 > 10")(
    _scan(where=[Where("expr", "event_type == 'View' && value < 5 || event_type =~ 'pur.*' && value / 2 > 10")])
)
query("scan_json_field", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE CAST(json_extract(props, '$.k') AS DOUBLE) BETWEEN 10 AND 19")(_scan(where=[Where("range", "props.k", ("10", "19"))]))
query("field_default_zero", f"WITH {FLEET_SQL} SELECT id FROM fleet")(_scan(where=[Where("range", "no_such_field", ("0", "0"))]))


@query("scan_whereeval", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE value > 18")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from .scripts import Scripts

    def fast(id_, fields, properties, args):
        return fields["value"] > float(args[0])

    scripts = Scripts()
    scripts.load(fast)
    ship(spark)
    return _run(Search("scan", "fleet", limit=S.UNLIMITED, whereeval=[scripts.predicate("fast", ["18"])]), fleet(spark, sf)).select("id")


@query("scan_cursor", f"""WITH {FLEET_SQL}, r AS (SELECT id, value, row_number() OVER (ORDER BY id) AS n FROM fleet)
SELECT id FROM r WHERE n > 200 AND value >= 10 ORDER BY n LIMIT 50""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    spec = Search("scan", "fleet", cursor=200, limit=50, where=[Where("op", "value", (">=", "10"))])
    return _run(spec, fleet(spark, sf)).select("id")


query("scan_desc", f"WITH {FLEET_SQL} SELECT id FROM fleet ORDER BY id DESC LIMIT 25")(
    lambda spark, sf: _run(Search("scan", "fleet", desc=True, limit=25), fleet(spark, sf)).select("id")
)


@query("scan_count", f"WITH {FLEET_SQL} SELECT count(*) AS n FROM fleet WHERE event_type = 'signup'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    spec = Search("scan", "fleet", output="count", where=[Where("op", "event_type", ("==", "signup"))])
    return _run(spec, fleet(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@query("search_values", "SELECT CAST(doc_id AS VARCHAR) AS id, source AS value FROM documents ORDER BY source, CAST(doc_id AS VARCHAR) LIMIT 100")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _run(Search("search", "docs"), strings(spark, sf)).select("id", "value")


@query("search_match", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE regexp_full_match(source, 'src1[0-4]') AND n_chars > 1000")
def _(spark: SparkSession, sf: str) -> DataFrame:
    spec = Search("search", "docs", match=["src1[0-4]"], limit=S.UNLIMITED, where=[Where("op", "n_chars", (">", "1000"))])
    return _run(spec, strings(spark, sf)).select("id")


# Nearest.


@query("nearby_knn", f"WITH {FLEET_SQL} SELECT id, round({_meters(20, 20)}, 3) AS meters FROM fleet ORDER BY {_meters(20, 20)}, id LIMIT 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _run(Search("nearby", "fleet", limit=10, area=S.point(20, 20)), fleet(spark, sf))
    return rows.select("id", F.round("distance", 3).alias("meters"))


@query("nearby_radius", f"WITH {FLEET_SQL} SELECT id, round({_meters(33.5, -112.25)}, 3) AS meters FROM fleet WHERE {_meters(33.5, -112.25)} <= 1500000")
def _(spark: SparkSession, sf: str) -> DataFrame:
    spec = Search("nearby", "fleet", limit=S.UNLIMITED, area=S.circle(33.5, -112.25, 1500000), radius=1500000)
    return _run(spec, fleet(spark, sf)).select("id", F.round("distance", 3).alias("meters"))


@query("nearest_join", f"""WITH {FLEET_SQL}, q AS (SELECT n_nationkey AS qid, n_nationkey * 3.0 - 30 AS qlat, n_nationkey * 11.0 - 130 AS qlon FROM nation),
d AS (SELECT qid, id, {HAVERSINE.format(lat='qlat', lon='qlon')} AS m FROM q, fleet),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m, id) AS rank FROM d)
SELECT qid, id, round(m, 3) AS meters, rank FROM r WHERE rank <= 5""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    q = spark.read.parquet(f"{sf}/nation.parquet").select(n.alias("qid"), (n * 3.0 - 30).alias("lat"), (n * 11.0 - 130).alias("lon"))
    found = roam.nearest_join(q, fleet(spark, sf), 5)
    return found.select("qid", "id", F.round("distance", 3).alias("meters"), F.col("rank").cast("long").alias("rank"))


# Areas.


def _area(cmd: str, area: Callable[[], S.Area], **kw) -> Query:
    return lambda spark, sf: _run(Search(cmd, "fleet", area=area(), limit=S.UNLIMITED, **kw), fleet(spark, sf)).select("id")


def _in(b: tuple[float, float, float, float]) -> str:
    return f"lat BETWEEN {b[0]!r} AND {b[2]!r} AND lon BETWEEN {b[1]!r} AND {b[3]!r}"


def _box_sql(b: tuple[float, float, float, float]) -> str:
    return f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE {_in(b)}"


BOX = (10.0, -60.0, 45.5, 30.25)
query("within_bounds", _box_sql(BOX))(_area("within", lambda: S.bounds(*BOX)))
query("intersects_bounds", _box_sql(BOX))(_area("intersects", lambda: S.bounds(*BOX)))
query("within_circle", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE {_meters(0, 100)} <= 2000000")(_area("within", lambda: S.circle(0, 100, 2000000)))
query("within_tile", _box_sql((0.0, 45.0, 40.97989806962013, 90.0)))(_area("within", lambda: S.tile(5, 3, 3)))
query("within_quadkey", _box_sql(geo.tile_bounds(*geo.quadkey_tile("12"))))(_area("within", lambda: S.quadkey("12")))
query("within_hash", _box_sql(geo.geohash_bounds("9")))(_area("within", lambda: S.geohash("9")))
query("within_mvt_margin", _box_sql(geo.margin_bounds(2, 1, 2)))(_area("within", lambda: S.mvt(2, 1, 2)))
query("clipby", _box_sql((20.0, -40.0, 45.5, 30.25)))(_area("within", lambda: S.clipped(S.bounds(*BOX), S.bounds(20, -40, 80, 60))))

TRIANGLE = {"type": "Polygon", "coordinates": [[[-100.05, -20.05], [50.05, -10.05], [0.05, 70.05], [-100.05, -20.05]]]}


def _half_planes(ring: list) -> str:
    sides = []
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        sides.append(f"({bx!r} - ({ax!r})) * (lat - ({ay!r})) - ({by!r} - ({ay!r})) * (lon - ({ax!r})) >= 0")
    return " AND ".join(sides)


query("intersects_polygon", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE {_half_planes(TRIANGLE['coordinates'][0])}")(
    _area("intersects", lambda: S.geojson(TRIANGLE))
)
HOLED = {"type": "Polygon", "coordinates": [TRIANGLE["coordinates"][0], [[-20.05, 0.05], [10.05, 0.05], [10.05, 20.05], [-20.05, 20.05], [-20.05, 0.05]]]}
query("within_polygon_hole", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE {_half_planes(TRIANGLE['coordinates'][0])} AND NOT (lat > 0.05 AND lat < 20.05 AND lon > -20.05 AND lon < 10.05)")(
    _area("within", lambda: S.geojson(HOLED))
)


def _convex_sql(area: S.Area) -> str:
    """Points in any of an area's parts, each of them convex."""
    tests = []
    for _, rings in area.parts:
        ring = rings[0]
        turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
        tests.append(f"({_half_planes(ring if turn > 0 else ring[::-1])})")
    return f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE {' OR '.join(tests)}"


SECTOR = S.sector(10, 20, 3000000, 30, 120)
WAY = S.buffered(S.geojson({"type": "LineString", "coordinates": [[-100, 10], [-20, 40], [60, 30]]}), 300000)
query("within_sector", _convex_sql(SECTOR))(_area("within", lambda: SECTOR))
query("intersects_buffer", _convex_sql(WAY))(_area("intersects", lambda: WAY))


@query("area_get", f"""WITH {FLEET_SQL}, c AS (SELECT lat AS clat, lon AS clon FROM fleet WHERE id = 'e17') SELECT id FROM fleet, c WHERE lat = clat AND lon = clon""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    objects = fleet(spark, sf)
    row = kv.get(objects, "fleet", "e17").select("geojson").first()
    return _run(Search("within", "fleet", area=S.geojson(row.geojson), limit=S.UNLIMITED), objects).select("id")


@query("area_expr", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE ({_in(BOX)}) AND NOT ({_meters(20, -20)} <= 1000000) OR ({_in((-30.0, 100.0, -10.0, 140.0))})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    a, b, c = (ops.point_test(x) for x in (S.bounds(*BOX), S.circle(20, -20, 1000000), S.bounds(-30, 100, -10, 140)))
    return fleet(spark, sf).filter((a & ~b) | c).select("id")


@query("intersects_where_match", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE {_in(BOX)} AND event_type = 'view' AND regexp_full_match(id, '.*5')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    spec = Search("intersects", "fleet", area=S.bounds(*BOX), limit=S.UNLIMITED, match=["*5"], where=[Where("op", "event_type", ("==", "view"))])
    return _run(spec, fleet(spark, sf)).select("id")


@query("sparse", f"""WITH {FLEET_SQL}, c AS (SELECT id, least(7, floor((lon + 180) / 360 * 8)) AS cx, least(7, floor((lat + 90) / 180 * 8)) AS cy FROM fleet
WHERE lat BETWEEN -90 AND 90) SELECT min(id) AS id FROM c GROUP BY cx, cy""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _run(Search("within", "fleet", area=S.bounds(-90, -180, 90, 180), sparse=3), fleet(spark, sf)).select("id")


@query("clip_output", f"WITH {FLEET_SQL} SELECT id, 'Point' AS gtype, lon, lat FROM fleet WHERE {_in(BOX)}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A clipped point is the point; lines and rings are in the tests."""
    spec = Search("intersects", "fleet", area=S.bounds(*BOX), clip=True, limit=S.UNLIMITED)
    ship(spark)
    at = [F.get_json_object("geojson", p) for p in ("$.type", "$.coordinates[0]", "$.coordinates[1]")]
    return ops.compile(spec, fleet(spark, sf)).df.select("id", at[0].alias("gtype"), at[1].cast("double").alias("lon"), at[2].cast("double").alias("lat"))


# Outputs.


@query("geohash_out", "SELECT 'e' || event_id AS id, " + " || ".join(
    f"substr('{geo.GEOHASH}', 1 + CAST(" + " + ".join(
        (f"((CAST(floor(({LON} + 180) / 360 * {1 << 18}) AS BIGINT) >> {17 - at // 2}) & 1) * {16 >> b}" if at % 2 == 0
         else f"((CAST(floor(({LAT} + 90) / 180 * {1 << 17}) AS BIGINT) >> {16 - at // 2}) & 1) * {16 >> b}")
        for b in range(5) for at in [5 * i + b]) + " AS INTEGER), 1)" for i in range(7)) + " AS hash FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fleet(spark, sf).select("id", geo.geohash_column(F.col("y"), F.col("x"), 7).alias("hash"))


_X = f"least(2047, greatest(0, floor((({LON}) + 180) / 360 * 2048 + 0.5)))::BIGINT"
_SIN = f"sin(radians(greatest(-85.05112878, least(85.05112878, {LAT}))))"
_Y = f"least(2047, greatest(0, floor((0.5 - ln((1 + {_SIN}) / (1 - {_SIN})) / (4 * pi())) * 2048 + 0.5)))::BIGINT"


@query("tile_counts", f"SELECT ({_X}) >> 8 AS tx, ({_Y}) >> 8 AS ty, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    tx, ty = geo.tile_columns(F.col("y"), F.col("x"), 3)
    return fleet(spark, sf).groupBy(tx.alias("tx"), ty.alias("ty")).agg(F.count(F.lit(1)).alias("n"))


@query("quadkey_out", "SELECT 'e' || event_id AS id, " + " || ".join(f"CAST(((({_X}) >> {8 + i}) & 1) + 2 * ((({_Y}) >> {8 + i}) & 1) AS VARCHAR)" for i in (2, 1, 0)) + " AS quadkey FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fleet(spark, sf).select("id", geo.quadkey_column(F.col("y"), F.col("x"), 3).alias("quadkey"))


@query("points_out", f"WITH {FLEET_SQL} SELECT id, lat, lon FROM fleet")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _run(Search("scan", "fleet", limit=S.UNLIMITED, output="points"), fleet(spark, sf)).select("id", F.col("y").alias("lat"), F.col("x").alias("lon"))


@query("fields_aligned", f"WITH {FLEET_SQL} SELECT id, event_type, value FROM fleet")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """All rows beside the header that the data has; a missing value is the number 0 there."""
    found = ops.compile(Search("scan", "fleet", limit=S.UNLIMITED), fleet(spark, sf))
    header = found.header()
    at = {n: F.col("fields")[header.index(n)] for n in ("event_type", "value")}
    return found.aligned(header).select("id", F.replace(at["event_type"], F.lit('"'), F.lit("")).alias("event_type"), at["value"].cast("double").alias("value"))


@query("json_get", "SELECT 'e' || event_id AS id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), jsonpath.get_column(F.col("props"), "k").alias("k"))


@query("json_set", """SELECT 'e' || event_id AS id, '{"k":' || json_extract_string(props, '$.k') || ',"tag":"x"}' AS props FROM events""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return events(spark, sf).select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), jsonpath.put_column(F.col("props"), "tag", "x").alias("props"))


@query("json_del", "SELECT 'e' || event_id AS id, '{}' AS props FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return events(spark, sf).select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), jsonpath.remove_column(F.col("props"), "k").alias("props"))


# Aggregates.


@query("bounds_agg", f"WITH {FLEET_SQL} SELECT min(lat) AS minlat, min(lon) AS minlon, max(lat) AS maxlat, max(lon) AS maxlon FROM fleet")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ops.area_bounds(fleet(spark, sf), "fleet")


@query("stats", """SELECT 'docs' AS key, count(*) AS num_objects, count(*) AS num_strings, 0::BIGINT AS num_points FROM documents
UNION ALL SELECT 'fleet', count(*), 0, count(*) FROM events""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    both = fleet(spark, sf).unionByName(strings(spark, sf))
    return kv.stats(both).drop("in_memory_size")


@query("stats_weight", "SELECT 'docs' AS key, CAST(sum(length(CAST(doc_id AS VARCHAR)) + length(source) + CASE WHEN n_chars = 0 THEN 0 ELSE 7 + 8 + length(CAST(n_chars AS VARCHAR)) END) AS BIGINT) AS in_memory_size FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return kv.stats(strings(spark, sf)).select("key", "in_memory_size")


@query("server_totals", "SELECT 2::BIGINT AS num_collections, (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) AS num_objects, (SELECT count(*) FROM documents) AS num_strings")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return kv.server(fleet(spark, sf).unionByName(strings(spark, sf))).select("num_collections", "num_objects", "num_strings")


@query("metrics", """SELECT 'collection_' || g AS metric, key, CASE WHEN (key = 'docs' AND g = 'num_points') OR (key = 'fleet' AND g = 'num_strings') THEN 0
ELSE n END::DOUBLE AS value FROM (SELECT 'docs' AS key, count(*) AS n FROM documents UNION ALL SELECT 'fleet', count(*) FROM events),
(VALUES ('num_objects'), ('num_strings'), ('num_points')) v(g)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The gauges that count; stats_weight holds the bytes."""
    return kv.metrics(fleet(spark, sf).unionByName(strings(spark, sf))).filter("metric <> 'collection_in_memory_size'")


@query("keys_glob", "SELECT DISTINCT event_type AS key FROM events WHERE regexp_full_match(event_type, '.*e.*')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return kv.keys(fleet(spark, sf).withColumn("key", F.col("fields")["event_type"]["data"]), "*e*")


# Key and id writes.


@query("fold_geometry", f"""WITH {LOG_SQL}, {LIVES_SQL}
SELECT id, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon FROM live WHERE command = 'set' GROUP BY id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return kv.fold(log(spark, sf)).select("id", F.col("y").alias("lat"), F.col("x").alias("lon"))


@query("fold_fields", f"""WITH {LOG_SQL}, {LIVES_SQL}
SELECT id, arg_max(event_type, seq) AS event_type, arg_max(speed, seq)::DOUBLE AS speed FROM live GROUP BY id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = kv.fold(log(spark, sf))
    return rows.select("id", values.field("event_type")["data"].alias("event_type"), values.field("speed")["num"].alias("speed"))


@query("fold_pdel_drop", f"""WITH {LOG_SQL}, m AS (SELECT max(seq) AS top FROM log), {LIVES_SQL.replace('FROM log)', 'FROM cut)').replace('e AS', '''
cut AS (SELECT seq, command, id, lat, lon, value, event_type, speed FROM log UNION ALL
        SELECT DISTINCT m.top // 2 + 0.5, 'del', id, NULL, NULL, NULL, NULL, NULL FROM log, m WHERE starts_with(id, 'u1') AND seq < m.top // 2 + 0.5),
e AS''', 1)}
SELECT id, arg_max(lat, seq) AS lat FROM live WHERE command = 'set' GROUP BY id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The log with a glob delete halfway; sequence numbers are doubled to make room for it."""
    rows = log(spark, sf)
    half = rows.agg(F.max("seq")).first()[0] // 2
    wide = spark.createDataFrame([(2 * half + 1, "pdel", "fleet", kv.glob_regex("u1*"))], "seq long, command string, key string, pattern string")
    wide = wide.withColumn("ts", F.current_timestamp())
    out = rows.withColumn("seq", F.col("seq") * 2).unionByName(wide, allowMissingColumns=True)
    return kv.fold(out).select("id", F.col("y").alias("lat"))


@query("fold_rename", f"""WITH {LOG_SQL}, m AS (SELECT max(seq) AS top FROM log), {LIVES_SQL.replace('FROM log)', 'FROM cut)').replace('e AS', '''
cut AS (SELECT seq, command, CASE WHEN seq <= m.top // 2 THEN 'ships/' ELSE 'fleet/' END || id AS id, lat, lon, value, event_type, speed FROM log, m),
e AS''', 1)}
SELECT id, arg_max(lat, seq) AS lat FROM live WHERE command = 'set' GROUP BY id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The log with a rename halfway; what follows under the old name begins anew."""
    rows = log(spark, sf)
    half = rows.agg(F.max("seq")).first()[0] // 2
    move = spark.createDataFrame([(2 * half + 1, "rename", "fleet", "ships")], "seq long, command string, key string, new_key string")
    out = rows.withColumn("seq", F.col("seq") * 2).unionByName(move.withColumn("ts", F.current_timestamp()), allowMissingColumns=True)
    return kv.fold(out).select(F.concat_ws("/", "key", "id").alias("id"), F.col("y").alias("lat"))


@query("fold_json", """SELECT 'e' || event_id AS id, CASE WHEN event_id % 2 = 0 THEN '{"tag":"x"}' ELSE '{"k":' || json_extract_string(props, '$.k') || ',"tag":"x"}' END AS value FROM events""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Strings set, then edited: a member is put in each, another one taken from every second."""
    e = events(spark, sf)
    base = e.select(
        (F.col("event_id") * 3).alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.lit("docs").alias("key"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.lit("set").alias("command"), *src.string_geometry(F.col("props")),
        F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("new_key"),
    )
    nowhere = [F.lit(None).cast(base.schema[n].dataType).alias(n) for n in GEOMETRY_NAMES if n != "value"]

    def edit(rows: DataFrame, n: int, command: str, path: str, value: str | None) -> DataFrame:
        own = [(F.col("seq") + n).alias("seq"), "ts", "key", "id", F.lit(command).alias("command"), F.lit(path).alias("pattern"), F.lit(value).cast("string").alias("value")]
        return rows.select(*own, *nowhere, F.lit(None).cast("string").alias("new_key"))

    rows = base.unionByName(edit(base, 1, "jset", "tag", "x")).unionByName(edit(base.filter(F.substring("id", 2, 20).cast("long") % 2 == 0), 2, "jdel", "k", None))
    return kv.fold(rows).select("id", "value")


@query("upsert_latest", f"WITH {FLEET_SQL} SELECT 'u' || user_id AS id, arg_max(lat, event_id) AS lat FROM fleet GROUP BY user_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    last = log(spark, sf).filter("command != 'x'").withColumn("command", F.lit("set"))
    return kv.fold(last).select("id", F.col("y").alias("lat"))


@query("set_merge", f"""WITH {FLEET_SQL} SELECT id, event_type, CASE WHEN event_id % 3 = 0 THEN 7.5 ELSE value END AS value,
CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS extra FROM fleet""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    old = fleet(spark, sf)
    new = old.filter(F.substring("id", 2, 20).cast("long") % 3 == 0).withColumn("fields", values.field_map({"value": F.lit("7.5"), "extra": F.lit("1")}))
    out = kv.upsert(old, new)
    return out.select("id", values.field("event_type")["data"].alias("event_type"), values.field("value")["num"].alias("value"), values.field("extra")["num"].alias("extra"))


@query("fset_counts", f"WITH {FLEET_SQL} SELECT id, CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS n FROM fleet")
def _(spark: SparkSession, sf: str) -> DataFrame:
    old = fleet(spark, sf)
    new = old.select("key", "id", F.create_map(F.lit("event_type"), values.parse("view").column(), F.lit("n"), values.parse("1").column()).alias("fields"))
    _, counts = kv.fset(old, new)
    return counts.select("id", "n")


@query("pdel", f"WITH {FLEET_SQL} SELECT id FROM fleet WHERE NOT regexp_full_match(id, 'e.*[02468]')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return kv.pdel(fleet(spark, sf), "fleet", "e*[02468]").select("id")


@query("rename", "SELECT 'ships' AS key, count(*) AS n FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return kv.rename(fleet(spark, sf), "fleet", "ships").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("expire_filter", "SELECT 'e' || event_id AS id FROM events WHERE ts + to_seconds(86400 * 10) > TIMESTAMP '2024-01-20 00:00:00'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    ends = fleet(spark, sf).drop("expires_at").join(e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("ts")), "id")
    ends = ends.withColumn("expires_at", F.timestamp_seconds(F.col("ts").cast("double") + 864000))
    return ops.alive(ends, F.to_timestamp(F.lit("2024-01-20 00:00:00"))).select("id")


@query("ttl", "SELECT 'e' || event_id AS id, CASE WHEN event_id % 2 = 0 THEN -1.0 ELSE (event_id % 1000 + 1)::DOUBLE END AS ttl FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    now = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    n = F.substring("id", 2, 20).cast("long")
    rows = fleet(spark, sf).withColumn("expires_at", F.when(n % 2 == 1, F.timestamp_seconds(now.cast("long") + n % 1000 + 1)))
    return kv.ttl(rows, now).select("id", "ttl")


@query("exists", "SELECT 'e42' AS id, count(*) > 0 AS found, count(*) > 0 AS has_value FROM events WHERE event_id = 42 UNION ALL SELECT 'none', false, false")
def _(spark: SparkSession, sf: str) -> DataFrame:
    objects, out = fleet(spark, sf), None
    for id_ in ("e42", "none"):
        field = kv.fexists(objects, "fleet", id_, "value").agg(F.coalesce(F.max("exists"), F.lit(False)).alias("has_value"))
        row = kv.exists(objects, "fleet", id_).select(F.lit(id_).alias("id"), F.col("exists").alias("found"), F.lit(1).alias("_j"))
        row = row.join(field.withColumn("_j", F.lit(1)), "_j").drop("_j")
        out = row if out is None else out.unionByName(row)
    return out


@query("get_object", f"WITH {FLEET_SQL} SELECT id, lat, lon, event_type FROM fleet WHERE id = 'e42'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return kv.get(fleet(spark, sf), "fleet", "e42").select("id", F.col("y").alias("lat"), F.col("x").alias("lon"), values.field("event_type")["data"].alias("event_type"))


@query("compact_log", f"""WITH {LOG_SQL}, {LIVES_SQL} SELECT count(DISTINCT id) AS n FROM live""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return kv.fold(kv.compact(log(spark, sf))).agg(F.count(F.lit(1)).alias("n"))


@query("log_checksum")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf)
    return kv.checksum(rows, 0, rows.agg(F.max("seq")).first()[0] or 0)


# Fences.

FENCE = (-40.0, -120.0, 40.0, 60.0)
_IN = f"lat BETWEEN {FENCE[0]} AND {FENCE[2]} AND lon BETWEEN {FENCE[1]} AND {FENCE[3]}"
#: Old and new state of each change; an fset has no old version, and a deleted one hands nothing on.
_FENCE_SQL = f"""{LOG_SQL},
v AS (SELECT *, {_IN} AS now, lag(CASE WHEN command <> 'del' THEN {_IN} END) OVER (PARTITION BY id ORDER BY seq) AS was FROM log),
d AS (SELECT *, CASE WHEN command = 'del' THEN 'del' WHEN command = 'set' AND coalesce(was, false) AND now THEN 'inside'
  WHEN command = 'set' AND coalesce(was, false) THEN 'exit' WHEN now AND command = 'fset' THEN 'inside' WHEN now THEN 'enter' ELSE 'outside' END AS found FROM v)"""


#: Where the way between two outside versions enters and leaves the box, as shares of the way.
_CROSS_SQL = f"""{_FENCE_SQL},
o AS (SELECT *, lag(CASE WHEN command <> 'del' THEN lat END) OVER w AS olat, lag(CASE WHEN command <> 'del' THEN lon END) OVER w AS olon
      FROM d WINDOW w AS (PARTITION BY id ORDER BY seq)),
t AS (SELECT *, ({FENCE[0]} - olat) / nullif(lat - olat, 0) AS a, ({FENCE[2]} - olat) / nullif(lat - olat, 0) AS b,
        ({FENCE[1]} - olon) / nullif(lon - olon, 0) AS c, ({FENCE[3]} - olon) / nullif(lon - olon, 0) AS e FROM o),
x AS (SELECT *, CASE WHEN found = 'outside' AND command = 'set' AND olat IS NOT NULL
        AND greatest(0.0, least(a, b), least(c, e)) <= least(1.0, greatest(a, b), greatest(c, e)) THEN 'cross' ELSE found END AS last FROM t)"""


def _fence(**kw) -> fences.Fence:
    return fences.Fence("box", "fleet", S.bounds(*FENCE), **kw)


@query("fence_enter_exit", f"WITH {_FENCE_SQL} SELECT seq, id, found AS detect FROM d WHERE found IN ('enter', 'exit')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return fences.events(log(spark, sf), [_fence(detect=["enter", "exit"])], True).filter("detect is not null").select("seq", "id", "detect")


@query("fence_detect_downgrade", f"WITH {_FENCE_SQL} SELECT seq, id, CASE WHEN found IN ('inside', 'enter') THEN 'inside' ELSE 'outside' END AS detect FROM d WHERE found <> 'del'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return fences.events(log(spark, sf), [_fence(detect=["inside", "outside"])], True).filter("detect is not null").select("seq", "id", "detect")


@query("fence_commands", f"WITH {_FENCE_SQL} SELECT seq, id, command FROM d WHERE command IN ('del', 'fset') AND found IN ('del', 'inside')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return fences.events(log(spark, sf), [_fence(detect=["inside"], commands=["del", "fset"])], True).select("seq", "id", "command")


@query("fence_all_events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    two = [_fence(), fences.Fence("round", "fleet", S.circle(10, 10, 4000000), where=[Where("op", "value", (">", "5"))])]
    return fences.events(log(spark, sf), two, True).select("seq", "hook", "id", "rank", "detect", "group")


@query("fence_cross", f"WITH {_CROSS_SQL} SELECT seq, id, last AS detect FROM x WHERE last = 'cross'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return fences.events(log(spark, sf), [_fence(detect=["cross"])], True).filter("detect = 'cross'").select("seq", "id", "detect")


#: Sixty boxes of three sizes, spread over the map.
_HOOKS = [(f"h{i}", -80.0 + (i * 37) % 140, -175.0 + (i * 101) % 310, (0.2, 5.0, 30.0)[i % 3]) for i in range(60)]


@query("fence_hooks", f"""WITH {LOG_SQL}, h(hook, a, b, n) AS (VALUES {", ".join(f"('{h}', {a}, {b}, {n})" for h, a, b, n in _HOOKS)}),
v AS (SELECT *, lat BETWEEN a AND a + n AND lon BETWEEN b AND b + n AS now FROM log, h),
w AS (SELECT *, coalesce(lag(CASE WHEN command <> 'del' THEN now END) OVER (PARTITION BY hook, id ORDER BY seq), false) AS was FROM v)
SELECT seq, hook, id, command, CASE WHEN command = 'del' THEN NULL WHEN now THEN 'enter' ELSE 'exit' END AS detect FROM w
WHERE (command = 'del' AND (now OR was)) OR (command = 'set' AND now <> was)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    many = [fences.Fence(h, "fleet", S.bounds(a, b, a + n, b + n), detect=["enter", "exit"]) for h, a, b, n in _HOOKS]
    return fences.hook_events(log(spark, sf), many, True).select("seq", "hook", "id", "command", "detect")


@query("fence_stream_replay", f"""WITH {_CROSS_SQL} SELECT seq, 'box' AS hook, id, 0 AS rank, CASE WHEN last <> 'del' THEN last END AS detect FROM x
UNION ALL SELECT seq, 'box', id, 1, CASE last WHEN 'enter' THEN 'inside' ELSE 'outside' END FROM x WHERE last IN ('enter', 'exit', 'cross')""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stream.stream_events(log(spark, sf), [_fence()], True).select("seq", "hook", "id", "rank", "detect")


_GRID_SQL = "f AS (SELECT 's' || s_suppkey AS hook, ((s_suppkey * 37) % 170)::DOUBLE - 85 AS a, ((s_suppkey * 101) % 350)::DOUBLE - 175 AS b FROM supplier)"


@query("fence_join_many", f"WITH {FLEET_SQL}, {_GRID_SQL} SELECT hook, id FROM fleet JOIN f ON lat BETWEEN a AND a + 2.5 AND lon BETWEEN b AND b + 2.5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    a, b = F.pmod(s * 37, F.lit(170)).cast("double") - 85, F.pmod(s * 101, F.lit(350)).cast("double") - 175
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.concat(F.lit("s"), s.cast("string")).alias("hook"), F.lit("fleet").alias("fence_key"), b.alias("fminx"), a.alias("fminy"),
        (b + 2.5).alias("fmaxx"), (a + 2.5).alias("fmaxy"), *[F.lit(None).cast("double").alias(n) for n in ("flat", "flon", "fmeters")],
    )
    return fences.join_many(fleet(spark, sf), rows).select("hook", "id")


# Roaming: all users move among each other.

_ROAM_SQL = f"""{LOG_SQL},
w AS (SELECT *, lead(seq) OVER (PARTITION BY id ORDER BY seq) AS until, lag(command) OVER (PARTITION BY id ORDER BY seq) AS prev,
        lag(lat) OVER (PARTITION BY id ORDER BY seq) AS olat, lag(lon) OVER (PARTITION BY id ORDER BY seq) AS olon FROM log WHERE command <> 'fset'),
m AS (SELECT a.seq, a.id, b.id AS other, b.lat, b.lon, a.lat AS alat, a.lon AS alon,
  b.lat BETWEEN a.lat - degrees(1500000 / 6371000.0) AND a.lat + degrees(1500000 / 6371000.0) AND
  b.lon BETWEEN a.lon - degrees(asin(least(1.0, sin(1500000 / 6371000.0) / cos(radians(a.lat))))) AND a.lon + degrees(asin(least(1.0, sin(1500000 / 6371000.0) / cos(radians(a.lat))))) AS now,
  a.prev = 'set' AND b.lat BETWEEN a.olat - degrees(1500000 / 6371000.0) AND a.olat + degrees(1500000 / 6371000.0) AND
  b.lon BETWEEN a.olon - degrees(asin(least(1.0, sin(1500000 / 6371000.0) / cos(radians(a.olat))))) AND a.olon + degrees(asin(least(1.0, sin(1500000 / 6371000.0) / cos(radians(a.olat))))) AS was
  FROM w a JOIN w b ON a.command = 'set' AND b.command = 'set' AND a.id <> b.id AND b.seq < a.seq AND (b.until IS NULL OR b.until > a.seq)),
n AS (SELECT *, round({HAVERSINE.format(lat='alat', lon='alon')}, 1) AS meters FROM m)"""


def _roam(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return roam.roam(log(spark, sf), "fleet", "fleet", "*", 1500000, **kw)


def _tenths(m: Column) -> Column:
    """Metres of whole millimetres, rounded half up: what F.round does by way of decimal text, in whole numbers."""
    return F.floor((F.rint(m * 1000) + 50) / 100) / 10


@query("roam_nearby", f"WITH {_ROAM_SQL} SELECT seq, id, other, meters FROM n WHERE now")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _roam(spark, sf, kinds=["nearby"]).select("seq", "id", "other", _tenths(F.col("meters")).alias("meters"))


@query("roam_faraway", f"WITH {_ROAM_SQL} SELECT seq, id, other FROM n WHERE coalesce(was, false) AND NOT now")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _roam(spark, sf).filter("kind = 'faraway'").select("seq", "id", "other")


@query("roam_nodwell", f"WITH {_ROAM_SQL} SELECT seq, id, other FROM n WHERE now AND NOT coalesce(was, false)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _roam(spark, sf, nodwell=True, kinds=["nearby"]).select("seq", "id", "other")


# Tiles and generated objects.


@query("mvt_tile")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return mvt.tile(fleet(spark, sf), "fleet", 2, 1, 2).select("x", "y", "z", F.hex("mvt").alias("mvt"))


@query("mvt_tiles")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return mvt.tiles(fleet(spark, sf), "fleet", 2).select("x", "y", "z", "features", F.md5("mvt").alias("digest"))


@query("massinsert", "SELECT 'mi:' || (i % 3) AS key, count(*) AS n, sum(CASE WHEN (i // 3) % 8 = 7 THEN 1 ELSE 0 END)::BIGINT AS strings FROM range(300) t(i) GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.synthetic(spark, 3, 100)
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") == "string", 1)).alias("strings"))


@query("geojson_parse", f"WITH {FLEET_SQL} SELECT id, 'Point' AS gtype, lat, lon FROM fleet")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    rows = src.parse_geojson(fleet(spark, sf).select("id", F.col("geojson").alias("text")), "text", ["id"])
    return rows.select("id", "gtype", F.col("y").alias("lat"), F.col("x").alias("lon"))


@query("rect_distance")
def _(spark: SparkSession, sf: str) -> DataFrame:
    lat, lon = _coords(F.col("event_id"))
    boxes = src.objects(F.lit("boxes"), F.col("event_id"), src.bounds_geometry(lat, lon, lat + 0.5, lon + 0.5), events(spark, sf))
    spec = Search("nearby", "boxes", limit=20, area=S.point(20, 20))
    return ops.compile(spec, boxes).df.select("id", F.round("distance", 3).alias("meters"))


#: The area of a geometry kernel that SQL has no word for; the tests hold it against the goldens.
LINE = geometry.dumps({"type": "LineString", "coordinates": [[-100, 10], [-20, 40], [60, 30]]})


def _meets_sql(way: list) -> str:
    """Whether a box (lon, lat)-(lon + 5, lat + 5) meets a line: for one of its parts, the shares of the way inside in both directions overlap."""
    tests = []
    for (ax, ay), (bx, by) in zip(way, way[1:], strict=False):
        x, y = (f"({lo} - ({a!r})) / ({b - a!r})" for lo, a, b in (("lon", ax, bx), ("lat", ay, by)))
        x2, y2 = (f"({lo} + 5 - ({a!r})) / ({b - a!r})" for lo, a, b in (("lon", ax, bx), ("lat", ay, by)))
        tests.append(f"greatest(0.0, least({x}, {x2}), least({y}, {y2})) <= least(1.0, greatest({x}, {x2}), greatest({y}, {y2}))")
    return " OR ".join(f"({t})" for t in tests)


@query("shapes_intersect", f"WITH {FLEET_SQL} SELECT CAST(event_id AS VARCHAR) AS id FROM fleet WHERE {_meets_sql([(-100.0, 10.0), (-20.0, 40.0), (60.0, 30.0)])}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    lat, lon = _coords(F.col("event_id"))
    boxes = src.objects(F.lit("boxes"), F.col("event_id"), src.bounds_geometry(lat, lon, lat + 5, lon + 5), events(spark, sf))
    spec = Search("intersects", "boxes", limit=S.UNLIMITED, area=S.geojson(LINE))
    return ops.compile(spec, boxes).df.select(F.col("id").cast("string").alias("id"))
