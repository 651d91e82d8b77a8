"""The object table: points, boxes, GeoJSON geometries and strings, with typed fields, one row each.

An object's `key` names its collection and plays the part of a table name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, geometry, values
from ..plans.session import ship

GEOMETRY = (
    "kind string, gtype string, x double, y double, z double, minx double, miny double, maxx double, maxy double, "
    "geojson string, properties string, value string, npoints int, cell string"
)
OBJECT = f"key string, id string, {GEOMETRY}, fields {values.FIELDS}, expires_at timestamp"
#: Tile level of `cell`, the quadkey of an object's centre: tables are sorted and pruned by its prefixes.
CELL_LEVEL = 16

GEOMETRY_NAMES = [c.split()[0] for c in GEOMETRY.split(", ")]


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _number_text(c: Column) -> Column:
    """A coordinate as JSON writes it: whole numbers without a fraction."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))


def point_geometry(lat: Column, lon: Column, z: Column | None = None) -> list[Column]:
    """Geometry columns of points; z of 0 and no z are told apart by null."""
    lat, lon = lat.cast("double"), lon.cast("double")
    z = _null("double") if z is None else z.cast("double")
    text = F.concat(F.lit('{"type":"Point","coordinates":['), _number_text(lon), F.lit(","), _number_text(lat))
    text = F.concat(text, F.when(z.isNotNull(), F.concat(F.lit(","), _number_text(z))).otherwise(""), F.lit("]}"))
    cols = {
        "kind": F.lit("point"), "gtype": F.lit("Point"), "x": lon, "y": lat, "z": z, "minx": lon, "miny": lat, "maxx": lon,
        "maxy": lat, "geojson": text, "properties": _null("string"), "value": _null("string"), "npoints": F.lit(1),
        "cell": geo.quadkey_column(lat, lon, CELL_LEVEL),
    }
    return [cols[n].alias(n) for n in GEOMETRY_NAMES]


def string_geometry(text: Column) -> list[Column]:
    types = dict(c.split() for c in GEOMETRY.split(", "))
    cols = {n: _null(t) for n, t in types.items()} | {"kind": F.lit("string"), "value": text.cast("string"), "npoints": F.lit(0)}
    return [cols[n].alias(n) for n in GEOMETRY_NAMES]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [geometry_row(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        cols = [*batch.columns[:-1]]
        names = batch.schema.names[:-1]
        types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
        for i, spec in enumerate(GEOMETRY.split(", ")):
            name, kind = spec.split()
            cols.append(pa.array([r[i] for r in out], types[kind]))
            names.append(name)
        yield pa.RecordBatch.from_arrays(cols, names=names)


def geometry_row(text: str | dict | None) -> tuple:
    """The geometry columns of one GeoJSON text; a text that isn't GeoJSON gives all nulls."""
    try:
        g = geometry.load(text)
    except (geometry.BadGeometry, TypeError):
        return (None,) * len(GEOMETRY_NAMES)
    ps = geometry.parts(g)
    box, n = geometry.bbox(ps), len(geometry.points_of(ps))
    mid = geometry.center(ps)
    props = geometry.dumps(g["properties"]) if g["type"] == "Feature" and isinstance(g.get("properties"), dict) else None
    cell = geo.quadkey(*geo.tile_of(mid[1], mid[0], CELL_LEVEL), CELL_LEVEL) if mid else None
    own = g["geometry"] if g["type"] == "Feature" and g.get("geometry") else g
    z = None
    if own["type"] == "Point" and len(own["coordinates"]) > 2:
        z = float(own["coordinates"][2])
    kind = "point" if g["type"] == "Point" else "geojson"
    if g["type"] == "Feature" and "properties" not in g:
        g = {**g, "properties": {}}
    x, y = mid or (None, None)
    return (kind, g["type"], x, y, z, *(box or (None,) * 4), geometry.dumps(g), props, None, n, cell)


def parse_geojson(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns in `keep` and the geometry columns of a GeoJSON column."""
    ship(df.sparkSession)
    rows = df.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_parse, f"{fields}, {GEOMETRY}")


def bounds_geometry(minlat: Column, minlon: Column, maxlat: Column, maxlon: Column) -> list[Column]:
    """Geometry columns of boxes, which are written as polygons."""
    a, b, c, d = (x.cast("double") for x in (minlat, minlon, maxlat, maxlon))
    at = lambda x, y: F.concat(F.lit("["), _number_text(x), F.lit(","), _number_text(y), F.lit("]"))
    ring = F.concat_ws(",", at(b, a), at(d, a), at(d, c), at(b, c), at(b, a))
    cols = {
        "kind": F.lit("rect"), "gtype": F.lit("Polygon"), "x": (b + d) / 2, "y": (a + c) / 2, "z": _null("double"), "minx": b,
        "miny": a, "maxx": d, "maxy": c, "geojson": F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")),
        "properties": _null("string"), "value": _null("string"), "npoints": F.lit(5),
        "cell": geo.quadkey_column((a + c) / 2, (b + d) / 2, CELL_LEVEL),
    }
    return [cols[n].alias(n) for n in GEOMETRY_NAMES]


def objects(key: Column, id_: Column, geom: list[Column], df: DataFrame, fields: dict[str, Column] | None = None) -> DataFrame:
    """An object table from any table: which columns are key, id, geometry and fields."""
    kinds = dict(df.select(*[c.alias(n) for n, c in (fields or {}).items()]).dtypes) if fields else {}
    numeric = {n for n, k in kinds.items() if k in ("double", "float", "int", "bigint", "smallint", "tinyint")}
    own = values.field_map(fields, numeric) if fields else F.create_map().cast(values.FIELDS)
    return df.select(
        key.cast("string").alias("key"), id_.cast("string").alias("id"), *geom, own.alias("fields"), _null("timestamp").alias("expires_at")
    )


def synthetic(spark: SparkSession, collections: int, count: int, box: tuple = (-180.0, -90.0, 180.0, 90.0), fields: int = 13, seed: int = 1) -> DataFrame:
    """Random objects: points and, every eighth, strings, with many fields, half of them with an expiry of 5 to 29 s."""
    r = spark.range(collections * count).withColumn("key", F.concat(F.lit("mi:"), F.col("id") % collections))
    u = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(seed + k)), F.lit(1 << 40)) / float(1 << 40)
    lon, lat = u(0) * (box[2] - box[0]) + box[0], u(1) * (box[3] - box[1]) + box[1]
    is_text = F.floor(F.col("id") / collections) % 8 == 7
    point, text = point_geometry(lat, lon), string_geometry(F.concat(F.lit("str"), F.col("id")))
    names = GEOMETRY_NAMES
    geom = [F.when(is_text, t).otherwise(p).alias(n) for n, t, p in zip(names, text, point, strict=True)]
    own = values.field_map({f"field{i}": F.floor(u(10 + i) * 10) for i in range(fields)})
    ends = F.when(u(3) < 0.5, F.timestamp_seconds(F.unix_timestamp() + 5 + F.floor(u(4) * 25)))
    return r.select("key", F.concat(F.lit("id:"), F.col("id")).alias("id"), *geom, own.alias("fields"), ends.alias("expires_at"))


def by_cell(objects_: DataFrame, path: str, prefix: int = 4) -> None:
    """Store an object table for spatial pruning: a folder a key and coarse cell, files sorted by cell.

    Row groups then hold narrow ranges of cell and of the box columns, which the scan's statistics skip by.
    """
    out = objects_.withColumn("part", F.coalesce(F.substring("cell", 1, prefix), F.lit("none")))
    out.repartitionByRange("key", "part", "cell").sortWithinPartitions("key", "part", "cell").write.partitionBy("key", "part").parquet(path)
