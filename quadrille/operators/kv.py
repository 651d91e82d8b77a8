"""Key and id writes as a change log, its fold into the current objects, and point reads.

A change row is (seq, ts, command, key, id, geometry columns, fields, ex_seconds, pattern, new_key). `command` is one of
set, fset, del, pdel, drop, flushdb, expire, persist, rename, renamenx, jset, jdel. Order is `seq`, within everything. An
edit of JSON (jset, jdel) has its path in `pattern`, its new value in `value` and how that is meant (raw, str) in `new_key`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import geometry, globs, jsonpath, values
from ..plans.session import ship
from ..sources.objects import GEOMETRY, GEOMETRY_NAMES, geometry_row

CHANGE = (
    f"seq long, ts timestamp, command string, key string, id string, {GEOMETRY}, fields {values.FIELDS}, "
    "ex_seconds double, pattern string, new_key string"
)
CHANGE_NAMES = ["seq", "ts", "command", "key", "id", *GEOMETRY_NAMES, "fields", "ex_seconds", "pattern", "new_key"]


def _as_changes(df: DataFrame) -> DataFrame:
    """Add the columns that a narrower change table leaves out."""
    types = {}
    for part in CHANGE.replace(values.FIELDS, "FIELDS").split(", "):
        name, kind = part.split()
        types[name] = values.FIELDS if kind == "FIELDS" else kind
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(types[n]).alias(n) for n in CHANGE_NAMES])


def _removals(changes: DataFrame) -> DataFrame:
    """For each id, a `del` row for each drop, flush or pattern delete that reaches it.

    Whole-key commands are few next to changes: they are the small side, and ids are distinct per key before the join.
    """
    ids = changes.filter("id is not null").groupBy("key", "id").agg(F.min("seq").alias("first"))
    wide = changes.filter(F.col("command").isin("drop", "flushdb", "pdel")).select(
        F.col("seq").alias("at"), F.col("ts").alias("at_ts"), "command", F.col("key").alias("of"), F.col("pattern").alias("glob")
    )
    keyed = wide.filter("command != 'flushdb'")
    hit = ids.join(keyed, (F.col("key") == F.col("of")) & (F.col("first") < F.col("at")))
    # The pattern column holds a regular expression, made from the glob when the change was logged.
    hit = hit.filter((F.col("command") == "drop") | F.expr("id rlike glob"))
    out = hit.select("at", "at_ts", "key", "id")
    flushed = wide.filter("command = 'flushdb'").agg(F.max(F.struct("at", "at_ts")).alias("f")).select("f.*")
    out = out.unionByName(ids.join(F.broadcast(flushed), F.col("first") < F.col("at")).select("at", "at_ts", "key", "id"))
    return out.select(F.col("at").alias("seq"), F.col("at_ts").alias("ts"), F.lit("del").alias("command"), "key", "id")


def glob_regex(pattern: str) -> str:
    """What goes into a change's pattern column."""
    return globs.to_regex(pattern)


def _segments(renames: list[tuple[int, str, str]]) -> list[tuple[str, int, int, str | None]]:
    """(key, from, to, last name) of the parts of each renamed key's time; null where a rename onto the key ended what was there."""
    out = []
    for key in {k for r in renames for k in r[1:]}:
        start = -(1 << 62)
        for end in [*(s for s, a, b in renames if a != b and key in (a, b)), 1 << 62]:
            name: str | None = key
            for s, a, b in renames:
                if s >= end and a != b and name is not None:
                    name = b if name == a else None if name == b else name
            out.append((key, start, end, name))
            start = end
    return out


def _renamed(log: DataFrame) -> DataFrame:
    """The log with every change under the name that its collection has in the end.

    Renames are whole-key commands, few next to changes: they pass through the driver, and their parts of time are broadcast.
    What stood under the new name goes. A logged renamenx is one that took place.
    """
    found = log.filter(F.col("command").isin("rename", "renamenx")).select("seq", "key", "new_key").orderBy("seq").collect()
    parts = log.sparkSession.createDataFrame(_segments([tuple(r) for r in found]), "_of string, _lo long, _hi long, _name string")
    on = (F.col("key") == F.col("_of")) & (F.col("seq") > F.col("_lo")) & (F.col("seq") <= F.col("_hi"))
    moved = log.filter(~F.col("command").isin("rename", "renamenx")).join(F.broadcast(parts), on, "left")
    moved = moved.filter(F.col("_of").isNull() | F.col("_name").isNotNull())
    return moved.withColumn("key", F.coalesce("_name", "key")).select(*CHANGE_NAMES)


def _edited(row: dict, r: dict) -> dict:
    """An object's geometry columns after one change; an edit that fails changes nothing."""
    if r["command"] == "set":
        return {n: r[n] for n in GEOMETRY_NAMES}
    text = row["value"] if row["kind"] == "string" else row["geojson"]
    try:
        if r["command"] == "jset":
            new = jsonpath.put(text, r["pattern"], r["value"], r["new_key"])
        elif text is None or not (found := jsonpath.remove(text, r["pattern"]))[1]:
            return row
        else:
            new = found[0]
    except ValueError:
        return row
    try:
        return dict(zip(GEOMETRY_NAMES, geometry_row(geometry.load(new)), strict=True))
    except geometry.BadGeometry:
        string = dict.fromkeys(GEOMETRY_NAMES) | {"kind": "string", "value": new, "npoints": 0}
        return string if row["kind"] in (None, "string") else row


def _edits(schema: pa.Schema):
    """Objects from rows sorted by (key, id, seq); one object at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row, done = None, {}, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["key"], r["id"]) != at:
                    if at:
                        done.append({"key": at[0], "id": at[1], **row})
                    at, row = (r["key"], r["id"]), dict.fromkeys(GEOMETRY_NAMES)
                row = _edited(row, r)
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
        if at:
            yield pa.RecordBatch.from_pylist([{"key": at[0], "id": at[1], **row}], schema)

    return run


def fold(changes: DataFrame, now: Column | None = None) -> DataFrame:
    """The objects that a change log leaves.

    A set keeps earlier fields and replaces geometry and expiry; an fset of a missing id does nothing; an id that was
    deleted or has expired starts anew. A rename moves a collection, and what was under the new name goes. A jset of a
    missing id makes a string object; JSON edits are applied in order, those of one id since its last set in one task.

    Fields are combined by the last write of each field name in partial aggregation. Lives of an id (between deletes and
    expiries) are found in the order of its changes, so an id's changes pass through one task as a sorted stream.
    """
    now = F.current_timestamp() if now is None else now
    log = _as_changes(changes)
    rare = log.agg(*[F.coalesce(F.max(F.col("command").isin(*names)), F.lit(False)) for names in (("rename", "renamenx"), ("jset", "jdel"))]).first()
    if rare[0]:
        log = _renamed(log)
    direct = log.filter(F.col("command").isin("set", "fset", "del", "expire", "persist", "jset", "jdel"))
    log = direct.unionByName(_as_changes(_removals(log)))
    by = Window.partitionBy("key", "id").orderBy("seq")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("ts").cast("double") + F.col("ex_seconds")
    setter = F.when(F.col("command").isin("set", "expire"), F.struct(ends.alias("at")))
    setter = setter.when(F.col("command").isin("persist", "del"), F.struct(F.lit(None).cast("double").alias("at")))
    log = log.withColumn("_until", F.last(setter, ignorenulls=True).over(upto)["at"])
    log = log.withColumn("_dead", F.coalesce(F.lag("_until").over(by) <= F.col("ts").cast("double"), F.lit(False)))
    # An epoch is a life of the id: it ends at a delete, or at the first change after its expiry.
    ended = (F.lag("command").over(by) == "del") | F.col("_dead")
    log = log.withColumn("_epoch", F.sum(F.coalesce(ended, F.lit(False)).cast("int")).over(upto))
    makes = F.col("command").isin("set", "jset")
    log = log.withColumn("_born", F.min(F.when(makes, F.col("seq"))).over(Window.partitionBy("key", "id", "_epoch").orderBy("seq")))
    whole = Window.partitionBy("key", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    log = log.withColumns({
        "_last": F.max("_epoch").over(whole), "_final": F.last("command").over(whole), "_until": F.last("_until").over(whole),
    })
    lives = log.filter("_epoch = _last and _final != 'del' and seq >= _born")
    lives = lives.filter(F.col("_until").isNull() | (F.col("_until") > now.cast("double")))
    # Fields and geometry are items of one list, so that one pass finds the last write of each.
    geom, no_value = F.struct(*GEOMETRY_NAMES), F.lit(None).cast(values.TYPE)
    item = lambda name, v, g: F.struct(name.alias("name"), v.alias("v"), g.alias("g"))
    nowhere = F.when(F.lit(False), geom)
    items = F.transform(F.map_entries(F.coalesce("fields", F.create_map().cast(values.FIELDS))), lambda e: item(e["key"], e["value"], nowhere))
    place = F.array(item(F.lit(None).cast("string"), no_value, geom))
    items = F.when(makes, F.concat(items, place)).otherwise(items)
    each = lives.select("key", "id", "seq", "_until", F.explode(items).alias("i"))
    each = each.groupBy("key", "id", F.col("i.name").alias("name")).agg(F.max_by("i", "seq").alias("i"), F.first("_until").alias("_until"))
    stored = F.when(F.col("name").isNotNull() & ~values.is_zero(F.col("i.v")), F.struct("name", F.col("i.v").alias("v")))
    out = each.groupBy("key", "id").agg(
        F.max(F.when(F.col("name").isNull(), F.col("i.g"))).alias("g"), F.array_sort(F.collect_list(stored)).alias("f"), F.first("_until").alias("_until")
    )
    out = out.select("key", "id", "g.*", F.map_from_entries("f").alias("fields"), F.timestamp_seconds("_until").alias("expires_at"))
    if not rare[1]:
        return out
    ship(changes.sparkSession)
    edits = F.col("command").isin("jset", "jdel")
    last = F.coalesce(F.max(F.when(F.col("command") == "set", F.col("seq"))).over(Window.partitionBy("key", "id")), F.lit(-(1 << 62)))
    some = F.max(edits).over(Window.partitionBy("key", "id"))
    rows = lives.filter(edits | (F.col("command") == "set")).withColumns({"_set": last, "_some": some})
    rows = rows.filter("_some and seq >= _set").select("key", "id", "seq", "command", "pattern", "new_key", *GEOMETRY_NAMES)
    rows = rows.repartition("key", "id").sortWithinPartitions("key", "id", "seq")
    made = StructType.fromDDL(f"key string, id string, {GEOMETRY}")
    edited = rows.mapInArrow(_edits(to_arrow_schema(made)), made).select("key", "id", F.struct(*GEOMETRY_NAMES).alias("_g"))
    out = out.join(edited, ["key", "id"], "left")
    pick = [F.when(F.col("_g").isNotNull(), F.col(f"_g.{n}")).otherwise(F.col(n)).alias(n) for n in GEOMETRY_NAMES]
    return out.select("key", "id", *pick, "fields", "expires_at")


def upsert(objects: DataFrame, new: DataFrame) -> DataFrame:
    """Batch SET of whole rows: new geometry and expiry replace, fields merge, other rows stay."""
    a, b = objects.alias("a"), new.alias("b")
    both = a.join(b, ["key", "id"], "full_outer")
    fresh = F.col("b.kind").isNotNull() | F.col("b.fields").isNotNull()
    pick = [F.when(fresh, F.col(f"b.{n}")).otherwise(F.col(f"a.{n}")).alias(n) for n in GEOMETRY_NAMES]
    fields = F.when(fresh, values.merge(F.col("a.fields"), F.col("b.fields"))).otherwise(F.col("a.fields"))
    ends = F.when(fresh, F.col("b.expires_at")).otherwise(F.col("a.expires_at"))
    return both.select("key", "id", *pick, fields.alias("fields"), ends.alias("expires_at"))


def fset(objects: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects with fields (key, id, fields) merged in, changes (key, id, n) per existing id). Missing ids are ignored."""
    joined = objects.alias("a").join(new.select("key", "id", F.col("fields").alias("_new")).alias("b"), ["key", "id"], "left")
    merged = values.merge(F.col("fields"), F.col("_new"))
    old = lambda k: F.coalesce(F.col("fields")[k], values.ZERO.column())
    changed = F.size(F.filter(F.map_entries("_new"), lambda e: ~(old(e["key"])["data"].eqNullSafe(e["value"]["data"]) & (old(e["key"])["kind"] == e["value"]["kind"]))))
    counts = joined.filter("_new is not null").select("key", "id", changed.alias("n"))
    return joined.withColumn("fields", F.when(F.col("_new").isNotNull(), merged).otherwise(F.col("fields"))).drop("_new"), counts


def delete(objects: DataFrame, key: str, id_: str) -> DataFrame:
    return objects.filter(~((F.col("key") == key) & (F.col("id") == id_)))


def pdel(objects: DataFrame, key: str, pattern: str) -> DataFrame:
    return objects.filter(~((F.col("key") == key) & globs.matches(F.col("id"), pattern)))


def drop(objects: DataFrame, key: str) -> DataFrame:
    return objects.filter(F.col("key") != key)


def rename(objects: DataFrame, key: str, new: str) -> DataFrame:
    """Move a collection; what was under the new name goes."""
    kept = objects.filter((F.col("key") != new) | F.lit(key == new))
    return kept.withColumn("key", F.when(F.col("key") == key, new).otherwise(F.col("key")))


def expire(objects: DataFrame, key: str, id_: str, at: Column | None) -> DataFrame:
    """Set an expiry time, or clear it with None."""
    own = (F.col("key") == key) & (F.col("id") == id_)
    at = F.lit(None).cast("timestamp") if at is None else at
    return objects.withColumn("expires_at", F.when(own, at).otherwise(F.col("expires_at")))


# Reads.


def get(objects: DataFrame, key: str, id_: str) -> DataFrame:
    return objects.filter((F.col("key") == key) & (F.col("id") == id_))


def fget(objects: DataFrame, key: str, id_: str, name: str) -> DataFrame:
    return get(objects, key, id_).select(values.to_json(values.field(name)).alias("value"))


def exists(objects: DataFrame, key: str, id_: str) -> DataFrame:
    return get(objects, key, id_).limit(1).agg((F.count(F.lit(1)) > 0).alias("exists"))


def fexists(objects: DataFrame, key: str, id_: str, name: str) -> DataFrame:
    return get(objects, key, id_).select(F.map_contains_key("fields", name).alias("exists"))


def ttl(objects: DataFrame, now: Column | None = None) -> DataFrame:
    """(key, id, ttl): seconds left, -1 without expiry."""
    now = F.current_timestamp() if now is None else now
    left = F.col("expires_at").cast("double") - now.cast("double")
    return objects.select("key", "id", F.coalesce(left, F.lit(-1.0)).alias("ttl"))


def keys(objects: DataFrame, pattern: str = "*") -> DataFrame:
    return objects.filter(globs.matches(F.col("key"), pattern)).select("key").distinct()


def key_type(objects: DataFrame, key: str) -> DataFrame:
    n = objects.filter(F.col("key") == key).limit(1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.when(F.col("n") > 0, "hash").otherwise("none").alias("type"))


def weight() -> Column:
    """Bytes of an object: its id, its coordinates or text, and its fields."""
    text = F.when(F.col("kind") == "string", F.octet_length("value")).when(F.col("kind") == "rect", F.lit(32))
    text = text.when(F.col("kind") == "point", F.lit(16) + F.when(F.col("z").isNotNull(), 8).otherwise(0)).otherwise(F.col("npoints") * 16)
    own = F.aggregate(
        F.map_entries("fields"), F.lit(0), lambda s, e: s + F.octet_length(e["key"]) + 8 + F.octet_length(e["value"]["data"])
    )
    return F.octet_length("id") + text + own


def stats(objects: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per key: objects, strings, points and bytes."""
    rows = objects if names is None else objects.filter(F.col("key").isin(names))
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("num_objects"),
        F.count(F.when(F.col("kind") == "string", 1)).alias("num_strings"),
        F.sum(F.coalesce("npoints", F.lit(0))).cast("long").alias("num_points"),
        F.sum(weight()).cast("long").alias("in_memory_size"),
    )


def server(objects: DataFrame) -> DataFrame:
    """Totals over all keys."""
    return stats(objects).agg(
        F.count(F.lit(1)).alias("num_collections"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("num_objects", "num_strings", "num_points", "in_memory_size")],
    )


def metrics(objects: DataFrame) -> DataFrame:
    """Gauges a collection as (metric, key, value) rows."""
    gauges = ("num_objects", "num_strings", "num_points", "in_memory_size")
    rows = F.explode(F.array(*[F.struct(F.lit(f"collection_{g}").alias("metric"), F.col(g).cast("double").alias("value")) for g in gauges]))
    return stats(objects).select("key", rows.alias("r")).select("r.metric", "key", "r.value")


# Log maintenance.


def compact(changes: DataFrame, now: Column | None = None) -> DataFrame:
    """The shortest change log with the same outcome: one set a live object."""
    out = fold(changes, now)
    at = F.current_timestamp() if now is None else now
    left = F.col("expires_at").cast("double") - at.cast("double")
    rows = out.select(
        F.monotonically_increasing_id().alias("seq"), at.alias("ts"), F.lit("set").alias("command"), "key", "id", *GEOMETRY_NAMES,
        "fields", left.alias("ex_seconds"),
    )
    return _as_changes(rows)


def checksum(changes: DataFrame, first: int, last: int) -> DataFrame:
    """md5 over a range of the log; equal logs have equal sums whatever their partitions."""
    rows = changes.filter(F.col("seq").between(first, last))
    each = F.md5(F.to_json(F.struct(*[c for c in CHANGE_NAMES if c in changes.columns])))
    # Sums of digests don't depend on order, and don't gather the range in one task.
    parts = [F.sum(F.conv(F.substring(each, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *parts)
    return sums.select(F.md5(F.concat_ws(":", "n", "s0", "s1", "s2", "s3")).alias("md5"))
