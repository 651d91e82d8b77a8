"""Fences: batch, replay and stream agree; roaming goldens; sinks; tiles; folds."""

import itertools
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrille import queries
from quadrille.functions import geo
from quadrille.operators import fences, kv, mvt, roam
from quadrille.operators.search import compile
from quadrille.plans import spec as S
from quadrille.sources import commandlog
from quadrille.sources import objects as src
from quadrille.streaming import fences as stream
from quadrille.streaming import sinks


def test_rules_agree(spark):
    """The column form of the rules and the plain one, over every combination."""
    rows = list(itertools.product([True, False], [True, False], ["set", "fset"], [True, False], [True, False]))
    df = spark.createDataFrame(rows, "old boolean, new boolean, command string, passes boolean, crossed boolean")
    got = df.select("*", fences.detection(*(F.col(c) for c in df.columns)).alias("d"))
    for names in (None, ["inside", "outside"], ["enter"], ["exit", "cross"], ["outside", "enter"]):
        for r in got.select("*", fences.requested(F.col("d"), names).alias("names")).collect():
            want = stream.detect(r.old, r.new, r.command, r.passes, r.crossed)
            assert r.d == want
            assert r.names == stream.requested(want, names)


def two_fences():
    return [
        fences.Fence("box", "fleet", S.bounds(*queries.FENCE)),
        fences.Fence("round", "fleet", S.circle(10, 10, 4000000), where=[S.Where("op", "value", (">", "5"))], detect=["enter", "exit", "cross"], match=["u1*"]),
    ]


def events_of(df):
    return sorted(tuple(map(str, r)) for r in df.select("seq", "hook", "key", "id", "command", "rank", "detect", "group").collect())


def test_batch_equals_replay(spark, sf):
    log = queries.log(spark, sf)
    batch = events_of(fences.events(log, two_fences(), True))
    assert len(batch) > 500
    assert batch == events_of(stream.stream_events(log, two_fences(), True))


def many_fences():
    """Boxes, circles and triangles of all sizes, asking for all kinds of things."""
    out, asks = [], [None, ["inside"], ["enter", "exit"], ["cross"], ["outside"], ["exit", "cross"], ["enter"]]
    for i in range(28):
        lat, lon, size = -70 + (i * 37) % 130, -170 + (i * 101) % 300, (0.1, 2, 9, 30)[i % 4]
        area = S.bounds(lat, lon, lat + size, lon + size) if i % 3 else S.circle(lat, lon, size * 80000)
        if i % 10 == 4:
            area = S.geojson({"type": "Polygon", "coordinates": [[[lon, lat], [lon + size, lat], [lon, lat + size], [lon, lat]]]})
        where = [S.Where("op", "value", (">", "5"))] if i % 5 == 0 else []
        match, commands = ["u1*", "*2"] if i % 4 == 1 else [], ["set", "del"] if i % 6 == 5 else None
        out.append(fences.Fence(f"h{i}", "fleet", area, match=match, where=where, detect=asks[i % 7], commands=commands, nofields=i % 8 == 3))
    return out


@pytest.mark.parametrize("points_only", [True, False])
def test_candidates_lose_no_event(spark, sf, points_only):
    """Fences found by grid cell are told what all fences tested against all changes are, but for deletes far away."""
    log, many = queries.log(spark, sf).filter("seq < 250"), many_fences()
    want, got = set(events_of(fences.events(log, many, points_only))), events_of(fences.hook_events(log, many, points_only))
    assert len(got) == len(set(got)) and set(got) <= want
    everything = {f.name for f in many if f.detect is None or "outside" in f.detect}
    missing = want - set(got)
    assert all(r[4] == "del" and r[1] not in everything for r in missing) and missing and any(r[4] == "del" for r in got)


def test_many_fences_one_plan(spark, sf):
    log = queries.log(spark, sf)
    make = lambda n: [fences.Fence(f"h{i}", "fleet", S.bounds(i % 80, i % 170, i % 80 + 1, i % 170 + 1), detect=["enter"]) for i in range(n)]
    plans = [fences.hook_events(log, make(n), True)._jdf.queryExecution().executedPlan().toString() for n in (2, 1000)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") and len(plans[1]) < 1.5 * len(plans[0])
    assert fences.hook_events(log, make(1000), True).count() >= 0


def test_stream_equals_batch(spark, sf, tmp_path):
    log = queries.log(spark, sf)
    for i in range(4):
        log.filter((F.col("seq") >= i * 250) & (F.col("seq") < (i + 1) * 250)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    rows = stream.stream_events(source, two_fences(), True)
    seen = []
    q = rows.writeStream.foreachBatch(lambda df, _: seen.extend(events_of(df))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(seen) == events_of(fences.events(log, two_fences(), True))


def test_delivery(spark, sf, tmp_path):
    f = fences.Fence("box", "fleet", S.bounds(*queries.FENCE), meta={"a": "b"})
    queries.log(spark, sf).limit(100).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(queries.log(spark, sf).schema).parquet(f"{tmp_path}/in")
    channels, taken = sinks.Channels(), []
    channels.psubscribe("b?x", lambda _, m: taken.append(json.loads(m)))
    text = stream.messages(stream.stream_events(source, [f], True), [f])
    q = sinks.deliver(text, {}, sinks.Sender(channels)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(taken) == fences.events(spark.read.parquet(f"{tmp_path}/in"), [f], True).count()
    assert taken[0]["hook"] == "box" and taken[0]["meta"] == {"a": "b"} and taken[0]["object"]["type"] == "Point"


def test_endpoints():
    e = sinks.parse_endpoint("kafka://host:9092/topic?auth=none")
    assert (e.scheme, e.host, e.port, e.path, e.options) == ("kafka", "host", 9092, "/topic", {"auth": "none"})
    assert sinks.parse_endpoint("https://sqs.eu-west-1.amazonaws.com/1/q").scheme == "sqs"
    assert sinks.parse_endpoint("Endpoint=sb://x;EntityPath=y").scheme == "eventhub"
    for bad in ("ftp://x", "kafka://"):
        with pytest.raises(ValueError):
            sinks.parse_endpoint(bad)
    sent = []

    def broken(*_):
        raise OSError("down")

    s = sinks.Sender(senders={"kafka": broken, "nats": lambda e, m: sent.append(m)})
    assert s.send(["kafka://a", "nats://b"], "m") == "nats://b" and sent == ["m"]
    with pytest.raises(sinks.Undelivered):
        s.send(["kafka://a"], "m")




def test_roam_modes(spark):
    lat, lon, step = 33.0, -115.0, 0.005
    rows = [(0, "a", lat, lon), (1, "b", lat, lon + step), (2, "b", lat, lon + step), (3, "b", lat, lon + 1), (4, "b", lat + 0.008, lon + 0.0095)]
    log = spark.createDataFrame(rows, "seq long, id string, lat double, lon double").select(
        "seq", F.current_timestamp().alias("ts"), F.lit("set").alias("command"), F.lit("k").alias("key"), "id", *src.point_geometry(F.col("lat"), F.col("lon"))
    )
    pick = lambda **kw: [(r.seq, r.kind, r.other) for r in roam.roam(log, "k", "k", "*", 1000, **kw).orderBy("seq").collect()]
    assert pick() == [(1, "nearby", "a"), (2, "nearby", "a"), (3, "faraway", "a"), (4, "nearby", "a")]
    assert pick(nodwell=True) == [(1, "nearby", "a"), (3, "faraway", "a"), (4, "nearby", "a")]
    assert pick(mode="radius") == [(1, "nearby", "a"), (2, "nearby", "a"), (3, "faraway", "a")]
    r = roam.roam(log, "k", "k", "*", 1000).filter("seq = 1").first()
    assert r.meters == int(r.meters * 1000) / 1000 and 400 < r.meters < 500
    scanned = roam.with_scan(roam.roam(log, "k", "k", "a*", 1000).filter("seq = 1"), src.objects(F.lit("k"), F.col("id"), src.string_geometry(F.col("id")), spark.createDataFrame([("a",), ("a:1",), ("a:2",), ("b:1",)], "id string")), "k", ":*")
    assert scanned.first().scan == ["a:1", "a:2"]


def test_sparse_grid(spark):
    objects = src.synthetic(spark, 1, 8000, box=(-110.0, 30.0, -100.0, 40.0))
    for level, want in ((1, 4), (2, 16), (3, 64)):
        found = compile(S.Search("within", "mi:0", area=S.bounds(30, -110, 40, -100), sparse=level, points_only=True), objects).df
        assert found.count() == want


def varint(data, i):
    n = shift = 0
    while True:
        n |= (data[i] & 127) << shift
        shift += 7
        i += 1
        if data[i - 1] < 128:
            return n, i


def fields_of(data):
    i, out = 0, []
    while i < len(data):
        tag, i = varint(data, i)
        if tag & 7 == 2:
            n, i = varint(data, i)
            out.append((tag >> 3, data[i : i + n]))
            i += n
        else:
            n, i = varint(data, i)
            out.append((tag >> 3, n))
    return out


def test_tile_bytes():
    square = {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]}
    data = mvt.encode([("p", {"type": "Point", "coordinates": [0, 0]}), ("a", square)], 0, 0, 0)
    (kind, layer), = fields_of(data)
    parts = fields_of(layer)
    assert kind == 3 and (15, 2) in parts and (5, 4096) in parts
    features = [fields_of(v) for n, v in parts if n == 2]
    assert [dict(f)[3] for f in features] == [mvt.POINT, mvt.POLYGON]
    point = dict(features[0])[4]
    assert [varint(point, 0)[0], varint(point, 1)[0]] == [9, 4096]  # move to (2048, 2048), zigzagged
    assert [v.decode() for n, v in parts if n == 3] == ["type", "id"]


def test_fold_agrees_with_engine(spark, sf):
    """The distributed fold against a plain replay of the same log."""
    rows = queries.log(spark, sf).orderBy("seq").collect()
    state = {}
    for r in rows:
        old = state.get(r.id)
        if r.command == "del":
            state.pop(r.id, None)
        elif r.command == "set" or old:
            fields = {**(old or {}).get("f", {}), **{k: v.data for k, v in r.fields.items()}}
            fields = {k: v for k, v in fields.items() if v != "0"}
            state[r.id] = {"f": fields, "at": (r.y, r.x) if r.command == "set" else old["at"]}
    got = {r.id: {"f": {k: v.data for k, v in r.fields.items()}, "at": (r.y, r.x)} for r in kv.fold(queries.log(spark, sf)).collect()}
    assert got == state


def test_nearest_join_blocks(spark, sf):
    objects = queries.fleet(spark, sf)
    q = spark.createDataFrame([(i, i * 7.0 - 60, i * 13.0 - 100) for i in range(12)], "qid long, lat double, lon double")
    one, many = (sorted(map(tuple, roam.nearest_join(q, objects, 3, block=b).collect())) for b in (100, 5))
    assert one == many and len(one) == 36
    single = compile(S.Search("nearby", "fleet", limit=3, area=S.point(-60, -100), points_only=True), objects).df.collect()
    assert [r.id for r in single] == [r[1] for r in sorted((x for x in one if x[0] == 0), key=lambda x: x[3])]


def test_pruned_scan(spark, sf, tmp_path):
    """A box search over a table sorted by cell compares box columns in the file scan."""
    src.by_cell(queries.fleet(spark, sf), f"{tmp_path}/t")
    df = compile(S.Search("within", "fleet", area=S.bounds(10, 10, 20, 20), points_only=True), spark.read.parquet(f"{tmp_path}/t")).df.select("id")
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(maxx,10.0)" in plan and "PartitionFilters: [isnotnull(key" in plan and "geojson" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_command_log(spark, tmp_path):
    commands = [
        "SET fleet a FIELD speed 5 POINT 10 20".split(), "SET fleet b BOUNDS 1 2 3 4".split(), "SET fleet c STRING hello".split(),
        "FSET fleet a speed 0 x 7".split(), "SET fleet d OBJECT".split() + ['{"type":"LineString","coordinates":[[1,2],[3,4]]}'],
        "SET fleet e HASH 9my5xp7".split(), "DEL fleet e".split(), "PUBLISH chan hi".split(), "PDEL fleet b*".split(), "SET other z POINT 1 1".split(),
        "DROP other".split(), "SET fleet old EX 5 POINT 1 1".split(),
    ]
    data = commandlog.write(commands)
    assert list(commandlog.read(b"\0\0" + data + b"\0" + data[:37])) == commands + list(commandlog.read(data[:37]))
    with pytest.raises(commandlog.BadLog):
        list(commandlog.read(b"*1\r\n+x"))
    half = len(commandlog.write(commands[:5]))
    (tmp_path / "1.log").write_bytes(data[:half])
    (tmp_path / "2.log").write_bytes(data[half:] + b"*3\r\n$3\r\nSE")
    rows = commandlog.changes(commandlog.read_files(spark, str(tmp_path)))
    assert rows.count() == len(commands) - 1
    objects = {r.id: r for r in kv.fold(rows, F.current_timestamp() + F.expr("interval 60 seconds")).collect()}
    assert set(objects) == {"a", "c", "d"}
    assert {k: v.data for k, v in objects["a"].fields.items()} == {"x": "7"} and objects["a"].x == 20
    assert objects["c"].value == "hello" and objects["d"].gtype == "LineString"


def test_live_fence(spark, sf, tmp_path):
    log = queries.log(spark, sf).limit(200)
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    f = fences.Fence("box", "fleet", S.bounds(*queries.FENCE), detect=["enter"])
    q = stream.live_fence(source, f, "live_box", f"{tmp_path}/c", True)
    q.processAllAvailable()
    q.stop()
    assert spark.table("live_box").filter("detect = 'enter'").count() == fences.events(spark.read.parquet(f"{tmp_path}/in"), [f], True).filter("detect = 'enter'").count()


#: Longitudes of two cars on one parallel, turn by turn, and what their moves report within 1000 m.
PARALLEL = 33.414750027566235
CAR1 = [-111.93669319152832, -111.93051338195801, -111.92416191101074, -111.91789627075195, -111.9111156463623, -111.90510749816895, -111.89746856689453]
CAR2 = [-111.89746856689453, -111.90519332885742, -111.91154479980467, -111.91781044006346, -111.92416191101074, -111.93059921264648, -111.93660736083984]
REPORTS = [("car1", "nearby", "car2", 589.512), ("car2", "nearby", "car1", 7.966), ("car1", "nearby", "car2", 621.377), ("car2", "faraway", "car1", 1210.89)]


def test_roam_reports(spark):
    moves = [x for pair in zip([("car1", x) for x in CAR1], [("car2", x) for x in CAR2], strict=True) for x in pair]
    df = spark.createDataFrame([(i, c, x) for i, (c, x) in enumerate(moves)], "seq long, id string, lon double")
    log = df.select("seq", F.current_timestamp().alias("ts"), F.lit("set").alias("command"), F.lit("cars").alias("key"), "id", *src.point_geometry(F.lit(PARALLEL), F.col("lon")))
    got = roam.roam(log, "cars", "cars", "*", 1000).orderBy("seq").collect()
    assert [(r.id, r.kind, r.other, r.meters) for r in got] == REPORTS


def random_log(spark, n, ids, keys=("k",)):
    rng = random.Random(5)
    rows = [(i * i, rng.choice(["set"] * 6 + ["del", "fset"]), rng.choice(keys), f"o{rng.randrange(ids)}", rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "seq long, command string, key string, id string, lat double, lon double")
    at = (F.when(F.col("command") != "del", F.col(c)) for c in ("lat", "lon"))
    return rows, df.select("seq", F.current_timestamp().alias("ts"), "command", "key", "id", *src.point_geometry(*at))


def roamed(rows, key, roam_key, meters, nodwell):
    """Roaming one change at a time, by the bounding box of the radius."""
    live, out = {}, set()
    for seq, command, own, id_, lat, lon in rows:
        if command == "fset":
            continue
        old = live.pop((own, id_), None)
        if command == "del":
            continue
        live[own, id_] = (lat, lon)
        if own != key:
            continue
        for (k, other), (y, x) in live.items():
            if k != roam_key or other == id_:
                continue
            is_new, was = ((lambda b: b[0] <= y <= b[2] and b[1] <= x <= b[3])(geo.rect_around(*p, meters)) if p else False for p in ((lat, lon), old))
            if is_new and not (was and nodwell):
                out.add((seq, id_, "nearby", other))
            elif was and not is_new:
                out.add((seq, id_, "faraway", other))
    return out


def test_roam_gathers_nothing(spark):
    """No side of the join is sent to the driver, whatever Spark guesses of its size, and pairs aren't shuffled again."""
    plan = roam.roam(random_log(spark, 40, 5)[1], "k", "k", "*", 100000)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Aggregate" not in plan and plan.count("SortMergeJoin") == 1


def shuffles(node):
    """(what is dealt by, rows written) of each shuffle of a plan that has run."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        return shuffles(node.executedPlan() if kind.startswith("A") else node.plan())
    own = [(node.outputPartitioning().toString(), node.metrics().apply("shuffleRecordsWritten").value())] if kind == "ShuffleExchangeExec" else []
    return sum((shuffles(node.children().apply(i)) for i in range(node.children().size())), own)


def test_roam_moves_travel_in_few_rows(spark):
    """A move is shuffled for the join under two to three cells on the mean, and its box doesn't travel with it."""
    rows, log = random_log(spark, 3000, 20)
    df = roam.roam(log, "k", "k", "*", 150000, kinds=["nearby"]).select("seq", "id", "other")
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    dealt = [n for by, n in shuffles(plan) if by.startswith(("hashpartitioning(place", "hashpartitioning(span"))]
    moves = sum(r[1] == "set" for r in rows)
    assert len(dealt) == 2 and moves < max(dealt) < 3 * moves
    join = plan.toString().split("SortMergeJoin")[1].split("Exchange hashpartitioning(place", 1)
    assert "AS west#" in join[0] and "ASIN" in join[0]


def test_roam_at_the_edges_of_the_map(spark):
    """Cells that widen with the parallels, poles, the date line and places beyond the map: each pair once."""
    at = [(y, x) for y in (-90, -89.5, -60, -59, 0, 61, 76, 89, 90) for x in (-200, -180, -179, -1, 0, 90, 179.5, 180, 181)]
    rows = [(i, "set", "k", f"o{i % 60}", float(y), float(x)) for i, (y, x) in enumerate(at * 2)]
    df = spark.createDataFrame(rows, "seq long, command string, key string, id string, lat double, lon double")
    log = df.select("seq", F.current_timestamp().alias("ts"), "command", "key", "id", *src.point_geometry(F.col("lat"), F.col("lon")))
    for meters in (3, 90000, 1500000, 9000000):
        step = math.degrees(meters / geo.EARTH)
        sides = dict(df.select("seq", geo.half_width(F.col("lat"), meters)).collect())
        live, want = {}, []
        for seq, _, _, id_, y, x in rows:
            live[id_] = (y, x)
            want += [(seq, o) for o, (b, a) in live.items() if o != id_ and x - sides[seq] <= a <= x + sides[seq] and y - step <= b <= y + step]
        got = [(r.seq, r.other) for r in roam.roam(log, "k", "k", "*", meters, kinds=["nearby"]).collect()]
        assert sorted(got) == sorted(want)


def test_roam_spans(spark):
    """A move meets what lives in its span of the log: spans are short, yet versions take few rows more."""
    rows, log = random_log(spark, 3000, 20)
    sets = log.filter("command != 'fset'").withColumn("until", F.lead("seq").over(Window.partitionBy("id").orderBy("seq"))).filter("command = 'set'")
    span, shift = roam._spans(log, sets.withColumnRenamed("seq", "since"))
    got = sets.select("seq", span("seq").alias("lo"), span(F.coalesce("until", F.lit(2**63 - 1))).alias("hi")).collect()
    assert sum((r.hi >> shift) - (r.lo >> shift) for r in got) <= 2 * len(rows)
    assert max(Counter(r.lo >> shift for r in got).values()) <= 2 * roam.SPAN


@pytest.mark.parametrize("roam_key", ["k", "other"])
def test_roam_nearby_one_by_one(spark, monkeypatch, roam_key):
    """Against one change at a time, with spans of very few rows, and gaps in seq that grow."""
    monkeypatch.setattr(roam, "SPAN", 4)
    rows, log = random_log(spark, 400, 12, ("k", "other"))
    got = [(r.seq, r.id, r.kind, r.other) for r in roam.roam(log, "k", roam_key, "*", 150000).collect()]
    assert len(got) == len(set(got)) and set(got) == roamed(rows, "k", roam_key, 150000, False)


def test_roam_nodwell_one_by_one(spark, monkeypatch):
    """With nodwell, an object that was near before the move isn't told again; spans are cut and joined alike."""
    monkeypatch.setattr(roam, "SPAN", 4)
    rows, log = random_log(spark, 400, 12)
    events = roam.roam(log, "k", "k", "*", 150000, nodwell=True)
    got = [(r.seq, r.id, r.kind, r.other) for r in events.collect()]
    assert len(got) == len(set(got)) and set(got) == roamed(rows, "k", "k", 150000, True)
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "[span" in plan and "Aggregate" not in plan


@pytest.mark.parametrize("nodwell", [False, True])
@pytest.mark.parametrize("mode", ["compat", "radius"])
def test_roam_kinds(spark, monkeypatch, mode, nodwell):
    """Asked for one kind, roaming tells what it tells of it anyhow, but lists moves under the boxes of that kind only."""
    monkeypatch.setattr(roam, "SPAN", 4)
    log = random_log(spark, 300, 12)[1].cache()
    told = {tuple(r) for r in roam.roam(log, "k", "k", "*", 150000, None, nodwell, mode).collect()}
    for kind in roam.KINDS:
        got = [tuple(r) for r in roam.roam(log, "k", "k", "*", 150000, None, nodwell, mode, [kind]).collect()]
        assert len(got) == len(set(got)) and set(got) == {r for r in told if r[4] == kind} != set()
    log.unpersist()
    with pytest.raises(ValueError, match="invalid kinds"):
        roam.roam(log, "k", "k", "*", 150000, kinds=["inside"])


def join_of(events):
    """Spark's description of the one join in a plan."""
    (join,) = (x for x in events._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in x)
    return join


def test_roam_nearby_measures_boxes_once_a_move(spark, sf):
    """Pairs are only compared with the boxes: the old box isn't listed or met, and no angle is worked out in the join."""
    join = join_of(queries.QUERIES["roam_nearby"](spark, sf))
    assert "west#" in join and "owest#" not in join
    assert not re.search("(?i)asin|cos|radians|degrees", join)


def test_roam_nearby_tenths(spark):
    """Whole millimetres go to tenths of a metre as F.round has them, halves and very long ways included."""
    mm = spark.range(200_000).select((F.col("id") / 1000).alias("m")).union(spark.range(200_000).select((F.col("id") * 50 + 20_000_000_050) / 1000))
    assert mm.filter(queries._tenths(F.col("m")) != F.round("m", 1)).count() == 0


def test_roam_nodwell_of_copies(spark, monkeypatch):
    """Rows that repeat a seq: of the versions only the last is met, and one copy of a move tells, since the others stay."""
    monkeypatch.setattr(roam, "SPAN", 4)
    rows, log = random_log(spark, 300, 12)
    events = roam.roam(log.withColumn("copy", F.explode(F.array(*map(F.lit, range(6))))).drop("copy"), "k", "k", "*", 150000, nodwell=True, kinds=["nearby"])
    got = [(r.seq, r.id, r.kind, r.other) for r in events.collect()]
    assert len(got) == len(set(got)) and set(got) == {r for r in roamed(rows, "k", "k", 150000, True) if r[2] == "nearby"}


def test_roam_nodwell_measures_boxes_once_a_move(spark, sf):
    join = join_of(queries.QUERIES["roam_nodwell"](spark, sf))
    assert "west#" in join and "owest#" in join and not re.search("(?i)asin|cos|radians|degrees", join)


def test_fences_share_one_order(spark, sf):
    """However many fences: one scan of the log, and no more shuffles than for one."""
    log = queries.log(spark, sf)
    plans = []
    for n in (1, 5):
        many = [fences.Fence(f"f{i}", "fleet", S.bounds(-40 + i, -120, 40, 60)) for i in range(n)]
        plans.append(fences.events(log, many, True)._jdf.queryExecution().executedPlan().toString())
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2, 2]
    assert [p.count("FileScan") for p in plans] == [1, 1]


def as_log(spark, commands):
    rows = [(i, list(map(str, c))) for i, c in enumerate(commands)]
    return commandlog.changes(spark.createDataFrame(rows, "seq long, args array<string>"))


def test_log_renames_and_json(spark):
    log = as_log(spark, [
        ("SET", "a", "one", "POINT", 1, 2), ("SET", "b", "gone", "POINT", 3, 4), ("RENAME", "a", "b"), ("SET", "a", "two", "POINT", 5, 6),
        ("RENAMENX", "b", "c"), ("FSET", "c", "one", "speed", 7), ("JSET", "c", "doc", "x.y", "1"), ("JSET", "c", "doc", "z", "q", "STR"),
        ("JDEL", "c", "doc", "x.y"), ("SET", "c", "geo", "OBJECT", '{"type":"Point","coordinates":[8,9]}'), ("JSET", "c", "geo", "coordinates.1", "10"),
        ("SETHOOK", "h", "http://x", "NEARBY", "a", "FENCE", "POINT", 1, 2, 3), ("JDEL", "c", "none", "x"),
    ])
    got = {(r.key, r.id): r for r in kv.fold(log).collect()}
    assert set(got) == {("c", "one"), ("a", "two"), ("c", "doc"), ("c", "geo")}
    assert (got["c", "one"].y, got["c", "one"].x, got["c", "one"].fields["speed"].num) == (1, 2, 7)
    assert got["c", "doc"].kind == "string" and json.loads(got["c", "doc"].value) == {"x": {}, "z": "q"}
    assert (got["c", "geo"].x, got["c", "geo"].y) == (8, 10)


def test_log_refuses_unknown_commands():
    with pytest.raises(commandlog.BadLog, match="unknown command"):
        commandlog.change(["MOVE", "a", "b"])


def test_engine_log_keeps_expiry_and_renames(spark):
    from quadrille.engine import Engine

    e = Engine(spark, clock=lambda: 1_700_000_000.0)
    e.execute("SET fleet a EX 1000 POINT 1 2")
    e.execute("SET fleet b POINT 3 4")
    e.execute("RENAME fleet ships")
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000.0 + s))
    for _ in range(2):
        assert {(r.key, r.id) for r in kv.fold(e.changes(), at(10)).collect()} == {("ships", "a"), ("ships", "b")}
        assert {(r.key, r.id) for r in kv.fold(e.changes(), at(2000)).collect()} == {("ships", "b")}
        e.execute("AOFSHRINK")


def test_case_folds_ascii_only(spark):
    from quadrille.functions import values

    row = spark.range(1).select(
        values.equal(values.parse("AbC").column(), values.parse("aBc").column()).alias("plain"),
        values.equal(values.parse("\u00c9").column(), values.parse("\u00e9").column()).alias("accent"),
    ).first()
    assert row.plain and not row.accent
