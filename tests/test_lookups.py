"""Polygon covers, mentions of many ids, point lookups and the cycle history against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from perilgrid.operators import ask, explain, geo, routing
from perilgrid.plans.cycle import prediction_cycle
from perilgrid.plans.history import cycle_history, newest_of_cycles
from perilgrid.session import cut_lineage

ZONE = "zone_id int, region_id string, ring array<struct<lon:double,lat:double>>"


def inside(lon, lat, ring):
    odd = False
    for i, (x1, y1) in enumerate(ring):
        x2, y2 = ring[i - 1]
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def star(rng, lon, lat, size, corners):
    turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(lon + size * rng.uniform(0.2, 1) * math.cos(t), lat + size * rng.uniform(0.2, 1) * math.sin(t)) for t in turn]


def test_points_in_zones_of_very_different_sizes(spark):
    rng = random.Random(7)
    rings = [star(rng, rng.uniform(-100, 100), rng.uniform(-50, 50), size, rng.choice([3, 5, 9, 40])) for size in (1e-4, 1e-3, 0.1, 1, 5, 30, 60) for _ in range(4)]
    rings += [[(0.0, 0.0), (60.0, 0.0), (60.0, 60.0), (0.0, 60.0)], [], [(5.0, 5.0)], [(1.0, 1.0), (2.0, 1.0)], [(-0.25, -0.25), (0.25, -0.25), (0.25, 0.25), (-0.25, 0.25)]]
    points = [(rng.uniform(-170, 170), rng.uniform(-80, 80)) for _ in range(400)]
    for ring in rings:  # near the zones, on their corners and on cell borders
        for x, y in ring[:12]:
            points += [(x, y), (x + rng.uniform(-1e-4, 1e-4), y + rng.uniform(-1e-4, 1e-4))]
        if ring:
            xs, ys = [x for x, _ in ring], [y for _, y in ring]
            points += [(rng.uniform(min(xs), max(xs)), rng.uniform(min(ys), max(ys))) for _ in range(25)]
    points += [(0.0, 0.0), (45.0, 45.0), (22.5, 0.0), (0.25, 0.0), (60.0, 30.0), (0.0, 30.0)]
    zones = spark.createDataFrame([(k, f"r{k}", r) for k, r in enumerate(rings)], ZONE)
    spots = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "id int, lon double, lat double")
    got = {(r.id, r.zone_id) for r in geo.points_in_zones(spots, zones).collect()}
    want = {(i, k) for i, p in enumerate(points) for k, r in enumerate(rings) if inside(*p, r)}
    assert got == want and len(want) > 300
    cells = geo.zone_cells(zones)
    per = [r["count"] for r in cells.groupBy("zone_id").count().collect()]
    assert max(per) <= (geo.ACROSS + 1) ** 2
    assert cells.filter("inner").count() > 20 and cells.filter("inner and edges is not null").count() == 0
    big = cells.filter("zone_id = 28").agg(F.count_if("inner").alias("i"), F.max(F.size("edges")).alias("e")).first()
    assert big.i > 0 and big.e < 4


def test_mentions_equal_contains(spark):
    rng = random.Random(2)
    ids = ["R1", "r12", "r123", "Ab", "north-east 7", "x" * 30, "İzmir", "é", *[f"r{k:09d}" for k in range(0, 4000, 37)]]
    texts = []
    for k in range(300):
        text = "".join(rng.choice("abr012 xé.") for _ in range(rng.randrange(60)))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice([str.upper, str.lower, str])(rng.choice(ids)) + text[at:]
        texts.append((k, "given" if k % 29 == 0 else None, text))
    texts += [(900, None, ""), (901, None, None), (902, None, "r")]
    q = spark.createDataFrame(texts, "id int, asked_region string, question string")
    regions = spark.createDataFrame([(i,) for i in ids + ids[:3] + [""]], "region_id string")
    got = {r.id: r.region_id for r in ask.asked_regions(q, regions, ["id"]).collect()}
    known = regions.filter("region_id <> ''")
    pairs = q.join(known, F.lower("question").contains(F.lower("region_id")), "left").groupBy("id").agg(F.min("region_id").alias("m"))
    want = {r.id: r.m for r in pairs.collect()}
    assert got == {k: given or want[k] for k, given, _ in texts}
    assert sum(v is not None for v in got.values()) > 200


def test_lookup_reads_one_part(spark, load, tmp_path):
    records = explain.explanations(load("predictions").limit(500))
    explain.store_explanations(records, f"{tmp_path}/x")
    stored = spark.read.parquet(f"{tmp_path}/x")
    some = [r.prediction_id for r in records.select("prediction_id").limit(3).collect()]
    for pid in some:
        found = explain.stored_explanation(stored, pid)
        files = {f.split("part=")[1].split("/")[0] for f in found.inputFiles()}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(part" in plan and f"prediction_id" in plan.split("PushedFilters")[1]
        assert files and found.drop("contributing_factors").collect() == records.drop("contributing_factors").filter(F.col("prediction_id") == pid).collect()
    assert explain.stored_explanation(stored, -5).count() == 0


@pytest.mark.parametrize("step", [3600, 86400])
def test_history_equals_a_cycle_at_a_time(spark, load, step):
    readings, roads = load("sensor_readings"), load("region_adjacency")
    last = readings.agg(F.max(F.unix_seconds(F.col("reading_ts").cast("timestamp")))).first()[0] // step
    slots = [last - 30 * 86400 // step, last - 200000 // step, last - 1, last, last + 5]
    cut = lambda df: sorted(map(tuple, df.select("prediction_id", "risk_level", F.round("probability_pct", 6), F.round("severity_index", 6)).collect()))
    for s in slots:
        at = F.timestamp_seconds(F.lit(int(s * step))).cast("timestamp_ntz")
        assert cut(cycle_history(readings, roads, s, s, step)) == cut(prediction_cycle(readings, roads, at))
    both = cycle_history(readings, roads, slots[-2], slots[-1], step).groupBy("generated_at").count().collect()
    assert len(both) == slots[-1] - slots[-2] + 1 and len({r["count"] for r in both}) <= 2


def test_newest_of_cycles_keep_the_oldest_slots(spark):
    rows = [(i, "r", f"2024-01-01 00:00:00.{0:06d}") for i in range(0)]
    base = 1704067200
    for i in range(200):  # many in one hour, then a few in the next ones
        t = base + (i if i < 150 else 3600 * (i - 148))
        rows.append((i, "r", t))
    df = spark.createDataFrame(rows, "reading_id int, region_id string, t bigint").withColumn("reading_ts", F.timestamp_seconds("t"))
    df = df.withColumns({f: F.col("reading_id").cast("double") for f in ("rainfall_mm", "temperature_c", "river_level_m", "soil_moisture_pct", "wind_speed_kmh", "wind_direction_deg")})
    for r in newest_of_cycles(df).collect():
        seen = [i for i, _, t in rows if t <= r.slot * 3600][-24:][::-1]
        assert [int(x[0]) for x in r.newest] == seen


def test_repair_equals_a_full_search(spark):
    rng = random.Random(4)
    n = 8  # a grid, two ways along each road
    node = lambda x, y: x * n + y
    roads = [(node(x, y), node(x + dx, y + dy), float(rng.randrange(1, 6))) for x in range(n) for y in range(n) for dx, dy in ((0, 1), (1, 0)) if x + dx < n and y + dy < n]
    frame = lambda rs: spark.createDataFrame([r for a, b, km in rs for r in ((a, b, km), (b, a, km))], "from_node bigint, to_node bigint, distance_km double")
    trips = [(k, f"r{k % 2}", *rng.sample(range(n * n), 2)) for k in range(24)] + [(99, "r0", 5, 5)]
    asked = spark.createDataFrame(trips, "query_id int, region_id string, origin bigint, destination bigint")
    hazards = lambda nodes: spark.createDataFrame(nodes, "region_id string, node_id bigint")
    before = routing.shortest_paths(frame(roads), asked, hazards([("r0", 9)]))
    stored = cut_lineage(before)
    now, spread = frame([r for k, r in enumerate(roads) if k % 17]), hazards([("r0", 9), ("r1", 27), ("r0", 36)])
    got = routing.repair_paths(stored, now, asked, spread)
    rows = lambda df: sorted((r.query_id, r.graph_km, tuple(r.path)) for r in df.collect())
    found = got.collect()
    assert rows(got) == rows(routing.shortest_paths(now, asked, spread))
    again = sum(r.repaired for r in found)
    assert 0 < again < len(found) / 2
    same = routing.repair_paths(stored, frame(roads), asked, hazards([("r0", 9)]))
    assert not same.filter("repaired").count() and rows(same) == rows(stored)


def test_each_request_gets_its_routes(spark):
    routes = spark.createDataFrame([(1, "a", 3.0, "x", "now"), (2, "a", 4.0, "y", "now"), (3, "b", 5.0, "z", "now")], "query_id int, region_id string, distance_km double, route_id string, computed_at string")
    asked = spark.createDataFrame([("a", "7", "2024-01-01 00:00:00"), ("a", None, "2024-01-02 00:00:00"), ("c", "8", "2024-01-01 00:00:00")], "region_id string, prediction_id string, due_at string")
    got = routing.requested_routes(routes, asked.withColumn("due_at", F.col("due_at").cast("timestamp"))).collect()
    assert sorted((r.query_id, r.prediction_id) for r in got) == [(1, "7"), (1, "recompute"), (2, "7"), (2, "recompute")]
    assert len({r.route_id for r in got}) == 4
