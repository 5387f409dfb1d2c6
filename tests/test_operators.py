"""Small hand-made cases, most of them at the edges of a rule."""

import datetime as dt
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilgrid.functions import constants as K
from perilgrid.functions.columns import haversine_km, js_number, lookup, point_in_ring, py_number
from perilgrid.operators import alerts, ask, board, buffers, explain, geo, health, models, predict, reports, routing, skew, validate
from perilgrid.operators import features as fe
from perilgrid.plans.cycle import prediction_cycle
from perilgrid.sources import sinks, streams, tables

T0 = dt.datetime(2024, 1, 1)


def at(minutes=0, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


READING = "region_id string, reading_id int, reading_ts timestamp, " + ", ".join(f"{f} double" for f in K.SENSOR_FIELDS)


def readings(spark, *values, region="r1"):
    """Readings a minute apart; each value is a dict of sensor fields."""
    data = [(region, i, at(i), *[v.get(f) for f in K.SENSOR_FIELDS]) for i, v in enumerate(values)]
    return spark.createDataFrame(data, READING)


def buffer(spark, *values, **kw):
    return buffers.last_readings(readings(spark, *values, **kw))


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0]


# --- smoothing, context, graph --------------------------------------------------


def test_smoothing_equals_the_recursion(spark):
    series = [{"rainfall_mm": float(i * i % 7), "temperature_c": 20.0 - i} for i in range(10)]
    ema = one(fe.smooth(buffer(spark, *series))).ema
    for k, f in enumerate(K.SENSOR_FIELDS):
        e = series[0].get(f, 0.0)
        for row in series[1:]:
            e = 0.3 * row.get(f, 0.0) + 0.7 * e
        assert ema[k] == pytest.approx(e)


def test_smoothing_of_one_reading_and_of_alpha_one(spark):
    assert one(fe.smooth(buffer(spark, {"rainfall_mm": 4.0}))).ema[0] == 4.0
    assert one(fe.smooth(buffer(spark, {"rainfall_mm": 4.0}, {"rainfall_mm": 9.0}), alpha=1.0)).ema[0] == 9.0


@pytest.mark.parametrize("alpha", [0.0, -0.1, 1.1])
def test_bad_alpha(spark, alpha):
    with pytest.raises(ValueError):
        fe.smooth(buffer(spark, {}), alpha)


def test_vector_has_unit_length_and_matches_numpy(spark):
    row = {f: float(i + 1) for i, f in enumerate(K.SENSOR_FIELDS)}
    vec = np.array(one(fe.region_vectors(fe.smooth(buffer(spark, row)))).vec)
    want = np.array(list(row.values())) @ np.random.default_rng(42).standard_normal((6, 16))
    assert np.allclose(vec, want / np.linalg.norm(want))
    assert math.isclose(np.linalg.norm(vec), 1.0)


def test_null_reading_gives_the_zero_vector(spark):
    assert one(fe.region_vectors(fe.smooth(buffer(spark, {})))).vec == [0.0] * 16


def test_drought_vector_is_zero(spark):
    ema = fe.smooth(buffer(spark, {f: 5.0 for f in K.SENSOR_FIELDS}))
    by = {r.disaster_type: r.vec for r in fe.hazard_vectors(ema).collect()}
    assert by["drought"] == [0.0] * 16 and len(by) == 5
    assert all(math.isclose(np.linalg.norm(v), 1.0) for h, v in by.items() if h != "drought")


def vectors(spark, mapping):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in mapping.items()], "region_id string, vec array<double>")


@pytest.mark.parametrize("temperature", [1.0, 0.25, 0.005])
def test_context_matches_softmax(spark, temperature):
    rng = np.random.default_rng(3)
    m = {f"r{i}": v / np.linalg.norm(v) for i, v in enumerate(rng.standard_normal((5, 16)))}
    mat = np.stack(list(m.values()))
    s = mat @ np.array(K.QUERY_VECTOR) / temperature
    w = np.exp(s - s.max())
    want = (w[:, None] * mat).sum(0) / w.sum()
    got = fe.with_context(vectors(spark, m), temperature).collect()
    assert len(got) == 5 and all(np.allclose(r.context, want) for r in got)


def test_context_refuses_no_temperature(spark):
    with pytest.raises(ValueError):
        fe.attention_context(vectors(spark, {"r": [0] * 16}), 0.0)


def test_propagate_matches_numpy(spark):
    rng = np.random.default_rng(5)
    cur = {f"r{i}": v / np.linalg.norm(v) for i, v in enumerate(rng.standard_normal((4, 16)))}
    edges = [("r0", "r1", 0.5), ("r0", "r2", 1.0), ("r1", "r0", 0.3), ("r2", "gone", 0.9)]
    got = {r.region_id: r.vec for r in fe.propagate(
        vectors(spark, cur), spark.createDataFrame(edges, "region_id string, neighbour_id string, edge_weight double")).collect()}
    a = np.array(K.GRAPH_VECTOR)
    for _ in range(2):
        nxt = {}
        for r, own in cur.items():
            near = [(cur[n], w) for x, n, w in edges if x == r and n in cur]
            if not near:
                nxt[r] = own
                continue
            s = np.array([v @ a * w for v, w in near])
            e = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            nxt[r] = 0.6 * own + 0.4 * sum(x * v for x, (v, _) in zip(e, near))
        cur = nxt
    assert got.keys() == cur.keys() and all(np.allclose(got[r], cur[r]) for r in cur)


def test_fields_move_in_place_of_their_projections(spark):
    rng = np.random.default_rng(6)
    fields = ("rainfall_mm", "river_level_m", "soil_moisture_pct")
    rows = [(slot, f"r{i}", [0.0] * 6 if i == 4 else [float(x) for x in rng.standard_normal(6)]) for slot in (1, 2) for i in range(5)]
    ema = spark.createDataFrame(rows, "slot int, region_id string, ema array<double>")
    edges = [(f"r{i}", f"r{j}", float(w)) for i, j, w in [(0, 1, 0.5), (0, 2, 1), (1, 0, 900), (1, 2, -900), (2, 4, 1), (4, 0, 0.2), (4, 3, 0.1)]]
    roads = spark.createDataFrame(edges, "region_id string, neighbour_id string, edge_weight double")
    by = ("slot",)
    whole, parts = fe.region_vectors(ema, fields, by), fe.region_parts(ema, fields, by)
    moved = fe.propagate(parts, roads, by=by, weights=fe.seen_by(fields, K.GRAPH_VECTOR))
    near = lambda a, b: all(x[:-1] == y[:-1] and np.allclose(x[-1], y[-1], rtol=0, atol=1e-12) for x, y in zip(sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect())), strict=True))
    assert near(fe.projected(parts, fields), whole)
    assert near(fe.projected(moved, fields), fe.propagate(whole, roads, by=by))
    assert {len(r.vec) for r in moved.collect()} == {3}
    given = [fe.with_context(whole, 0.5, *with_) for with_ in ((whole, by), (parts, by, fields))]
    assert near(*[g.select("slot", "region_id", "context") for g in given])


def test_history_sends_no_projections(spark, load):
    from perilgrid.plans.history import cycle_history

    plan = cycle_history(load("sensor_readings"), load("region_adjacency"), 19724, 19725, 86400)._jdf.queryExecution().executedPlan().toString()
    # sums of messages: one for each field and none for the other components
    assert not [line for line in plan.split("\n") if "Aggregate" in line and "[15])" in line]


# --- feature sets ---------------------------------------------------------------


def test_drought_series(spark):
    dry = fe.drought_features(buffer(spark, *[{"rainfall_mm": x} for x in (10.0, 10.0, 2.0)])).orderBy("reading_id").collect()
    assert dry[-1].rainfall_deficit_mm == -2.0
    wet = fe.drought_features(buffer(spark, *[{"rainfall_mm": x} for x in (5.0, 5.0, 20.0)])).orderBy("reading_id").collect()
    assert wet[-1].rainfall_deficit_mm == 0.0
    trend = fe.drought_features(buffer(spark, {"soil_moisture_pct": 40.0}, {"soil_moisture_pct": 35.0})).orderBy("reading_id").collect()
    assert [r.soil_moisture_trend for r in trend] == [0.0, -5.0]
    odd = fe.drought_features(buffer(spark, {"temperature_c": 20.0}, {"temperature_c": 30.0}), 7).orderBy("reading_id").collect()
    assert [r.temperature_anomaly_c for r in odd] == [-5.0, 5.0] and odd[0].rolling_window_days == 7.0


def test_missing_terrain_is_zero(spark):
    buf = buffer(spark, {"rainfall_mm": 12.0})
    ground = spark.createDataFrame([("r9", 50.0, 3.0)], "region_id string, elevation_m double, slope_gradient double")
    row = one(fe.flood_features(buf, ground))
    assert (row.elevation, row.drainage_capacity, row.rainfall_mm) == (0.0, 0.0, 12.0)
    assert one(fe.landslide_features(buf)).terrain_slope == 0.0


def test_heatwave_flag_and_humidity(spark):
    buf = buffer(spark, {"soil_moisture_pct": 70.0, "temperature_c": 35.0})
    assert one(fe.heatwave_features(buf)).historical_heatwave_flag == 0.0
    flags = spark.createDataFrame([("r1", 1)], "region_id string, historical_heatwave_flag int")
    row = one(fe.heatwave_features(buf, flags))
    assert (row.historical_heatwave_flag, row.humidity) == (1.0, 70.0)


def test_cyclone_defaults(spark):
    row = one(fe.cyclone_features(buffer(spark, {"wind_speed_kmh": 15.0, "wind_direction_deg": 180.0})))
    assert (row.wind_speed_kmh, row.sea_surface_temp_c, row.cloud_density) == (15.0, 0.0, 0.0)


def test_satellite_switch(spark):
    cnn = spark.createDataFrame([("r1", at(10))], "region_id string, extracted_at timestamp")
    quiet = spark.createDataFrame([(at(20),)], "unavailable_since timestamp")
    assert one(buffers.satellite_switch(cnn, quiet)).available is False
    assert one(buffers.satellite_switch(cnn, quiet.filter("false"))).available is True


# --- prediction -----------------------------------------------------------------


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        predict.ensemble_score(vectors(spark, {"r": [0] * 16}), {"flood": (0.9, 0.9)})


def test_unknown_hazard_uses_halves(spark):
    v = vectors(spark, {"r": K.SCORE_VECTOR}).withColumns({"disaster_type": F.lit("ashfall"), "context": F.array(*[F.lit(0.0)] * 16)})
    x = 0.5 * sum(a * a for a in K.SCORE_VECTOR)
    assert one(predict.ensemble_score(v)).raw_pct == pytest.approx(100 / (1 + math.exp(-x)))


@pytest.mark.parametrize("p,risk,tti", [(34.999, "Low", None), (35.0, "Medium", 24.0), (64.9, "Medium", 24 * (1 - 29.9 / 65)), (65.0, "High", 24 * (1 - 30 / 65)), (100.0, "High", 0.0)])
def test_risk_and_time_to_impact(spark, p, risk, tti):
    df = spark.createDataFrame([(p, 24, 0.92)], "probability_pct double, forecast_horizon_h int, discount double")
    row = one(predict.judge(df))
    assert row.risk_level == risk and (row.time_to_impact_h is None if tti is None else row.time_to_impact_h == pytest.approx(tti))
    assert row.severity_index == pytest.approx(p * 0.9 * 0.92)


def test_horizon_discounts(spark):
    df = spark.createDataFrame([(50.0,)], "raw_pct double")
    got = {r.forecast_horizon_h: r.probability_pct for r in predict.fan_out_horizons(df, (6, 24, 72, 48)).collect()}
    assert got == pytest.approx({6: 50.0, 24: 46.0, 72: 41.0, 48: 50.0})


def test_forecasts_dilute_the_buffer(spark):
    rows = readings(spark, {"rainfall_mm": 8.0, "soil_moisture_pct": 30.0}).withColumns({"sensor_id": F.lit("s"), "stream_status": F.lit("ok")})
    near = spark.createDataFrame([], "region_id string, neighbour_id string, edge_weight double")
    sky = spark.createDataFrame([("r2", at(5)), (None, at(5))], "region_id string, fetched_at timestamp")
    plain = prediction_cycle(rows, near, F.lit(at(60)))
    both = prediction_cycle(rows, near, F.lit(at(60)), forecasts=sky)
    # a region known only by a forecast joins in with the zero vector
    assert plain.count() == 15 and both.count() == 30
    later = prediction_cycle(rows, near, F.lit(at(60)), forecasts=sky.withColumn("region_id", F.lit("r1")), buffer_size=1)
    assert {round(r.probability_pct, 6) for r in later.filter("forecast_horizon_h = 6").collect()} == {50.0}


def test_clamp(spark):
    row = one(validate.clamp_scores(spark.createDataFrame([(150.0, -5.0)], "probability_pct double, severity_index double")))
    assert (row.probability_pct, row.severity_index) == (100.0, 0.0)


# --- validation -----------------------------------------------------------------


def test_plausible_bounds_are_inclusive(spark):
    edge = [(60.0, 100.0, 360.0), (60.01, 50.0, 0.0), (-90.0, 0.0, 0.0), (0.0, 100.5, 0.0), (0.0, 0.0, 361.0), (None, None, None)]
    df = spark.createDataFrame(edge, "temperature_c double, soil_moisture_pct double, wind_direction_deg double")
    df = df.withColumns({c: F.lit(0.0) for c in ("rainfall_mm", "river_level_m", "wind_speed_kmh")})
    assert [r.is_anomalous for r in validate.flag_anomalous(df).collect()] == [False, True, False, True, True, False]


def test_optional_filter_with_nothing_given_is_the_table(spark, load):
    p = load("predictions")
    assert validate.optional_filter(p, "generated_at") is p


def test_contract_json_and_types(spark):
    texts = ["not json", "[1]", '{"forecast_id":"f","region_id":5,"fetched_at":"x","provider":null,"temperature_c":null,"forecast_horizon_h":6.5,"zz":1}']
    df = validate.contract_violations(spark.createDataFrame([(t,) for t in texts], "value string"), "weather_schema")
    got = [r.violations for r in df.collect()]
    assert got[0] == ["json"] and got[1] == ["json"]
    assert got[2] == ["extra:zz", "type:forecast_horizon_h", "type:provider", "type:region_id"]


# --- feeds ----------------------------------------------------------------------


def test_feed_gaps_across_slices(spark):
    data = [("a", i, at(m)) for i, m in enumerate((0, 29, 59, 119, 120, 600))] + [("b", 9, at(3))]
    df = spark.createDataFrame(data, "sensor_id string, reading_id int, reading_ts timestamp")
    got = {r.reading_id: r.status_before for r in health.feed_gaps(df).collect()}
    assert got == {0: "ok", 1: "ok", 2: "degraded", 3: "unavailable", 4: "ok", 5: "unavailable", 9: "ok"}


@pytest.mark.parametrize("share", [0.01, 0.5])
def test_sliced_lag_against_brute_force(spark, share):
    rnd = random.Random(6)
    pts = [("a", i, at(seconds=rnd.randrange(0, 3000))) for i in range(200)] + [("b", 500 + i, at(minutes=rnd.randrange(0, 900))) for i in range(40)]
    df = spark.createDataFrame(pts, "sensor_id string, reading_id int, reading_ts timestamp")
    got = {r.reading_id: r.prev_micros for r in skew.sliced_lag(df, ["sensor_id"], "reading_ts", "reading_id", share=share).collect()}
    want = {}
    for s in "ab":
        line = sorted((t, i) for k, i, t in pts if k == s)
        for before, (t, i) in zip([None, *line], line):
            want[i] = None if before is None else round(before[0].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert got == want


def test_gov_payload_forms(spark):
    texts = ['{"record_id":"1","source":"s"}', ' [{"record_id":"2"},{"record_id":"3","fetched_at":"t"}]', "oops"]
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    got = sorted((r.record_id, r.source, r.fetched_at == "t") for r in streams.gov_records(df, F.lit("feed")).collect() if r.record_id)
    assert got == [("1", "s", False), ("2", "feed", False), ("3", "feed", True)]


def test_region_feed_drops_rows_without_region(spark, load):
    fed = tables.region_feed(load("sensor_readings"), load("weather_forecasts"))
    assert fed.filter("region_id is null").isEmpty() and fed.filter("kind = 'weather'").count() > 0


# --- windows --------------------------------------------------------------------


def brute_trailing(points, seconds):
    return {(k, t): sum(1 for k2, t2 in points if k2 == k and t - dt.timedelta(seconds=seconds) <= t2 <= t) for k, t in points}


def test_trailing_count_against_brute_force(spark):
    rnd = random.Random(4)
    pts = [(rnd.choice("ab"), at(seconds=rnd.randrange(0, 20000))) for _ in range(300)]
    pts += [("a", at(0)), ("a", at(60)), ("a", at(60)), ("a", at(seconds=3600 * 2))]  # exact edges and ties
    df = spark.createDataFrame(pts, "k string, ts timestamp")
    got = {(r.k, dt.datetime.fromtimestamp(r.at_micros / 1e6, dt.timezone.utc).replace(tzinfo=None)): r.trailing
           for r in skew.trailing_count(df, ["k"], "ts", 3600).collect()}
    assert got == brute_trailing(pts, 3600)


def test_debounce_edges(spark):
    data = [(1, "r", at(0)), (2, "r", at(9, 59)), (3, "r", at(19, 59)), (4, "r", at(30)), (5, None, at(1)), (6, "q", at(2))]
    df = spark.createDataFrame(data, "report_id int, region_id string, reported_at timestamp")
    got = sorted((r.region_id, r.first_report, r.recompute_at, r.n_reports) for r in buffers.blockage_sessions(df).collect())
    # a gap of exactly ten minutes closes the session
    assert got == [("q", at(2), at(12), 1), ("r", at(0), at(19, 59), 2), ("r", at(19, 59), at(29, 59), 1), ("r", at(30), at(40), 1)]


def test_blockage_words(spark):
    texts = ["Road BLOCKED", "roadside flooding", "the road is open", "closed", None]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    assert [r[0] for r in df.select(reports.tells_of_blockage(F.col("d"))).collect()] == [True, True, False, False, False]


# --- skew -----------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, how):
    many = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"))
    few = spark.range(60).select((F.col("id") % 30).alias("k"), (F.col("id") * 10).alias("v"))
    key = sorted if how in ("left_semi", "left_anti") else lambda x: sorted(x, key=str)
    a = key([tuple(r) for r in skew.skew_safe_join(many, few, ["k"], how, share=0.02).collect()])
    b = key([tuple(r) for r in many.join(few, ["k"], how).collect()])
    assert a == b and a


def test_null_keys_are_kept_and_spread(spark):
    many = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("k"))
    few = spark.createDataFrame([(1, "x"), (None, "never")], "k bigint, v string")
    a = sorted(map(str, skew.skew_safe_join(many, few, ["k"], "left").collect()))
    assert a == sorted(map(str, many.join(few, ["k"], "left").collect()))


def test_hot_keys_are_few(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, -1).otherwise(F.col("id")).alias("k"))
    assert [r.k for r in skew.hot_keys(df, ["k"]).collect()] == [-1]


def test_skew_join_spreads_the_hot_key(spark):
    many = spark.range(900).select("id", F.lit(1).alias("k"))
    # the key holds all rows, so it is spread over all four partitions
    assert [r._parts for r in skew.hot_keys(many, ["k"]).collect()] == [4]
    joined = skew.skew_safe_join(many, spark.createDataFrame([(1, "x")], "k int, v string"), ["k"])
    assert joined.count() == 900


# --- places and routes ------------------------------------------------------------

L_SHAPE = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)]
ZONE = "zone_id int, region_id string, hazard_type string, ring array<struct<lon:double,lat:double>>"


def test_point_in_ring(spark):
    pts = [(0.5, 1.5, True), (1.5, 1.5, False), (1.5, 0.5, True), (3.0, 0.5, False), (-0.1, 0.1, False)]
    df = spark.createDataFrame([(x, y, L_SHAPE) for x, y, _ in pts], "lon double, lat double, ring array<struct<lon:double,lat:double>>")
    assert [r[0] for r in df.select(point_in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).collect()] == [p[2] for p in pts]


def test_locate_takes_the_least_region_else_null(spark):
    zones = spark.createDataFrame([(1, "r2", "x", L_SHAPE), (2, "r1", "x", [(0.0, 0.0), (0.6, 0.0), (0.6, 2.0), (0.0, 2.0)])], ZONE)
    pts = spark.createDataFrame([(1, 1.5, 0.5), (2, 0.5, 1.5), (3, 1.5, 1.5)], "id int, lat double, lon double")
    assert {r.id: r.region_id for r in geo.locate(pts, zones, "id").collect()} == {1: "r1", 2: "r2", 3: None}


def test_haversine(spark):
    df = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km"))
    assert one(df).km == pytest.approx(6371 * math.pi / 180)


def dijkstra(edges, start, end, bad):
    import heapq

    best, heap = {}, [(0.0, [start])]
    while heap:
        d, path = heapq.heappop(heap)
        if path[-1] in best:
            continue
        best[path[-1]] = (d, path)
        for a, b, km in edges:
            if a == path[-1] and b not in best and b not in bad:
                heapq.heappush(heap, (d + km, [*path, b]))
    return best.get(end)


def test_shortest_paths_against_dijkstra(spark):
    rnd = random.Random(8)
    pairs = {(rnd.randrange(12), rnd.randrange(12)) for _ in range(34)}
    edges = [(a, b, float(rnd.randrange(1, 9))) for a, b in pairs if a != b]
    trips = [(i, rnd.choice(["x", "y"]), rnd.randrange(12), rnd.randrange(12)) for i in range(10)]
    bad = [("x", 3), ("x", 7), ("y", 5)]
    got = {r.query_id: (r.graph_km, r.path) for r in routing.shortest_paths(
        spark.createDataFrame(edges, "from_node int, to_node int, distance_km double"),
        spark.createDataFrame(trips, "query_id int, region_id string, origin int, destination int"),
        spark.createDataFrame(bad, "region_id string, node_id int")).collect()}
    want = {}
    for q, region, a, b in trips:
        hit = dijkstra(edges, a, b, {n for r, n in bad if r == region})
        if hit:
            want[q] = hit
    assert got == want and 0 < len(want) < len(trips)


def test_one_blocked_edge_closes_its_road(spark):
    e = spark.createDataFrame([(1, 1, 2, 1.0, "A", True), (2, 2, 3, 1.0, "A", False), (3, 3, 4, 1.0, "B", False)],
                              "edge_id int, from_node int, to_node int, distance_km double, road_id string, is_blocked boolean")
    got = sorted((r.from_node, r.to_node) for r in routing.usable_edges(e, tables.road_network(e)).collect())
    assert got == [(3, 4), (4, 3)]


def test_route_record(spark):
    paths = spark.createDataFrame([(1, "r", 10, 12, 2.0, [10, 11, 12])], "query_id int, region_id string, origin int, destination int, graph_km double, path array<int>")
    nodes = spark.createDataFrame([(10, 0.0, 0.0, "start"), (11, 0.0, 1.0, None), (12, 0.0, 2.0, "end")], "node_id int, lat double, lon double, label string")
    haz = spark.createDataFrame([("r", n) for n in (9, 8, 7, 6, 5, 4)], "region_id string, node_id int")
    row = one(routing.route_records(paths, nodes, haz, F.lit(T0)))
    km = 2 * 6371 * math.pi / 180
    assert (row.distance_km, row.estimated_duration_min) == (round(km, 2), round(km / 40 * 60, 1))
    assert row.origin.label == "start" and row.destination.label == "end" and [w.lon for w in row.waypoints] == [1.0]
    assert row.avoids == [4, 5, 6, 7, 8]


# --- alerts -----------------------------------------------------------------------


def test_language_resolution(spark):
    codes = {"en": "en", "en-GB": "en", "hi-IN": "hi", " fr ": "fr", "de": "en", "": "en", None: "en", "pt-BR": "en"}
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r[0] for r in df.select(alerts.resolve_language(F.col("c"))).collect()] == list(codes.values())


def test_message_texts(spark):
    df = spark.createDataFrame([("flood", "High", 4.0, "en-GB"), ("cyclone", "Medium", None, "fr")],
                               "disaster_type string, risk_level string, time_to_impact_h double, language_code string")
    a, b = alerts.localised(df).collect()
    assert a.title == "High Risk: flood"
    assert a.body == "[HIGH RISK] flood alert for your region. Risk level: High. Estimated time to impact: 4h."
    assert b.body == "[RISQUE MOYEN] Alerte cyclone pour votre région. Niveau de risque : Medium."
    assert b.recommended_action.endswith("un kit d'urgence.")


def outcome(spark, channel, phone, log):
    df = spark.createDataFrame([(7, 1, channel, phone)], "prediction_id int, user_id int, channel string, phone_number string")
    # another send of the same user came out the other way
    other = [(8, 1, channel, t, n, not ok) for t, n, ok in log]
    tries = spark.createDataFrame(
        [(7, 1, channel, *t) for t in log] + other + [(7, 9, channel, "sms", 0, True)],
        "prediction_id int, user_id int, channel string, transport string, attempt int, ok boolean",
    )
    r = one(alerts.delivery_outcomes(df, tries))
    return r.sent_channel, r.delivery_status, r.retry_count


def test_delivery_rules(spark):
    no = [("sms", i, False) for i in range(4)]
    late = [("sms", 0, False), ("sms", 1, False), ("sms", 2, True)]
    assert outcome(spark, "sms", "+1", late) == ("sms", "sent", 2)
    assert outcome(spark, "sms", "+1", no) == ("sms", "failed", 3)
    assert outcome(spark, "push", None, [("push", 0, True)]) == ("push", "sent", 0)
    assert outcome(spark, "push", None, [("push", 0, False)]) == ("push", "failed", 0)
    assert outcome(spark, "push", "+1", [("push", 0, False), *late]) == ("sms", "sent", 2)
    assert outcome(spark, "voice", "+1", [("voice", 0, False), ("sms", 0, True)]) == ("voice", "sent", 0)
    assert outcome(spark, "voice", "+1", [("voice", 0, False), *late]) == ("voice", "failed", 0)
    assert outcome(spark, "sms", "+1", []) == ("sms", "failed", 3)


def test_number_texts(spark):
    df = spark.createDataFrame([(4.0,), (4.25,)], "x double")
    assert [tuple(r) for r in df.select(js_number(F.col("x")), py_number(F.col("x"))).collect()] == [("4", "4.0"), ("4.25", "4.25")]


# --- explanations -------------------------------------------------------------------


def explained(spark, hazard, risk, values):
    df = spark.createDataFrame([(1, hazard, risk, values)], "prediction_id int, disaster_type string, risk_level string, feature_values map<string,double>")
    return one(explain.with_summary(explain.pad_factors(explain.with_factors(df))))


def test_factors_are_padded_in_table_order(spark):
    row = explained(spark, "flood", "High", {"rainfall_mm": 10.0})
    assert [(f.feature_name, f.contribution_pct) for f in row.factors] == [("rainfall_mm", 100.0), ("river_level_m", 1.0), ("soil_moisture_pct", 1.0)]
    assert row.plain_language_summary == "Flood risk is High due to: heavy rainfall (100.0%), rising river levels (1.0%), high soil moisture (1.0%)."
    assert len(explained(spark, "flood", "Low", {"rainfall_mm": 10.0}).factors) == 1


def test_unknown_hazard_weighs_equally(spark):
    row = explained(spark, "ashfall", "Low", {"dust_load": 1.0, "wind_speed_kmh": -1.0})
    assert sorted((f.feature_name, f.contribution_pct, f.direction) for f in row.factors) == [
        ("dust_load", 50.0, "positive"), ("wind_speed_kmh", 50.0, "negative")]
    assert "dust load (50.0%)" in row.plain_language_summary
    assert explained(spark, "ashfall", "Medium", {}).plain_language_summary == "Ashfall risk is Medium."


# --- boards and questions --------------------------------------------------------------


def test_ratios_are_null_on_zero(spark):
    p = spark.createDataFrame([(1, "flood", "Low", T0)], "prediction_id int, disaster_type string, risk_level string, generated_at timestamp")
    o = spark.createDataFrame([(1, True), (1, True)], "prediction_id int, actual_occurred boolean")
    r = one(board.accuracy(p, o))
    assert (r.false_negatives, r.precision, r.recall, r.false_alarm_rate) == (2, None, 0.0, None)


def test_region_mention_rules(spark):
    regions = spark.createDataFrame([("ab",), ("abc",), ("Zed-1",)], "region_id string")
    q = spark.createDataFrame([(1, "is ABC fine", None), (2, "zed-1?", None), (3, "a", None), (4, "abc", "elsewhere"), (5, "  ", None)],
                              "id int, question string, asked_region string")
    got = {r.id: (r.region_id, r.intent) for r in ask.classify(q, regions, ["id"]).collect()}
    assert got == {1: ("ab", "risk_query"), 2: ("Zed-1", "risk_query"), 3: (None, "location_clarification"), 4: ("elsewhere", "risk_query")}


@pytest.mark.parametrize("text,intent", [("Is it SAFE", "safety_recommendation"), ("what should I pack to travel", "safety_recommendation"),
                                         ("What to do now", "precautionary_actions"), ("rain?", "risk_query")])
def test_intents(spark, text, intent):
    assert one(spark.createDataFrame([(text,)], "q string").select(ask.intent(F.col("q")).alias("i"))).i == intent


# --- models and sinks -------------------------------------------------------------------


def png(path, pixels):
    """A tiny RGB PNG written by hand."""
    raw = b"".join(b"\x00" + bytes(c for px in row for c in px) for row in pixels)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files(spark, tmp_path):
    png(tmp_path / "a.png", [[(0, 0, 255), (255, 255, 255)], [(0, 255, 0), (0, 255, 0)]])
    row = one(models.with_image_model(spark.read.format("image").load(str(tmp_path))))
    assert (row.flood_inundation_pct, row.cloud_density) == (25.0, 0.25)
    assert row.vegetation_index == pytest.approx(1.0, abs=1e-6)


def test_user_head_in_batches(spark):
    v = vectors(spark, {"a": [1] * 16, "b": [2] * 16}).withColumns({"disaster_type": F.lit("flood"), "context": F.array(*[F.lit(0.5)] * 16)})
    got = {r.region_id: r.raw_pct for r in models.with_head(v, lambda vec, ctx, hazard: (vec + ctx).sum(axis=1)).collect()}
    assert got == {"a": 24.0, "b": 40.0}


def test_points_are_partitioned(spark, load, tmp_path):
    sinks.write_points(load("predictions"), str(tmp_path / "pts"))
    back = spark.read.parquet(str(tmp_path / "pts"))
    assert back.count() == load("predictions").count() and back.filter("time_to_impact_h = -1").count() > 0
    assert {p.name for p in (tmp_path / "pts").iterdir() if p.is_dir()} == {f"disaster_type={h}" for h in K.HAZARDS}


def test_lookup_escapes_quotes(spark):
    df = spark.createDataFrame([("a",)], "k string").select(lookup("k", {"a": "it's \\ here"}, "none").alias("v"))
    assert one(df).v == "it's \\ here"


def test_one_region_with_most_users(spark):
    users = spark.createDataFrame(
        [(i, ["big"] if i % 10 else ["small"], "en", f"+{i}", None, ["sms"]) for i in range(300)],
        "user_id int, region_ids array<string>, language_code string, phone_number string, push_token string, notification_channels array<string>",
    )
    p = spark.createDataFrame([(1, "big", "flood", "High", 3.0), (2, "big", "flood", "Low", None), (3, "small", "flood", "Medium", None)],
                              "prediction_id int, region_id string, disaster_type string, risk_level string, time_to_impact_h double")
    tries = spark.createDataFrame([(1, 11, "sms", "sms", 1, True)], "prediction_id int, user_id int, channel string, transport string, attempt int, ok boolean")
    got = alerts.alert_records(p, users, tries, F.lit("2024-01-01").cast("timestamp")).collect()
    assert len(got) == 300 and all(r.dispatched_at is not None for r in got)
    assert [(r.prediction_id, r.user_id, r.retry_count) for r in got if r.delivery_status == "sent"] == [(1, 11, 1)]


def test_outcomes_are_looked_up_without_moving_the_sends(spark):
    users = spark.createDataFrame(
        [(i, ["big", "big", "other"] if i % 2 else ["big"], "en", f"+{i}" if i % 3 else None, "t", ["sms", "push", "voice"]) for i in range(150)]
        + [(7, ["big"], "fr", "+7", None, ["sms"]), (None, ["big"], "en", "+", "t", ["push"])],
        "user_id bigint, region_ids array<string>, language_code string, phone_number string, push_token string, notification_channels array<string>",
    )
    p = spark.createDataFrame([(1, "big", "High"), (1, "other", "High"), (2, "big", "Low"), (3, "other", "Medium"), (3, "other", "Medium"), (4, "none", "High")],
                              "prediction_id int, region_id string, risk_level string")
    tries = [(n, u, c, t, k, (u + k + n) % 3 == 0) for n in (1, 2, 3, 9) for u in range(0, 400, 3) for c in ("sms", "push", "voice") for t, k in ((c, 0), ("sms", 1), ("sms", 2))]
    tries = spark.createDataFrame([*tries, (1, None, "push", "push", 0, True)], "prediction_id int, user_id int, channel string, transport string, attempt int, ok boolean")
    names = ["prediction_id", "region_id", "user_id", "channel", "language_code", "delivery_status", "retry_count", "sent_channel"]
    cut = lambda df: sorted(map(str, df.select(*names).collect()))
    got = alerts.delivered(p, users, tries)
    assert cut(got) == cut(alerts.delivery_outcomes(alerts.sends(p, users), tries)) and got.count() > 800
    # the join that makes the sends is the last one: none of its rows is moved again
    plan = alerts.alert_records(p.withColumns({"disaster_type": F.lit("flood"), "time_to_impact_h": F.lit(1.0)}), users, tries, F.current_timestamp())
    top = plan._jdf.queryExecution().executedPlan().toString().split("Join ")[1].split("\n")[0]
    assert "region_id" in top and "user_id" not in top


def test_outcomes_shuffle_little_more_than_what_they_read(spark):
    users = spark.range(640).selectExpr("id as user_id", "array('big') as region_ids", "'en' as language_code", "concat('+', id) as phone_number", "'t' as push_token", "array('sms') as notification_channels")
    p = spark.range(160).selectExpr("id as prediction_id", "'big' as region_id", "'High' as risk_level")
    tries = spark.range(160).selectExpr("id as prediction_id", "id * 3 as user_id", "'sms' as channel", "'sms' as transport", "0 as attempt", "id % 4 <> 0 as ok")
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}

    def moved(node):
        metric = node.metrics().get("shuffleRecordsWritten")
        children = [node.children().apply(i) for i in range(node.children().size())]
        return (metric.get().value() if metric.isDefined() else 0) + sum(map(moved, children))

    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        out = alerts.delivered(p, users, tries)
        got = out.collect()
        rows_moved = moved(out._jdf.queryExecution().executedPlan())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 640 * 160 and {(r.prediction_id, r.user_id) for r in got if r.delivery_status == "sent"} == {(i, 3 * i) for i in range(160) if i % 4}
    assert 0 < rows_moved < 6 * (640 + 160 + 160)


def test_outcomes_over_many_blocks_of_seats_and_predictions(spark, monkeypatch):
    monkeypatch.setattr(alerts, "SEATS_PER_BLOCK", 8)
    monkeypatch.setattr(alerts, "PREDICTIONS_PER_BLOCK", 4)
    users = [(i, [f"r{i % 3}", "r0"], "en", f"+{i}" if i % 3 else None, "t" if i % 5 else None, ["sms", "push", "voice"]) for i in range(60)]
    users += [(5, ["r2"], "fr", "+5", "t", ["sms"]), (None, ["r0"], "en", "+", "t", ["push", None])]
    users = spark.createDataFrame(users, "user_id bigint, region_ids array<string>, language_code string, phone_number string, push_token string, notification_channels array<string>")
    p = [(i, f"r{i % 2}", "High") for i in range(50)] + [(4, "r0", "Medium"), (4, "r2", "High"), (None, "r1", "High"), (60, None, "High"), (61, "r1", "Low")]
    p = spark.createDataFrame(p, "prediction_id int, region_id string, risk_level string")
    tries = [(n, u, c, t, k, (u * 7 + n + k) % 4 == 0) for n in range(0, 64, 2) for u in range(0, 70, 3) for c in ("sms", "push", "voice") for t, k in ((c, 0), ("sms", 1), ("sms", 3))]
    tries = spark.createDataFrame([*tries, (None, 3, "sms", "sms", 0, True), (1, None, "push", "push", 0, True)], "prediction_id bigint, user_id int, channel string, transport string, attempt int, ok boolean")
    names = ["prediction_id", "region_id", "risk_level", "user_id", "channel", "language_code", "phone_number", "delivery_status", "retry_count", "sent_channel"]
    cut = lambda df: sorted(map(str, df.select(*names).collect()))
    got = cut(alerts.delivered(p, users, tries))
    assert got == cut(alerts.delivery_outcomes(alerts.sends(p, users), tries))
    assert len(got) > 2000 and sum("'sent'" in r for r in got) > 80
