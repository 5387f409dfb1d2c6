"""No caps: values outside the usual range, missing values, and numbers as other languages print them."""

import datetime as dt
import math

from conftest import rows
from pyspark.sql import functions as F

from perilgrid.functions import constants as K
from perilgrid.functions.columns import js_number, py_number
from perilgrid.operators import ask, buffers, features, health


def test_any_edge_weight_gives_the_softmax(spark):
    n = len(K.GRAPH_VECTOR)
    vec = {"a": [0.5] * n, "b": [(-1) ** k / n for k in range(n)], "c": [k / n / n for k in range(n)]}
    edges = [("a", "b", 1000.0), ("a", "c", -1000.0), ("b", "a", 150.0), ("b", "c", 0.5), ("c", "a", 1e6), ("c", "b", 1e6)]
    got = features.propagate(
        spark.createDataFrame(list(vec.items()), "region_id string, vec array<double>"),
        spark.createDataFrame(edges, "region_id string, neighbour_id string, edge_weight double"),
        rounds=1,
    )
    for region, out in rows(got, "region_id"):
        mine = [(nb, w * sum(x * q for x, q in zip(vec[nb], K.GRAPH_VECTOR))) for r, nb, w in edges if r == region]
        top = max(s for _, s in mine)
        z = sum(math.exp(s - top) for _, s in mine)
        want = [0.6 * vec[region][k] + 0.4 * sum(math.exp(s - top) * vec[nb][k] for nb, s in mine) / z for k in range(n)]
        assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(out, want))


def test_context_at_a_tiny_temperature_is_the_best_vector(spark):
    n = len(K.QUERY_VECTOR)
    best = [q / math.sqrt(sum(x * x for x in K.QUERY_VECTOR)) for q in K.QUERY_VECTOR]
    df = spark.createDataFrame([(best,), ([-x for x in best],), ([0.0] * n,)], "vec array<double>")
    (out,) = features.attention_context(df, 1e-4).first()
    assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(out, best))


def test_gap_below_a_minute(spark):
    t0 = dt.datetime(2024, 1, 1)
    times = [0, 29, 58, 88, 119, 148]
    df = spark.createDataFrame([("r", t0 + dt.timedelta(seconds=s)) for s in times], "region_id string, reported_at timestamp_ntz")
    got = [(r.n_reports, (r.recompute_at - t0).seconds) for r in buffers.blockage_sessions(df, 30).orderBy("first_report").collect()]
    assert got == [(3, 88), (1, 118), (2, 178)]


def test_gaps_keep_rows_without_sensor_or_time(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    data = [(1, "a", t(0)), (2, None, t(1)), (3, "a", None), (4, "a", t(90)), (5, None, t(41)), (6, None, None)]
    df = spark.createDataFrame(data, "reading_id int, sensor_id string, reading_ts timestamp_ntz")
    got = {r.reading_id: (r.gap_s, r.status_before) for r in health.feed_gaps(df).collect()}
    assert got == {1: (None, "ok"), 2: (None, "ok"), 3: (None, "ok"), 4: (5400.0, "unavailable"), 5: (2400.0, "degraded"), 6: (None, "ok")}


def test_number_text(spark):
    cases = {
        1e-4: ("0.0001", "0.0001"),
        4e-4: ("0.0004", "0.0004"),
        1e-7: ("1e-7", "1e-07"),
        1.5e-7: ("1.5e-7", "1.5e-07"),
        2.5e-6: ("0.0000025", "2.5e-06"),
        0.1 + 0.2: ("0.30000000000000004", "0.30000000000000004"),
        1e7: ("10000000", "10000000.0"),
        12345678.0: ("12345678", "12345678.0"),
        12345678.5: ("12345678.5", "12345678.5"),
        1e16: ("10000000000000000", "1e+16"),
        1e21: ("1e+21", "1e+21"),
        1.25e21: ("1.25e+21", "1.25e+21"),
        4.0: ("4", "4.0"),
        100.0: ("100", "100.0"),
        0.05: ("0.05", "0.05"),
        23.75: ("23.75", "23.75"),
        -0.0004: ("-0.0004", "-0.0004"),
        0.0: ("0", "0.0"),
    }
    df = spark.createDataFrame([(float(x),) for x in cases], "x double")
    got = df.select("x", js_number(F.col("x")), py_number(F.col("x"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == cases
    assert all(p == repr(x) for x, (_, p) in cases.items())
    assert spark.range(1).select(js_number(F.lit(None).cast("double"))).first()[0] is None


def test_region_whose_lower_case_is_longer(spark):
    q = spark.createDataFrame([(1, None, "risk in İzmir today")], "id int, asked_region string, question string")
    regions = spark.createDataFrame([("İzmir",), ("r1",)], "region_id string")
    assert ask.asked_regions(q, regions, ["id"]).first().region_id == "İzmir"
