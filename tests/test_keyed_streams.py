"""Operators with keyed state, fed out of order, late, repeated and through a restart, against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from perilgrid.operators import buffers, health
from perilgrid.streaming import jobs, keyed

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(autouse=True)
def state_store(spark):
    for k, v in keyed.state_settings().items():
        spark.conf.set(k, v)
    yield
    for k in keyed.state_settings():
        spark.conf.unset(k)


def put(spark, rows, schema, path, k):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in/b={k}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def drain(df, path, mode="append"):
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None


def plain(df, *cols):
    return sorted(tuple(str(x) for x in r) for r in df.select(*cols).collect())


def test_silence_events_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    feed = []
    for s in range(12):
        t = rng.randrange(60)
        while t < 1500:
            feed.append((f"s{s}", at(t)))
            t += rng.choice([5, 10, 29, 30, 31, 45, 60, 61, 200]) + rng.choice([0, 0.001, 0.5])
        if s == 3:  # silent from here on
            feed = [r for r in feed if r[0] != "s3" or r[1] < at(300)]
    feed += [(None, at(1501)), (None, at(4000))]
    feed.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(110)))  # shuffled within the lateness
    schema = "sensor_id string, reading_ts timestamp"
    half = len(feed) // 2
    for k, part in enumerate((feed[:half], feed[half:-1])):
        put(spark, part, schema, tmp_path, k)
    changes = lambda: keyed.feed_changes_stream(stream(spark, tmp_path, schema))
    drain(changes(), tmp_path)
    early = spark.read.parquet(f"{tmp_path}/out").count()
    put(spark, feed[-1:], schema, tmp_path, 2)
    drain(changes(), tmp_path)  # a new run goes on from the stored state
    got = spark.read.parquet(f"{tmp_path}/out")
    want = health.feed_changes(spark.createDataFrame(feed, schema), F.lit(at(4000 - 120)).cast("timestamp"))
    cols = ("sensor_id", "since", "status", "changed_at")
    assert 0 < early < got.count() and plain(got, *cols) == plain(want, *cols)
    assert {r.status for r in got.collect()} == {"ok", "degraded", "unavailable"}


def test_a_late_row_changes_nothing(spark, tmp_path):
    schema = "provider string, received_at timestamp"
    for k, rows in enumerate([[("p", at(0)), ("q", at(0))], [("q", at(400))], [("q", at(401))], [("p", at(30))], [("q", at(900))]]):
        put(spark, rows, schema, tmp_path, k)
    drain(keyed.provider_changes_stream(stream(spark, tmp_path, schema)), tmp_path)
    got = plain(spark.read.parquet(f"{tmp_path}/out"), "provider", "since", "status", "changed_at")
    assert got == [(p, str(at(a)), s, str(at(b))) for p, a, s, b in (("p", 0, "unavailable", 120), ("q", 0, "ok", 400), ("q", 0, "unavailable", 120), ("q", 401, "unavailable", 521))]


def test_newest_readings_equal_the_batch_form_after_each_batch(spark, load, tmp_path):
    r = load("sensor_readings").withColumn("reading_ts", F.col("reading_ts").cast("timestamp")).selectExpr(*[c.split()[0] for c in jobs.READING.split(", ")])
    dealt = r.withColumn("_k", F.pmod(F.xxhash64("reading_id"), F.lit(3))).cache()
    for k in range(3):
        dealt.filter(F.col("_k") == k).drop("_k").coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
    held, seen = {}, []

    def keep(batch, batch_id):
        touched = {}
        for row in batch.select("region_id", "reading_id", "recency").collect():
            touched.setdefault(row.region_id, {})[row.recency] = row.reading_id
        held.update(touched)
        seen.append({k: dict(v) for k, v in held.items()})

    def run():
        live = keyed.last_readings_stream(stream(spark, tmp_path, r.schema))
        q = live.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").outputMode("update").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None

    run()
    more = r.limit(5).withColumn("reading_ts", F.col("reading_ts") + F.expr("interval 90 days")).withColumn("reading_id", F.col("reading_id") + 10**9)
    more.coalesce(1).write.parquet(f"{tmp_path}/in/b=3")
    run()  # restarted
    order = [f"{tmp_path}/in/b={k}" for k in range(4)]
    assert len(seen) == 4
    # files of one run may come in any order, so the states after three and after four batches are compared
    for n in (3, 4):
        want = {}
        for row in buffers.last_readings(spark.read.schema(r.schema).parquet(*order[:n])).collect():
            want.setdefault(row.region_id, {})[row.recency] = row.reading_id
        assert seen[n - 1] == want


def test_idle_buffers_may_expire(spark, tmp_path):
    schema = "reading_id bigint, region_id string, reading_ts timestamp"
    put(spark, [(1, "r", at(0)), (2, None, None)], schema, tmp_path, 0)
    live = keyed.last_readings_stream(stream(spark, tmp_path, schema), 2, ttl_ms=3600_000)
    got = []
    q = live.writeStream.foreachBatch(lambda b, i: got.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/cp").outputMode("update").trigger(once=True).start()
    assert q.awaitTermination(60)
    assert q.exception() is None and sorted(got, key=str) == [(1, "r", at(0), 1), (2, None, None, 1)]


def test_late_and_repeated_rows_are_kept_apart(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        t = i * 2
        rows.append((i, rng.choice("abc"), at(t) if i % 40 else None, at(t + rng.choice([0, 1, 180, 300]))))
        if rng.random() < 0.3:
            rows.append((*rows[-1][:3], at(t + rng.choice([2, 50, 200]))))
    rows.append((None, None, at(5), at(6)))
    rows.sort(key=lambda r: r[3])
    schema = "id bigint, feed string, ts timestamp, arrived timestamp"
    n = len(rows) // 4 + 1
    for k in range(4):
        put(spark, rows[k * n : (k + 1) * n], schema, tmp_path, k)
        drain(keyed.arrival_fate_stream(stream(spark, tmp_path, schema), "feed", "id", "ts", "arrived"), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = buffers.arrival_fate(spark.createDataFrame(rows, schema), "feed", "id", "ts", "arrived")
    assert plain(got, "id", "feed", "ts", "arrived", "fate") == plain(want, "id", "feed", "ts", "arrived", "fate")
    assert got.count() == len(rows) and {r.fate for r in got.collect()} == {"kept", "late", "repeated"}


def test_breaches_come_from_the_stream_join(spark, load, tmp_path):
    ltz = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp"))
    p = ltz(load("predictions").select("prediction_id", "risk_level", "generated_at"), "generated_at")
    d = ltz(load("dispatches").filter("prediction_id % 7 <> 0").select("prediction_id", "dispatched_at"), "dispatched_at")
    tick = F.timestamp_seconds(F.lit(2_000_000_000))
    for k, (a, b) in enumerate([("prediction_id % 2 = 0", "prediction_id % 3 = 0"), ("prediction_id % 2 = 1", "prediction_id % 3 > 0")]):
        p.filter(a).coalesce(1).write.parquet(f"{tmp_path}/p/in/b={k}")
        d.filter(b).coalesce(1).write.parquet(f"{tmp_path}/d/in/b={k}")
    live = lambda: health.dispatch_outcomes(
        stream(spark, f"{tmp_path}/p", p.schema).withWatermark("generated_at", "20000 days"), stream(spark, f"{tmp_path}/d", d.schema).withWatermark("dispatched_at", "20000 days"))
    drain(live(), tmp_path)
    last = p.limit(1).select(F.lit(-1).cast("bigint").alias("prediction_id"), F.lit("High").alias("risk_level"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("generated_at"))
    last.coalesce(1).write.parquet(f"{tmp_path}/p/in/b=9")
    last.select("prediction_id", F.col("generated_at").alias("dispatched_at")).coalesce(1).write.parquet(f"{tmp_path}/d/in/b=9")
    drain(live(), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").filter("prediction_id >= 0")
    want = health.dispatch_outcomes(p, d)
    cols = ("prediction_id", "risk_level", "dispatched_at", "sla_breached")
    assert plain(got, *cols) == plain(want, *cols)
    assert plain(health.dispatch_outcomes_by_risk(got), "risk_level", "n_predictions", "n_breached") == plain(health.dispatch_outcomes_by_risk(want), "risk_level", "n_predictions", "n_breached")
    assert tick is not None


def test_outcomes_give_the_breach_rate_of_the_dispatches(load):
    outcomes = health.dispatch_outcomes(load("predictions"), load("dispatches"))
    got = {r.risk_level: (r.n_predictions, r.n_breached) for r in health.dispatch_outcomes_by_risk(outcomes).collect()}
    want = {r.risk_level: (r.n_alerts, r.n_breached) for r in health.alert_sla_by_risk(load("dispatches")).collect() if r.risk_level != "Low"}
    assert got == want
