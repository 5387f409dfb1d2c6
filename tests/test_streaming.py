"""Each stream is fed in several files and compared with the batch operator on the same rows."""

import pytest
from pyspark.sql import functions as F

from perilgrid.operators import board, buffers, reports, validate
from perilgrid.sources import streams
from perilgrid.streaming import jobs, keyed
from perilgrid.streaming.parts import HourLog, KeyLog, PartTable


@pytest.fixture(autouse=True)
def state_store(spark):
    for k, v in keyed.state_settings().items():
        spark.conf.set(k, v)
    yield
    for k in keyed.state_settings():
        spark.conf.unset(k)


def ordered_files(df, path, order, n):
    """n files with names, and so arrival times, in the order of ``order``."""
    from pyspark.sql import Window

    tiles = df.withColumn("_t", F.ntile(n).over(Window.orderBy(order))).cache()
    for i in range(1, n + 1):
        tiles.filter(F.col("_t") == i).drop("_t").coalesce(1).write.mode("append").parquet(f"{path}/in")
    return tiles.drop("_t")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def finish(writer):
    q = writer.start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def same(a, b):
    cols = sorted(a.columns)
    left, right = (sorted(map(str, df.select(cols).collect())) for df in (a, b))
    assert left == right
    assert left


def ltz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols})


def test_validated_stream_equals_batch(spark, load, tmp_path):
    r = load("sensor_readings").limit(300)
    text = r.select(F.to_json(F.struct(
        "sensor_id", "region_id", F.col("reading_ts").cast("string").alias("timestamp"), "rainfall_mm", "temperature_c",
        "river_level_m", "soil_moisture_pct", "wind_speed_kmh", "wind_direction_deg", "stream_status")).alias("value"))
    bad = spark.createDataFrame([("{broken",), ('{"sensor_id": "s1"}',)], "value string")
    text.unionByName(bad).write.text(str(tmp_path / "raw"))
    live = jobs.validated_stream(streams.open_stream(spark, str(tmp_path / "raw")))
    finish(live.writeStream.format("parquet").option("path", str(tmp_path / "out"))
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True))
    got = spark.read.parquet(str(tmp_path / "out")).select("sensor_id", "reading_ts")
    same(got, ltz(validate.validated(r), "reading_ts").select("sensor_id", "reading_ts"))


def test_publish_stream_writes_key_and_json(spark, load, tmp_path):
    p = load("predictions").select("prediction_id", "risk_level").limit(50)
    p = ordered_files(p, tmp_path, "prediction_id", 2)
    w = jobs.publish_stream(stream(spark, tmp_path, p.schema), "prediction_id", path=str(tmp_path / "out"))
    finish(w.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True))
    out = spark.read.schema("key string, value string").json(str(tmp_path / "out"))
    assert out.count() == 50
    one = out.filter("key = '7'").first()
    assert one.value.startswith('{"prediction_id":7,"risk_level"')


def cycles(spark, readings, path, adjacency, at, name="cp"):
    from perilgrid import schemas

    table = PartTable(f"{path}/buf", f"{jobs.READING}, recency int", ["region_id"], 4)
    out = KeyLog(f"{path}/pred", schemas.PREDICTION, "prediction_id", 4)
    step = jobs.cycle_step(table, out, adjacency, at, name)
    finish(jobs.run(keyed.last_readings_stream(readings), step, f"{path}/{name}", "update", availableNow=True))
    return table, out


def test_cycle_stream_predicts_once_per_region(spark, load, tmp_path):
    r = ordered_files(ltz(load("sensor_readings"), "reading_ts").selectExpr(*[c.split()[0] for c in jobs.READING.split(", ")]),
                      tmp_path, "reading_ts", 2)
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    table, out = cycles(spark, stream(spark, tmp_path, r.schema), tmp_path, load("region_adjacency"), at)
    same(table.read(spark).select("region_id", "reading_id"), buffers.last_readings(r).select("region_id", "reading_id"))
    got = out.read(spark)
    # the same cycle time gives the same ids, so the second cycle adds no copies
    assert got.count() == got.select("prediction_id").distinct().count() == 15 * r.select("region_id").distinct().count()


def test_insert_if_absent_keeps_the_first(spark, tmp_path):
    table = KeyLog(str(tmp_path / "t"), "k bigint, v string", "k", 4, 4)
    step = jobs.insert_step(table)
    step(spark.createDataFrame([(1, "a"), (2, "a"), (None, "a")], table.schema), 0)
    step(spark.createDataFrame([(2, "b"), (3, "b"), (None, "b")], table.schema), 1)
    step(spark.createDataFrame([(2, "b"), (3, "b"), (None, "b")], table.schema), 1)  # a retried batch
    assert sorted(map(str, map(tuple, table.read(spark).collect()))) == sorted(map(str, [(1, "a"), (2, "a"), (3, "b"), (None, "a")]))


def test_insert_reads_only_parts_that_may_hold_the_keys(spark, tmp_path):
    table = KeyLog(str(tmp_path / "t"), "k bigint, v string", "k", 8, 4)
    step = jobs.insert_step(table)
    step(spark.range(0, 500).selectExpr("id as k", "'a' as v"), 0)
    new = spark.range(10_000, 10_040).selectExpr("id as k", "'b' as v")
    known = table.maybe_stored(spark.range(0, 10_000).selectExpr("id as k", "'x' as v"))
    assert known.filter("k < 500").count() == 500 and known.count() < 600  # no stored key is missed, few others pass
    assert table.maybe_stored(new).count() == 0 and table.stored_keys(new, 1) is None  # nothing stored is read
    one = spark.createDataFrame([(7, "c"), (20_000, "c")], table.schema)
    part = one.filter("k = 7").select(table.part_of()).first()[0]
    plan = table.stored_keys(one, 1)._jdf.queryExecution().toString()
    assert f"part#" in plan and f"IN ({part})" in plan or f"= {part})" in plan
    read = {f.split("part=")[1].split("/")[0] for f in table.stored_keys(one, 1).inputFiles()}
    assert read == {str(part)} or str(part) in read
    step(one, 1)
    assert table.read(spark).filter("k in (7, 20000)").orderBy("k").collect() == [(7, "a"), (20_000, "c")]


def test_upsert_replaces_chosen_columns(spark, tmp_path):
    table = PartTable(str(tmp_path / "t"), "id bigint, region string, km double", ["id"], 4)
    step = jobs.upsert_step(table, ["km"], [F.col("km")])
    step(spark.createDataFrame([(1, "a", 5.0)], table.schema), 0)
    step(spark.createDataFrame([(1, "x", 4.0), (1, "y", 9.0), (2, "z", 1.0)], table.schema), 1)
    assert sorted(map(tuple, table.read(spark).collect())) == [(1, "a", 4.0), (2, "z", 1.0)]


def test_upsert_leaves_other_parts_alone(spark, tmp_path):
    table = PartTable(str(tmp_path / "t"), "id bigint, v int", ["id"], 8)
    step = jobs.upsert_step(table, ["v"], [F.col("v").desc()])
    step(spark.range(100).selectExpr("id", "0 as v"), 0)
    want = {i: 0 for i in range(100)}
    before = set(table.read(spark).inputFiles())
    for n in range(1, 9):
        ids = [n, 100 + n]
        batch = spark.createDataFrame([(i, n) for i in ids], table.schema)
        touched = {r[0] for r in batch.select(table.part_of()).collect()}
        step(batch, n)
        want.update({i: n for i in ids})
        if n % 3 == 0:
            step(batch, n)  # a retried batch
        assert dict(map(tuple, table.read(spark).collect())) == want
        after = set(table.read(spark).inputFiles())
        valid = {f for f in before if f"/part={min(set(range(8)) - touched)}/" in f}
        assert valid and valid <= after
        before = after
    assert len(list((tmp_path / "t" / "rows").glob("part=*/slot=*"))) <= 24


def test_a_part_may_lose_all_its_rows(spark, tmp_path):
    table = PartTable(str(tmp_path / "t"), "k int, v int", ["k"], 2)
    put = lambda old, new: old.join(new.select("k"), "k", "left_anti").union(new.filter("v > 0"))
    for n, rows in enumerate([[(1, 5), (2, 5), (3, 5)], [(1, 0), (2, 0), (3, 0)], [(3, 7)], [(3, 0)]]):
        table.update(spark.createDataFrame(rows, "k int, v int"), put, n)
    assert table.read(spark).count() == 0
    assert PartTable(str(tmp_path / "new"), "k int", ["k"]).read(spark).count() == 0


def test_burst_stream_equals_batch(spark, load, tmp_path):
    r = ltz(load("crowd_reports"), "reported_at").select("report_id", "region_id", "disaster_type", "description", "reported_at")
    r = r.withColumn("reported_at", F.expr("timestamp_micros(unix_micros(reported_at) div 20)"))  # denser, so that bursts occur
    r = ordered_files(r, tmp_path, "reported_at", 3)
    stored = HourLog(str(tmp_path / "rep"), jobs.REPORT, "reported_at")
    out = HourLog(str(tmp_path / "out"), "report_id bigint, region_id string, disaster_type string, reported_at timestamp, report_count bigint", "reported_at")
    finish(jobs.run(stream(spark, tmp_path, r.schema), jobs.burst_step(stored, out), str(tmp_path / "cp"), availableNow=True))
    since, until = r.agg(F.max("reported_at") - F.expr("interval 1 hour"), F.max("reported_at")).first()
    recent = stored.between(spark, since, until, 99)
    assert recent.count() == r.filter(F.col("reported_at") >= F.lit(since)).count()
    assert "PartitionFilters: [isnotnull(hour" in recent._jdf.queryExecution().toString()
    same(out.read(spark).select("report_id", "report_count"), buffers.report_bursts(r).select("report_id", "report_count"))


def test_session_stream_emits_the_closed_sessions(spark, load, tmp_path):
    r = ltz(load("crowd_reports"), "reported_at").select("report_id", "region_id", "description", "reported_at")
    r = ordered_files(r, tmp_path, "reported_at", 3)
    live = jobs.blockage_session_stream(stream(spark, tmp_path, r.schema), lateness="1 hour")
    finish(live.writeStream.format("parquet").option("path", str(tmp_path / "out"))
           .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = buffers.blockage_sessions(reports.blockage_reports(r))
    edge = r.agg(F.max("reported_at") - F.expr("interval 2 hours")).first()[0]
    same(got.filter(F.col("recompute_at") < edge), want.filter(F.col("recompute_at") < edge))


def test_board_stream_equals_batch(spark, load, tmp_path):
    p = ltz(load("predictions"), "generated_at").withColumn("prediction_id", F.col("prediction_id").cast("string"))
    p = ordered_files(p.selectExpr(*[c.split()[0] for c in jobs.BOARD.split(", ")]), tmp_path, "generated_at", 3)
    table = PartTable(str(tmp_path / "board"), jobs.BOARD, ["region_id"])
    finish(jobs.run(stream(spark, tmp_path, p.schema), jobs.board_step(table), str(tmp_path / "cp"), availableNow=True))
    same(table.read(spark), board.latest_by_type(p))


def test_report_intake_drops_repeated_ids(spark, load, tmp_path):
    r = ltz(load("crowd_reports"), "reported_at").select("report_id", "region_id", "reported_at").limit(40)
    r = ordered_files(r.unionByName(r), tmp_path, "report_id", 2)
    live = jobs.report_intake_stream(stream(spark, tmp_path, r.schema), lateness="40 days")
    finish(live.writeStream.format("parquet").option("path", str(tmp_path / "out"))
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 40 and [x[0] for x in got.select("validation_status").distinct().collect()] == ["pending"]


@pytest.mark.parametrize("text,reject", [("{broken", "json"), ('{"sensor_id":"a","region_id":"r","stream_status":"ok"}', "reading_ts"),
                                         ('{"sensor_id":"a","region_id":"r","timestamp":"2024-01-01T00:00:00Z","stream_status":""}', "stream_status"),
                                         ('{"sensor_id":"a","region_id":"r","timestamp":"2024-01-01T00:00:00Z","stream_status":"ok","rainfall_mm":"wet"}', "json"),
                                         ('{"sensor_id":"a","region_id":"r","timestamp":"2024-01-01T00:00:00Z","stream_status":"ok"}', None)])
def test_sensor_rows_reject(spark, text, reject):
    raw = spark.createDataFrame([(text,)], "value string")
    assert streams.sensor_rows(raw, fill_time=False).first().reject_field == reject


def test_missing_time_is_filled_on_intake(spark):
    raw = spark.createDataFrame([('{"sensor_id":"a","region_id":"r","stream_status":"ok"}',)], "value string")
    row = streams.sensor_rows(raw).first()
    assert row.reject_field is None and row.reading_ts is not None


def test_new_checkpoint_starts_from_the_stored_rows(spark, tmp_path):
    df = spark.createDataFrame([(2, "new"), (1, "later")], "k bigint, v string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    table = KeyLog(str(tmp_path / "t"), "k bigint, v string", "k", 4, 4)
    jobs.insert_step(table)(spark.createDataFrame([(1, "old")], table.schema), 0)
    state = PartTable(str(tmp_path / "v"), "k bigint, v string", ["k"], 4)
    jobs.upsert_step(state, ["v"], [F.col("v")])(spark.createDataFrame([(1, "old"), (7, "old")], state.schema), 0)
    for n in range(2):  # twice: the second checkpoint starts from what the first left
        live = lambda: stream(spark, tmp_path, df.schema)
        finish(jobs.run(live(), jobs.insert_step(table, run=f"cp{n}"), f"{tmp_path}/cp{n}", availableNow=True))
        finish(jobs.run(live(), jobs.upsert_step(state, ["v"], [F.col("v")], f"kp{n}"), f"{tmp_path}/kp{n}", availableNow=True))
        assert sorted(map(tuple, table.read(spark).collect())) == [(1, "old"), (2, "new")]
        assert sorted(map(tuple, state.read(spark).collect())) == [(1, "later"), (2, "new"), (7, "old")]


def test_readings_flow_from_json_to_predictions(spark, load, tmp_path):
    """Source, validation, buffers, cycle and insert in one run, against the batch cycle on the same readings."""
    from perilgrid.plans.cycle import prediction_cycle

    r = load("sensor_readings").limit(200)
    r.select(F.to_json(F.struct(
        "sensor_id", "region_id", F.col("reading_ts").cast("string").alias("timestamp"), "rainfall_mm", "temperature_c",
        "river_level_m", "soil_moisture_pct", "wind_speed_kmh", "wind_direction_deg", "stream_status"
    )).alias("value")).repartition(2).write.text(f"{tmp_path}/raw")
    live = jobs.validated_stream(streams.open_stream(spark, f"{tmp_path}/raw"))
    clock = F.lit("2024-02-01 00:00:00").cast("timestamp")
    live = live.select(*[c.split()[0] for c in jobs.READING.split(", ")])
    _, out = cycles(spark, live, tmp_path, load("region_adjacency"), clock)
    clean = ltz(validate.validated(r), "reading_ts").withColumn("reading_id", F.xxhash64("sensor_id", F.unix_micros("reading_ts")))
    want = prediction_cycle(clean, load("region_adjacency"), clock)
    cut = lambda df: df.select("region_id", "disaster_type", "forecast_horizon_h", F.round("probability_pct", 6).alias("p"))
    same(cut(out.read(spark)), cut(want))
