"""Queries on sources, sinks, validation, feed health and buffers."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilgrid.catalog.registry import query
from perilgrid.functions import constants as K
from perilgrid.operators import buffers, health, validate
from perilgrid.operators import reports as rp
from perilgrid.sources import sinks, streams, tables

# one moment all as-of questions share
AS_OF = "2024-01-31 00:00:00"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

ANOMALOUS = """(coalesce(temperature_c < -90 or temperature_c > 60, false) or coalesce(rainfall_mm < 0, false)
    or coalesce(river_level_m < 0, false) or coalesce(soil_moisture_pct < 0 or soil_moisture_pct > 100, false)
    or coalesce(wind_speed_kmh < 0, false) or coalesce(wind_direction_deg < 0 or wind_direction_deg > 360, false))"""
COMPLETE = "(sensor_id <> '' and region_id <> '' and reading_ts is not null and stream_status <> '')"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz")


# --- sources ----------------------------------------------------------------


@query("s01_sensor_json", ["sensor_readings"], """
    select reading_id, sensor_id, region_id, reading_ts, rainfall_mm, river_level_m,
           case when reading_id % 53 = 0 then 'json' when stream_status = '' then 'stream_status' end as reject_field
    from (select reading_id, stream_status,
            case when reading_id % 53 <> 0 then sensor_id end as sensor_id,
            case when reading_id % 53 <> 0 then region_id end as region_id,
            case when reading_id % 53 <> 0 then reading_ts end as reading_ts,
            case when reading_id % 53 <> 0 then rainfall_mm end as rainfall_mm,
            case when reading_id % 53 <> 0 then river_level_m end as river_level_m from sensor_readings)""")
def sensor_json(load):
    whole = F.to_json(F.struct(
        "sensor_id", "region_id", F.date_format("reading_ts", ISO).alias("timestamp"), "rainfall_mm", "temperature_c",
        "river_level_m", "stream_status"))
    value = F.when(F.col("reading_id") % 53 == 0, F.substring(whole, 1, 40)).otherwise(whole)
    raw = load("sensor_readings").select("reading_id", value.alias("value"))
    return streams.sensor_rows(raw, fill_time=False, keep=("reading_id",)).select(
        "reading_id", "sensor_id", "region_id", _ntz("reading_ts").alias("reading_ts"), "rainfall_mm", "river_level_m", "reject_field")


@query("s02_weather_json", ["weather_forecasts"], """
    select forecast_id, region_id, fetched_at, precipitation_prob_pct, temperature_forecast_c, forecast_horizon_h, source
    from weather_forecasts where forecast_id % 59 <> 0""")
def weather_json(load):
    whole = F.to_json(F.struct(
        "region_id", F.date_format("fetched_at", ISO).alias("fetched_at"), "precipitation_prob_pct",
        "temperature_forecast_c", "wind_forecast_kmh", "forecast_horizon_h", "source"))
    value = F.when(F.col("forecast_id") % 59 == 0, F.lit("{no json")).otherwise(whole)
    raw = load("weather_forecasts").select("forecast_id", value.alias("value"))
    return streams.weather_rows(raw, keep=("forecast_id",)).select(
        "forecast_id", "region_id", _ntz("fetched_at").alias("fetched_at"), "precipitation_prob_pct",
        "temperature_forecast_c", "forecast_horizon_h", "source")


@query("s03_satellite_json", ["satellite_images"], """
    select image_id, region_id, 'orbiter' as provider, captured_at, received_at, resolution_m, 'ok' as feed_status
    from satellite_images""")
def satellite_json(load):
    value = F.to_json(F.struct(
        "image_id", "region_id", "provider", F.date_format("captured_at", ISO).alias("captured_at"),
        F.date_format("received_at", ISO).alias("received_at"), "resolution_m"))
    raw = load("satellite_images").select(value.alias("value"))
    return streams.satellite_rows(raw, "orbiter").select(
        "image_id", "region_id", "provider", _ntz("captured_at").alias("captured_at"),
        _ntz("received_at").alias("received_at"), "resolution_m", "feed_status")


@query("s04_gov_records", ["gov_payloads"], """
    with docs as (
        select payload_id, feed, fetched, unnest(case when payload like '[%' then from_json(payload, '["JSON"]') else [payload::json] end) as j
        from gov_payloads)
    select payload_id, json_extract_string(j, '$.record_id') as record_id, json_extract_string(j, '$.region_id') as region_id,
           json_extract_string(j, '$.data_type') as data_type,
           strftime(fetched, '%Y-%m-%dT%H:%M:%SZ') as fetched_at,
           coalesce(nullif(json_extract_string(j, '$.source'), ''), feed) as source
    from docs""")
def gov(load):
    rows = streams.gov_records(load("gov_payloads"), F.col("feed"), F.col("fetched"))
    return rows.select("payload_id", "record_id", "region_id", "data_type", "fetched_at", "source")


@query("s05_historical_load", ["historical_disaster_events"], """
    select event_id, region_id, disaster_type, cast(start_date as string) as start_date, cast(end_date as string) as end_date, severity, source
    from historical_disaster_events order by 4, event_id""")
def historical(load):
    days = {c: F.col(c).cast("string") for c in ("start_date", "end_date")}
    return tables.historical_events(load("historical_disaster_events")).withColumns(days)


@query("s06_terrain_load", ["terrain"], """
    select region_id, elevation_m, terrain_type, slope_gradient
    from (select *, row_number() over (partition by region_id order by load_no desc) as rn from terrain) where rn = 1""")
def terrain(load):
    return tables.terrain(load("terrain"))


@query("s07_urban_drainage_load", ["drainage"], """
    select region_id, capacity_m3, is_urban, is_operational from drainage d
    where is_urban and load_no = (select max(load_no) from drainage x where x.region_id = d.region_id and x.is_urban)""")
def drainage(load):
    return tables.urban_drainage(load("drainage"))


@query("s08_region_adjacency", ["region_adjacency"], "select region_id, neighbour_id, edge_weight from region_adjacency")
def adjacency(load):
    return tables.region_graph(load("region_adjacency"))


@query("s09_road_network", ["road_nodes", "road_edges"], """
    select edge_id, road_id, distance_km, from_node, to_node, n.label as from_label
    from (select edge_id, road_id, distance_km, from_node, to_node from road_edges where not is_blocked
          union all select edge_id, road_id, distance_km, to_node, from_node from road_edges where not is_blocked) e
    join (select node_id, coalesce(label, cast(node_id as varchar)) as label from road_nodes) n on n.node_id = e.from_node""")
def roads(load):
    named = tables.road_nodes(load("road_nodes")).select(F.col("node_id").alias("from_node"), F.col("label").alias("from_label"))
    return tables.road_network(load("road_edges")).join(named, "from_node")


@query("s10_region_feed", ["sensor_readings", "weather_forecasts"], """
    select region_id, kind, event_at, rainfall_mm, precipitation_prob_pct from (
        select region_id, 'sensor' as kind, reading_ts as event_at, rainfall_mm, null as precipitation_prob_pct from sensor_readings
        union all
        select region_id, 'weather', fetched_at, null, precipitation_prob_pct from weather_forecasts)
    where region_id is not null""")
def feed(load):
    both = tables.region_feed(load("sensor_readings"), load("weather_forecasts"))
    return both.select("region_id", "kind", "event_at", "rainfall_mm", "precipitation_prob_pct")


# --- sinks ------------------------------------------------------------------


@query("k01_topic_rows", ["predictions"], """
    select cast(prediction_id as varchar) as key,
           concat('{"prediction_id":', prediction_id, ',"region_id":"', region_id, '","risk_level":"', risk_level, '","forecast_horizon_h":',
                  forecast_horizon_h, ',"model_version":"', model_version, '"}') as value
    from predictions""")
def topic(load):
    rows = load("predictions").select("prediction_id", "region_id", "risk_level", "forecast_horizon_h", "model_version")
    return sinks.topic_rows(rows, "prediction_id")


@query("k02_insert_if_absent", ["actual_outcomes", "predictions"], """
    select prediction_id, min(recorded_at) as recorded_at from actual_outcomes
    where prediction_id not in (select prediction_id from predictions where risk_level = 'High') group by 1""")
def absent(load):
    stored = load("predictions").filter("risk_level = 'High'")
    new = load("actual_outcomes").select("prediction_id", "recorded_at")
    return sinks.first_per_key(new, stored, "prediction_id", [F.col("recorded_at")])


@query("k03_upsert", ["predictions", "dispatches"], """
    select coalesce(s.prediction_id, n.prediction_id) as prediction_id, coalesce(s.region_id, n.region_id) as region_id,
           coalesce(n.risk_level, s.risk_level) as risk_level
    from (select prediction_id, region_id, risk_level from predictions where risk_level <> 'Medium') s
    full outer join (select prediction_id, 'new' as region_id, concat('was ', risk_level) as risk_level from dispatches
                     where risk_level <> 'Low') n on s.prediction_id = n.prediction_id""")
def upsert(load):
    stored = load("predictions").filter("risk_level <> 'Medium'").select("prediction_id", "region_id", "risk_level")
    new = load("dispatches").filter("risk_level <> 'Low'").selectExpr(
        "prediction_id", "'new' as region_id", "concat('was ', risk_level) as risk_level")
    return sinks.upsert(stored, new, "prediction_id", ["risk_level"])


@query("k04_mark_blocked", ["road_edges", "infrastructure_assets"], """
    select edge_id, road_id, is_blocked or edge_id in (select asset_id * 100 + 1 from infrastructure_assets where asset_type = 'dam') as is_blocked
    from road_edges""")
def blocked(load):
    ids = load("infrastructure_assets").filter("asset_type = 'dam'").selectExpr("asset_id * 100 + 1 as edge_id")
    return sinks.mark_blocked(load("road_edges").select("edge_id", "road_id", "is_blocked"), ids, "edge_id")


@query("k05_prediction_points", ["predictions"], """
    select region_id, disaster_type, risk_level, probability_pct, severity_index, coalesce(time_to_impact_h, -1e0) as time_to_impact_h,
           cast(forecast_horizon_h as double) as forecast_horizon_h, generated_at as time from predictions""")
def points(load):
    return sinks.prediction_points(load("predictions"))


@query("k06_report_intake", ["crowd_reports"], """
    select report_id, region_id, disaster_type, reported_at, 'pending' as validation_status from crowd_reports""")
def intake(load):
    return rp.intake(load("crowd_reports")).select("report_id", "region_id", "disaster_type", "reported_at", "validation_status")


# --- validation -------------------------------------------------------------


@query("v01_required_fields", ["sensor_readings"], """
    select reading_id, case when coalesce(sensor_id, '') = '' then 'sensor_id' when coalesce(region_id, '') = '' then 'region_id'
        when reading_ts is null then 'reading_ts' when coalesce(stream_status, '') = '' then 'stream_status' end as reject_field
    from sensor_readings""")
def required(load):
    return validate.mark_rejects(load("sensor_readings")).select("reading_id", "reject_field")


@query("v02_plausibility", ["sensor_readings"], f"select reading_id, {ANOMALOUS} as is_anomalous from sensor_readings")
def plausible(load):
    return validate.flag_anomalous(load("sensor_readings")).select("reading_id", "is_anomalous")


@query("v03_valid_rows", ["sensor_readings"], f"""
    select reading_id, sensor_id, region_id, reading_ts from sensor_readings where {COMPLETE} and not {ANOMALOUS}""")
def valid(load):
    return validate.validated(load("sensor_readings")).select("reading_id", "sensor_id", "region_id", "reading_ts")


_SUMMARY = " union all ".join(
    [f"select 'rejected' as \"check\", '{f}' as field, count(*) as n_rows from sensor_readings where {c}" for f, c in (
        ("sensor_id", "coalesce(sensor_id, '') = ''"), ("region_id", "coalesce(region_id, '') = ''"),
        ("reading_ts", "reading_ts is null"), ("stream_status", "coalesce(stream_status, '') = ''"))]
    + [f"select 'anomalous', '{f}', count(*) from sensor_readings where {COMPLETE} and ({c})" for f, c in (
        ("temperature_c", "temperature_c < -90 or temperature_c > 60"), ("rainfall_mm", "rainfall_mm < 0"),
        ("river_level_m", "river_level_m < 0"), ("soil_moisture_pct", "soil_moisture_pct not between 0 and 100"),
        ("wind_speed_kmh", "wind_speed_kmh < 0"), ("wind_direction_deg", "wind_direction_deg not between 0 and 360"))])


@query("v04_validation_summary", ["sensor_readings"], _SUMMARY)
def summary(load):
    return validate.validation_summary(load("sensor_readings"))


@query("v05_satellite_check", ["satellite_images"], """
    select image_id, region_id, provider, resolution_m from satellite_images
    where image_id <> '' and region_id <> '' and provider <> '' and captured_at is not null and received_at is not null and resolution_m > 0""")
def satellite_check(load):
    return validate.check_satellite(load("satellite_images")).select("image_id", "region_id", "provider", "resolution_m")


@query("v06_report_check", ["report_forms"], """
    select report_id, try_cast(lat as double) as lat, try_cast(lon as double) as lon from report_forms
    where disaster_type <> '' and user_id <> '' and try_cast(lat as double) is not null and try_cast(lon as double) is not null""")
def report_check(load):
    return validate.check_report(load("report_forms")).select("report_id", "lat", "lon")


def _listed(*rules: tuple[str, str]) -> str:
    arms = ", ".join(f"case when {c} then '{name}' end" for name, c in rules)
    return f"coalesce(array_to_string(list_sort(list_filter([{arms}], lambda x: x is not null)), ','), '')"


@query("v07_prediction_contract", ["predictions"], f"""
    select prediction_id, {_listed(
        ('required:input_data_snapshot_id', 'prediction_id % 7 = 0'), ('type:input_data_snapshot_id', 'prediction_id % 7 = 1'),
        ('extra:note', 'prediction_id % 5 = 0'), ('max:probability_pct', 'probability_pct * 1.2 > 100'),
        ('max:severity_index', 'severity_index * 1.2 > 100'), ('enum:disaster_type', "disaster_type = 'cyclone' and prediction_id % 3 = 0"),
        ('enum:forecast_horizon_h', 'prediction_id % 11 = 0'))} as violations
    from predictions""")
def prediction_contract(load):
    k = F.col("prediction_id")
    doc = F.to_json(F.struct(
        k.cast("string").alias("prediction_id"), "region_id",
        F.when((F.col("disaster_type") == "cyclone") & (k % 3 == 0), "typhoon").otherwise(F.col("disaster_type")).alias("disaster_type"),
        F.when(k % 11 == 0, 48).otherwise(F.col("forecast_horizon_h")).alias("forecast_horizon_h"), "risk_level",
        (F.col("probability_pct") * 1.2).alias("probability_pct"), "time_to_impact_h",
        (F.col("severity_index") * 1.2).alias("severity_index"), F.col("generated_at").cast("string").alias("generated_at"),
        "model_version", F.when(k % 7 > 1, "snap").alias("input_data_snapshot_id"),
        F.when(k % 5 == 0, "x").alias("note")))
    # one key of seven carries a number where text is due
    doc = F.when(k % 7 == 1, F.regexp_replace(doc, r"\}$", ',"input_data_snapshot_id":7}')).otherwise(doc)
    out = validate.contract_violations(load("predictions").select("prediction_id", doc.alias("value")), "prediction")
    return out.select("prediction_id", F.array_join("violations", ",").alias("violations"))


@query("v07_weather_contract", ["weather_forecasts"], f"""
    select forecast_id, {_listed(
        ('required:region_id', 'region_id is null'), ('required:source', 'source is null'),
        ('max:precipitation_prob_pct', 'precipitation_prob_pct > 100'), ('min:temperature_forecast_c', 'temperature_forecast_c < -90'),
        ('max:temperature_forecast_c', 'temperature_forecast_c > 60'), ('min:wind_forecast_kmh', 'wind_forecast_kmh < 0'),
        ('enum:forecast_horizon_h', 'forecast_horizon_h not in (6, 24, 72)'))} as violations
    from weather_forecasts""")
def weather_contract(load):
    doc = F.to_json(F.struct(
        "region_id", F.col("fetched_at").cast("string").alias("fetched_at"), "precipitation_prob_pct",
        "temperature_forecast_c", "wind_forecast_kmh", "forecast_horizon_h", "source"))
    out = validate.contract_violations(load("weather_forecasts").select("forecast_id", doc.alias("value")), "weather")
    return out.select("forecast_id", F.array_join("violations", ",").alias("violations"))


@query("v07_alert_contract", ["dispatches"], f"""
    select prediction_id, {_listed(
        ('enum:risk_level', "risk_level = 'Low'"), ('max:retry_count', 'prediction_id % 17 <> 0 and prediction_id % 6 > 3'),
        ('enum:channel', 'prediction_id % 4 = 0'), ('required:language_code', 'prediction_id % 13 = 0'),
        ('type:retry_count', 'prediction_id % 17 = 0'),
        ('min:time_to_impact_h', 'prediction_id % 19 = 0'))} as violations
    from dispatches""")
def alert_contract(load):
    k = F.col("prediction_id")
    doc = F.to_json(F.struct(
        F.concat(F.lit("a"), k.cast("string")).alias("alert_id"), k.cast("string").alias("prediction_id"), F.lit("r1").alias("region_id"),
        "disaster_type", "risk_level", F.when(k % 19 == 0, -1.5).otherwise(2.0).alias("time_to_impact_h"),
        F.lit("go").alias("recommended_action"), F.when(k % 13 != 0, "en").alias("language_code"),
        F.when(k % 4 == 0, "pigeon").otherwise("sms").alias("channel"), F.col("dispatched_at").cast("string").alias("dispatched_at"),
        F.lit("sent").alias("delivery_status"), (k % 6 + F.when(k % 17 == 0, 0.5).otherwise(0.0)).alias("retry_count")))
    out = validate.contract_violations(load("dispatches").select("prediction_id", doc.alias("value")), "alert")
    return out.select("prediction_id", F.array_join("violations", ",").alias("violations"))


@query("v08_clamp_scores", ["predictions"], """
    select prediction_id, greatest(least(probability_pct * 3 - 50, 100), 0) as probability_pct,
           greatest(least(severity_index * 3 - 50, 100), 0) as severity_index from predictions""")
def clamp(load):
    raw = load("predictions").select(
        "prediction_id", (F.col("probability_pct") * 3 - 50).alias("probability_pct"),
        (F.col("severity_index") * 3 - 50).alias("severity_index"))
    return validate.clamp_scores(raw)


@query("v09_optional_filter", ["predictions"], """
    select prediction_id, region_id, generated_at from predictions
    where disaster_type = 'flood' and generated_at >= timestamp '1996-01-01' and generated_at <= timestamp '1999-12-31'""")
def optional(load):
    rows = validate.optional_filter(
        load("predictions"), "generated_at", disaster_type="flood", from_="1996-01-01 00:00:00", to="1999-12-31 00:00:00")
    return rows.select("prediction_id", "region_id", "generated_at")


@query("v10_risk_gate", ["predictions"], "select prediction_id, risk_level from predictions where risk_level <> 'Low'")
def gate(load):
    return validate.alertable(load("predictions")).select("prediction_id", "risk_level")


# --- feed health ------------------------------------------------------------


@query("h01_feed_gaps", ["sensor_readings"], """
    select reading_id, sensor_id, gap_s, case when gap_s >= 3600 then 'unavailable' when gap_s >= 1800 then 'degraded' else 'ok' end as status_before
    from (select reading_id, sensor_id, (epoch_us(reading_ts) - epoch_us(lag(reading_ts) over w)) / 1e6 as gap_s
          from (select reading_id, case when reading_id % 17 <> 0 then sensor_id end as sensor_id,
                       case when reading_id % 19 <> 0 then reading_ts end as reading_ts from sensor_readings)
          window w as (partition by sensor_id order by reading_ts nulls first, reading_id))""")
def gaps(load):
    # some readings lack the sensor or the time; none may get lost
    readings = load("sensor_readings").select(
        "reading_id",
        F.when(F.col("reading_id") % 17 != 0, F.col("sensor_id")).alias("sensor_id"),
        F.when(F.col("reading_id") % 19 != 0, F.col("reading_ts")).alias("reading_ts"),
    )
    return health.feed_gaps(readings).select("reading_id", "sensor_id", "gap_s", "status_before")


@query("h01_feed_status", ["sensor_readings"], f"""
    select sensor_id, last_received, case when gap >= 3600 then 'unavailable' when gap >= 1800 then 'degraded' else 'ok' end as status
    from (select sensor_id, max(reading_ts) as last_received, (epoch_us(timestamp '{AS_OF}') - epoch_us(max(reading_ts))) / 1e6 as gap
          from sensor_readings group by 1)""")
def status(load):
    return health.feed_status(load("sensor_readings"), as_of())


def _changes_sql(table: str, key: str, ts: str, levels, until: str) -> str:
    first = levels[0][0]
    arms = [f"select {key}, p as since, '{status}' as status, p + interval {s} second as changed_at from g where epoch_us(t) - epoch_us(p) >= {s}000000" for s, status in levels]
    arms.append(f"select {key}, p, 'ok', t from g where epoch_us(t) - epoch_us(p) >= {first}000000")
    arms += [f"select {key}, t, '{status}', t + interval {s} second from (select {key}, max(t) as t from g group by 1) where t + interval {s} second <= timestamp '{until}'"
             for s, status in levels]
    return f"""with r as (select {key}, {ts} as t from {table} where {key} is not null and {ts} <= timestamp '{until}'),
        g as (select {key}, t, lag(t) over (partition by {key} order by t) as p from r) {" union all ".join(arms)}"""


@query("h01_feed_changes", ["sensor_readings"], _changes_sql("sensor_readings", "sensor_id", "reading_ts", K.FEED_LEVELS, AS_OF))
def changes(load):
    return health.feed_changes(load("sensor_readings"), as_of())


@query("h02_provider_changes", ["satellite_images"], _changes_sql("satellite_images", "provider", "received_at", K.PROVIDER_LEVELS, AS_OF))
def provider_changes(load):
    return health.feed_changes(load("satellite_images"), as_of(), "provider", "received_at", K.PROVIDER_LEVELS)


@query("h02_satellite_silence", ["satellite_images"], """
    select provider, max(received_at) as unavailable_since from satellite_images where provider is not null
    group by 1 having max(received_at) <= timestamp '2024-01-31 02:00:00' - interval 2 hour""")
def silence(load):
    return health.satellite_silence(load("satellite_images"), F.lit("2024-01-31 02:00:00").cast("timestamp_ntz"))


@query("h03_alert_sla", ["dispatches"], """
    select risk_level, count(*) as n_alerts, count(*) filter (where late) as n_breached,
           count(*) filter (where late) / cast(count(*) as double) as breach_rate
    from (select risk_level, date_diff('second', generated_at, dispatched_at) > case when risk_level = 'High' then 300 else 900 end as late from dispatches)
    group by 1""")
def alert_sla(load):
    return health.alert_sla_by_risk(load("dispatches"))


@query("h03_dispatch_outcomes", ["predictions", "dispatches"], """
    select p.prediction_id, p.risk_level, p.generated_at, case when p.risk_level = 'High' then 300 else 900 end as sla_s, d.dispatched_at,
           d.dispatched_at is null as sla_breached
    from predictions p left join dispatches d on d.prediction_id = p.prediction_id and d.dispatched_at >= p.generated_at
         and epoch_us(d.dispatched_at) - epoch_us(p.generated_at) <= case when p.risk_level = 'High' then 300000000 else 900000000 end
    where p.risk_level <> 'Low'""")
def outcomes(load):
    return health.dispatch_outcomes(load("predictions"), load("dispatches"))


@query("h04_image_sla", ["satellite_images"], """
    select image_id, date_diff('second', received_at, processed_at)::double as elapsed_s,
           date_diff('second', received_at, processed_at) > 300 as sla_breached from satellite_images""")
def image_sla(load):
    return health.mark_image_sla(load("satellite_images")).select("image_id", "elapsed_s", "sla_breached")


# --- buffers and windows ----------------------------------------------------

BUFFER = """(select * from (select *, row_number() over (partition by region_id order by reading_ts desc, reading_id desc) as recency
    from sensor_readings) where recency <= 24)"""


@query("w01_last_readings", ["sensor_readings"], f"select region_id, reading_id, recency from {BUFFER}")
def last24(load):
    return buffers.last_readings(load("sensor_readings")).select("region_id", "reading_id", F.col("recency").cast("bigint").alias("recency"))


@query("w02_latest_features", ["cnn_features"], """
    select c.region_id, c.image_id, c.cloud_density, c.flood_inundation_pct from cnn_features c
    join (select region_id, max(struct_pack(t := extracted_at, i := image_id)) as m from cnn_features group by 1) x
      on x.region_id = c.region_id and x.m.i = c.image_id""")
def latest_cnn(load):
    return buffers.latest_features(load("cnn_features")).select("region_id", "image_id", "cloud_density", "flood_inundation_pct")


@query("w03_satellite_switch", ["cnn_features", "satellite_images"], """
    select max(extracted_at) as last_feature, (select max(received_at) from satellite_images) as last_silence,
           max(extracted_at) >= (select max(received_at) from satellite_images) as available from cnn_features""")
def switch(load):
    quiet = health.satellite_silence(load("satellite_images"), F.lit("2024-02-10 00:00:00").cast("timestamp_ntz"))
    every = load("satellite_images").select(F.col("received_at").alias("unavailable_since"))
    return buffers.satellite_switch(load("cnn_features"), quiet.select("unavailable_since").unionByName(every))


@query("w05_report_bursts", ["crowd_reports"], """
    select report_id, region_id, disaster_type, reported_at, report_count from (
        select *, count(*) over (partition by region_id, disaster_type order by reported_at
                                 range between interval 1 hour preceding and current row) as report_count from crowd_reports)
    where report_count >= 3""")
def bursts(load):
    return buffers.report_bursts(load("crowd_reports"))


_QUIET = _changes_sql("satellite_images", "provider", "received_at", K.PROVIDER_LEVELS, AS_OF)
LAST_SILENCE = f"(select max(changed_at) from ({_QUIET}) where status = 'unavailable')"


def switch_of(load):
    """The satellite switch as the providers' own silences set it."""
    changes = health.feed_changes(load("satellite_images"), as_of(), "provider", "received_at", K.PROVIDER_LEVELS)
    return buffers.satellite_switch(load("cnn_features"), buffers.silences(changes))


@query("w03_switch_after_silences", ["cnn_features", "satellite_images"], f"""
    select max(extracted_at) as last_feature, {LAST_SILENCE} as last_silence,
           coalesce(max(extracted_at) >= {LAST_SILENCE}, {LAST_SILENCE} is null) as available from cnn_features""")
def switch_after_silences(load):
    return switch_of(load)


# every ninth reading arrives three hours late, every tenth one a second time, every 31st has no time
ARRIVALS = """(select reading_id, region_id, case when reading_id % 31 <> 0 then reading_ts end as reading_ts,
        reading_ts + interval 1 second * (case when reading_id % 9 = 0 then 10800 else reading_id % 50 end) as arrived_at from sensor_readings
    union all select reading_id, region_id, case when reading_id % 31 <> 0 then reading_ts end,
        reading_ts + interval 1 second * (2400 + case when reading_id % 9 = 0 then 10800 else reading_id % 50 end) from sensor_readings where reading_id % 10 = 0)"""


@query("w07_late_and_repeated", ["sensor_readings"], f"""
    with a as (select *, max(reading_ts) over (partition by region_id order by arrived_at, reading_ts nulls first, cast(reading_id as varchar)
                                               rows between unbounded preceding and 1 preceding) as clock from {ARRIVALS}),
    b as (select *, coalesce(reading_ts < clock - interval 2 hour, false) as late from a)
    select reading_id, arrived_at, case when late then 'late' when row_number() over (partition by region_id, reading_id, reading_ts, late order by arrived_at) > 1
           then 'repeated' else 'kept' end as fate from b""")
def fates(load):
    rows = load("sensor_readings").select("reading_id", "region_id", "reading_ts")
    wait = F.when(F.col("reading_id") % 9 == 0, 10800).otherwise(F.col("reading_id") % 50)
    first = rows.withColumn("arrived_at", F.col("reading_ts") + F.make_dt_interval(secs=wait))
    again = rows.filter("reading_id % 10 = 0").withColumn("arrived_at", F.col("reading_ts") + F.make_dt_interval(secs=wait + 2400))
    arrivals = first.union(again).withColumn("reading_ts", F.when(F.col("reading_id") % 31 != 0, F.col("reading_ts")))
    return buffers.arrival_fate(arrivals, "region_id", "reading_id", "reading_ts", "arrived_at").select("reading_id", "arrived_at", "fate")


BLOCKAGE = """lower(coalesce(description, '')) like '%road%' and (lower(description) like '%block%'
    or lower(description) like '%closed%' or lower(description) like '%flood%')"""
SESSIONS = f"""(select region_id, min(reported_at) as first_report, max(reported_at) as last_report, count(*)::bigint as n_reports,
        max(reported_at) + interval 10 minute as recompute_at
    from (select *, sum(opened) over (partition by region_id order by reported_at, report_id) as session
          from (select *, case when reported_at - lag(reported_at) over (partition by region_id order by reported_at, report_id) < interval 10 minute
                          then 0 else 1 end as opened from crowd_reports where {BLOCKAGE}))
    group by region_id, session)"""


@query("w06_blockage_debounce", ["crowd_reports"], f"select * from {SESSIONS}")
def debounce(load):
    return buffers.blockage_sessions(rp.blockage_reports(load("crowd_reports")))


@query("c02_blockage_text", ["crowd_reports"], f"select report_id, {BLOCKAGE} as blocks_road from crowd_reports")
def blockage_text(load):
    return load("crowd_reports").select("report_id", rp.tells_of_blockage(F.col("description")).alias("blocks_road"))


@query("c03_latest_reports", ["crowd_reports"], """
    select report_id, region_id, reported_at from crowd_reports order by reported_at desc, report_id desc limit 200""")
def latest_reports(load):
    return rp.latest_reports(load("crowd_reports").select("report_id", "region_id", "reported_at"))
