"""Queries on features, predictions and explanations.

Floating sums depend on their order, so values are rounded to six places on
both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from perilgrid.catalog.intake import ANOMALOUS, AS_OF, BUFFER, COMPLETE, LAST_SILENCE, as_of, switch_of
from perilgrid.catalog.registry import query
from perilgrid.functions import constants as K
from perilgrid.operators import buffers, explain
from perilgrid.operators import features as fe
from perilgrid.operators import predict as pr
from perilgrid.operators.models import with_head, with_image_model, with_model
from perilgrid.plans.cycle import prediction_cycle, scored_hazards
from perilgrid.plans.history import cycle_history, newest_of_cycles, smooth_list
from perilgrid.sources import tables

DIM = range(K.VECTOR_DIM)


def six(c: str):
    return F.round(F.col(c), 6).alias(c)


def _buffer(load):
    return buffers.last_readings(load("sensor_readings"))


def _ema(load):
    return fe.smooth(_buffer(load)).repartition("region_id")


# --- check SQL building blocks ------------------------------------------------


def _dot(vec: str, consts) -> str:
    return "(" + " + ".join(f"{vec}[{k + 1}] * ({c!r}::double)" for k, c in enumerate(consts)) + ")"


def _project(fields) -> str:
    if not fields:
        return "[" + ", ".join(["0e0"] * K.VECTOR_DIM) + "]"
    rows = [K.SENSOR_FIELDS.index(f) for f in fields]
    return "[" + ", ".join(
        " + ".join(f"e{r} * ({K.PROJECTION[r][k]!r}::double)" for r in rows) for k in DIM) + "]"


_UNIT = "case when sqrt(list_sum(list_transform(raw, lambda x: x * x))) > 0 then list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) else raw end"

# smoothing as the recursion itself, one step per reading
_EMA = """ema as (
    with recursive seq as (
        select region_id, row_number() over (partition by region_id order by recency desc) as t,
               {vals} from buf),
    run as (
        select region_id, t, {start} from seq where t = 1
        union all
        select s.region_id, s.t, {step} from run r join seq s on s.region_id = r.region_id and s.t = r.t + 1)
    select region_id, t as n_readings, {names} from run where (region_id, t) in (select region_id, max(t) from run group by 1))""".format(
    vals=", ".join(f"coalesce({f}, 0e0) as x{i}" for i, f in enumerate(K.SENSOR_FIELDS)),
    start=", ".join(f"x{i} as e{i}" for i in range(6)),
    step=", ".join(f"0.3e0 * s.x{i} + 0.7e0 * r.e{i}" for i in range(6)),
    names=", ".join(f"e{i}" for i in range(6)),
)


def _chain(buf: str = BUFFER) -> str:
    """CTEs from the buffer to blended vectors and context."""
    hazards = " union all ".join(
        f"select region_id, '{h}' as disaster_type, {_project(fe.ROUTED_SENSOR_FIELDS[h])} as raw from ema" for h in K.HAZARDS)
    rounds = []
    for r in (1, 2):
        prev = "flood" if r == 1 else "g1"
        rounds.append(f"""
    m{r} as (select a.region_id, n.vec, exp({_dot('n.vec', K.GRAPH_VECTOR)} * a.edge_weight) as e
             from region_adjacency a join {prev} n on n.region_id = a.neighbour_id),
    s{r} as (select region_id, sum(e) as z, {", ".join(f"sum(e * vec[{k + 1}]) as s{k}" for k in DIM)} from m{r} group by 1),
    g{r} as (select p.region_id, case when s.z is null then p.vec else
             [{", ".join(f"0.6e0 * p.vec[{k + 1}] + 0.4e0 * s.s{k} / s.z" for k in DIM)}] end as vec
             from {prev} p left join s{r} s on s.region_id = p.region_id)""")
    return f"""buf as {buf}, {_EMA},
    hz as (select region_id, disaster_type, {_UNIT} as vec from ({hazards})),
    flood as (select region_id, vec from hz where disaster_type = 'flood'),
    att as (select vec, exp({_dot('vec', K.QUERY_VECTOR)} - (select max({_dot('vec', K.QUERY_VECTOR)}) from flood)) as w from flood),
    ctx as (select [{", ".join(f"sum(w * vec[{k + 1}]) / sum(w)" for k in DIM)}] as context from att),
    {",".join(rounds)},
    blended as (select h.region_id, h.disaster_type, case when h.disaster_type in ('flood', 'landslide', 'cyclone')
        then [{", ".join(f"0.7e0 * h.vec[{k + 1}] + 0.3e0 * g2.vec[{k + 1}]" for k in DIM)}] else h.vec end as vec
        from hz h join g2 on g2.region_id = h.region_id),
    scored as (select region_id, disaster_type, 1e2 / (1e0 + exp(-(own * {_dot('vec', K.SCORE_VECTOR)} + (1e0 - own) * {_dot('context', K.SCORE_VECTOR)}))) as raw_pct
        from (select *, case disaster_type when 'flood' then 0.6e0 when 'heatwave' then 0.5e0 when 'drought' then 0.7e0
                when 'landslide' then 0.6e0 else 0.4e0 end as own from blended, ctx))"""


def _long(source: str, where: str = "") -> str:
    return f"select region_id, k - 1 as k, round(vec[k], 6) as v from {source} s, (select unnest(range(1, 17)) as k) {where}"


def _long_df(df, *keys: str, vec: str = "vec"):
    return df.select(*keys, F.posexplode(vec).alias("k", "v")).select(*keys, F.col("k").cast("bigint").alias("k"), six("v"))


# --- features -----------------------------------------------------------------

_TERRAIN = "(select region_id, elevation_m, slope_gradient from terrain qualify row_number() over (partition by region_id order by load_no desc) = 1)"
_DRAIN = "(select region_id, capacity_m3 from drainage where is_urban qualify row_number() over (partition by region_id order by load_no desc) = 1)"


@query("f01_flood_features", ["sensor_readings", "terrain", "drainage"], f"""
    select b.region_id, reading_id, coalesce(rainfall_mm, 0) as rainfall_mm, coalesce(river_level_m, 0) as river_level_m,
           coalesce(soil_moisture_pct, 0) as soil_moisture_pct, coalesce(elevation_m, 0) as elevation, coalesce(capacity_m3, 0) as drainage_capacity
    from {BUFFER} b left join {_TERRAIN} t on t.region_id = b.region_id left join {_DRAIN} d on d.region_id = b.region_id""")
def flood(load):
    return fe.flood_features(_buffer(load), tables.terrain(load("terrain")), tables.urban_drainage(load("drainage")))


@query("f02_heatwave_features", ["sensor_readings", "historical_disaster_events"], f"""
    select b.region_id, reading_id, coalesce(temperature_c, 0) as temperature_c, coalesce(wind_speed_kmh, 0) as wind_speed_kmh,
           coalesce(soil_moisture_pct, 0) as humidity, case when h.region_id is null then 0e0 else 1e0 end as historical_heatwave_flag
    from {BUFFER} b left join (select distinct region_id from historical_disaster_events where disaster_type = 'heatwave' and severity >= 90) h
      on h.region_id = b.region_id""")
def heatwave(load):
    past = load("historical_disaster_events").filter("disaster_type = 'heatwave' and severity >= 90")
    flags = past.select("region_id").distinct().withColumn("historical_heatwave_flag", F.lit(1))
    return fe.heatwave_features(_buffer(load), flags)


@query("f03_drought_features", ["sensor_readings"], f"""
    select region_id, reading_id, round(case when rain < avg(rain) over w then -rain else 0 end, 6) + 0e0 as rainfall_deficit_mm,
           coalesce(soil - lag(soil) over (partition by region_id order by recency desc), 0) as soil_moisture_trend,
           round(temp - avg(temp) over w, 6) as temperature_anomaly_c, 30e0 as rolling_window_days
    from (select *, coalesce(rainfall_mm, 0) as rain, coalesce(soil_moisture_pct, 0) as soil, coalesce(temperature_c, 0) as temp from {BUFFER})
    window w as (partition by region_id)""")
def drought(load):
    df = fe.drought_features(_buffer(load))
    return df.withColumns({c: F.round(c, 6) for c in ("rainfall_deficit_mm", "temperature_anomaly_c")})


@query("f04_landslide_features", ["sensor_readings", "terrain"], f"""
    select b.region_id, reading_id, coalesce(rainfall_mm, 0) as rainfall_intensity_mm, coalesce(soil_moisture_pct, 0) as soil_moisture_pct,
           coalesce(slope_gradient, 0) as elevation_gradient, coalesce(slope_gradient, 0) as terrain_slope
    from {BUFFER} b left join {_TERRAIN} t on t.region_id = b.region_id""")
def landslide(load):
    return fe.landslide_features(_buffer(load), tables.terrain(load("terrain")))


_CLOUD = """left join (select region_id, cloud_density from cnn_features qualify row_number() over (partition by region_id order by extracted_at desc, image_id desc) = 1) c
    on c.region_id = b.region_id"""


@query("f05_cyclone_features", ["sensor_readings", "cnn_features"], f"""
    select b.region_id, reading_id, coalesce(wind_speed_kmh, 0) as wind_speed_kmh, coalesce(wind_direction_deg, 0) as wind_direction_deg,
           0e0 as sea_surface_temp_c, coalesce(cloud_density, 0) as cloud_density from {BUFFER} b {_CLOUD}""")
def cyclone(load):
    cnn = buffers.latest_features(load("cnn_features"))
    quiet = load("cnn_features").selectExpr("extracted_at as unavailable_since")
    return fe.cyclone_features(fe.with_cloud_density(_buffer(load), cnn, buffers.satellite_switch(load("cnn_features"), quiet)))


@query("f06_cloud_enrichment", ["sensor_readings", "cnn_features", "satellite_images"], f"""
    select b.region_id, reading_id, case when (select max(extracted_at) from cnn_features) >= (select max(received_at) from satellite_images)
        then cloud_density end as cloud_density from {BUFFER} b {_CLOUD}""")
def cloud(load):
    quiet = load("satellite_images").selectExpr("received_at as unavailable_since")
    switch = buffers.satellite_switch(load("cnn_features"), quiet)
    df = fe.with_cloud_density(_buffer(load), buffers.latest_features(load("cnn_features")), switch)
    return df.select("region_id", "reading_id", "cloud_density")


@query("f06_hazard_clouds", ["sensor_readings", "cnn_features", "satellite_images"], f"""
    select b.region_id, reading_id, h.disaster_type, case when h.disaster_type in ('flood', 'drought', 'landslide', 'cyclone')
        and coalesce((select max(extracted_at) from cnn_features) >= {LAST_SILENCE}, {LAST_SILENCE} is null) then cloud_density end as cloud_density
    from {BUFFER} b {_CLOUD} cross join (values ('flood'), ('heatwave'), ('drought'), ('landslide'), ('cyclone')) h(disaster_type)""")
def hazard_clouds(load):
    rows = fe.hazard_readings(_buffer(load), buffers.latest_features(load("cnn_features")), switch_of(load))
    return rows.select("region_id", "reading_id", "disaster_type", "cloud_density")


_CATALOGUE = ", ".join(f"('{h}', {i}, '{f}')" for h in K.HAZARDS for i, f in enumerate(K.FEATURES[h]))


@query("f07_feature_catalogue", ["predictions"], f"""
    select p.disaster_type, c.position, c.field, count(*) as n_predictions
    from predictions p join (values {_CATALOGUE}) c(disaster_type, position, field) on c.disaster_type = p.disaster_type group by all""")
def catalogue(load):
    used = load("predictions").groupBy("disaster_type").agg(F.count(F.lit(1)).alias("n_predictions"))
    return used.join(fe.feature_catalogue(used.sparkSession), "disaster_type")


@query("f08_smoothing", ["sensor_readings"], f"""
    with buf as {BUFFER}, {_EMA} select region_id, n_readings::bigint as n_readings, {", ".join(f"round(e{i}, 6) as e{i}" for i in range(6))} from ema""")
def smoothing(load):
    return _ema(load).select("region_id", "n_readings", *[F.round(F.col("ema")[i], 6).alias(f"e{i}") for i in range(6)])


@query("f09_projection", ["sensor_readings"], f"""
    with buf as {BUFFER}, {_EMA},
    u as (select region_id, {_UNIT} as vec from (select region_id, {_project(K.SENSOR_FIELDS)} as raw from ema)) {_long('u')}""")
def projection(load):
    return _long_df(fe.region_vectors(_ema(load)), "region_id")


@query("f10_attention_context", ["sensor_readings", "region_adjacency"], f"""
    with {_chain()} select region_id, k - 1 as k, round(context[k], 6) as v from flood, ctx, (select unnest(range(1, 17)) as k)""")
def context(load):
    vecs = fe.region_vectors(_ema(load), fe.ROUTED_SENSOR_FIELDS["flood"])
    return _long_df(fe.with_context(vecs), "region_id", vec="context")


@query("f11_graph_propagation", ["sensor_readings", "region_adjacency"], f"with {_chain()} {_long('g2')}")
def graph(load):
    vecs = fe.region_vectors(_ema(load), fe.ROUTED_SENSOR_FIELDS["flood"])
    return _long_df(fe.propagate(vecs, load("region_adjacency")), "region_id")


@query("f12_degraded_graph", ["sensor_readings", "region_adjacency"], f"with {_chain()} {_long('flood')}")
def degraded(load):
    vecs = fe.region_vectors(_ema(load), fe.ROUTED_SENSOR_FIELDS["flood"])
    return _long_df(fe.propagate(vecs, load("region_adjacency"), degraded=True), "region_id")


@query("f13_spatial_blend", ["sensor_readings", "region_adjacency"], f"""
    with {_chain()} select region_id, disaster_type, k - 1 as k, round(vec[k], 6) as v from blended, (select unnest(range(1, 17)) as k)""")
def blend(load):
    ema = _ema(load)
    g = fe.propagate(fe.region_vectors(ema, fe.ROUTED_SENSOR_FIELDS["flood"]), load("region_adjacency"))
    return _long_df(fe.blend_spatial(fe.hazard_vectors(ema), g), "region_id", "disaster_type")


_SHARES = """round(avg(case when b > 0.4 and b > r + 0.1 and b > g + 0.05 then 1e0 else 0e0 end) * 100, 6) as flood_inundation_pct,
    round(avg(case when (r + g + b) / 3 > 0.75 then 1e0 else 0e0 end), 6) as cloud_density,
    round(greatest(least(avg((g - r) / (g + r + 1e-6)) + 0.5, 1), 0), 6) as vegetation_index"""


@query("f14_image_features", ["image_pixels"], f"select image_id, {_SHARES} from image_pixels group by 1")
def image(load):
    return fe.image_features(load("image_pixels")).select(
        "image_id", six("flood_inundation_pct"), six("cloud_density"), six("vegetation_index"))


# --- prediction ---------------------------------------------------------------


def _scored(load):
    return scored_hazards(_ema(load), load("region_adjacency"))


_FAN = """fan as (select *, greatest(least(raw_pct * discount, 100), 0) as p from (
        select *, case h when 6 then 1e0 when 24 then 0.92e0 else 0.82e0 end as discount from scored, (select unnest([6, 24, 72]) as h)))"""
_JUDGE = """case when p >= 65 then 'High' when p >= 35 then 'Medium' else 'Low' end as risk_level"""
_TTI = "case when p >= 35 then greatest(least((1 - (p - 35) / 65) * h, h), 0) end"


@query("p01_ensemble_score", ["sensor_readings", "region_adjacency"], f"""
    with {_chain()} select region_id, disaster_type, round(raw_pct, 6) as raw_pct from scored""")
def score(load):
    return _scored(load).select("region_id", "disaster_type", six("raw_pct"))


@query("p02_horizon_fan_out", ["sensor_readings", "region_adjacency"], f"""
    with {_chain()}, {_FAN} select region_id, disaster_type, h as forecast_horizon_h, round(p, 6) as probability_pct from fan""")
def fan(load):
    return pr.fan_out_horizons(_scored(load)).select("region_id", "disaster_type", "forecast_horizon_h", six("probability_pct"))


@query("p03_risk_class", ["predictions"], """
    select prediction_id, case when probability_pct >= 65 then 'High' when probability_pct >= 35 then 'Medium' else 'Low' end as risk_class from predictions""")
def risk(load):
    return load("predictions").select("prediction_id", pr.risk_class(F.col("probability_pct")).alias("risk_class"))


@query("p04_time_to_impact", ["predictions"], """
    select prediction_id, round(case when probability_pct >= 35 then least(greatest((1 - (probability_pct - 35) / 65) * forecast_horizon_h, 0), forecast_horizon_h) end, 6) as hours
    from predictions""")
def impact(load):
    tti = pr.time_to_impact(F.col("probability_pct"), F.col("forecast_horizon_h"))
    return load("predictions").select("prediction_id", F.round(tti, 6).alias("hours"))


@query("p05_severity", ["predictions"], """
    select prediction_id, round(least(greatest(probability_pct * 0.9 * case forecast_horizon_h when 6 then 1.0 when 24 then 0.92 else 0.82 end, 0), 100), 6) as severity
    from predictions""")
def sev(load):
    discount = F.element_at(F.create_map(*[F.lit(x) for kv in K.HORIZON_DISCOUNT.items() for x in kv]), F.col("forecast_horizon_h"))
    return load("predictions").select("prediction_id", F.round(pr.severity(F.col("probability_pct"), discount), 6).alias("severity"))


VALID_BUFFER = f"""(select * from (select *, row_number() over (partition by region_id order by reading_ts desc, reading_id desc) as recency
    from sensor_readings where {COMPLETE} and not {ANOMALOUS} and reading_ts <= timestamp '{AS_OF}') where recency <= 24)"""


@query("p06_prediction_ids", ["sensor_readings", "region_adjacency"], f"""
    select sha256(concat_ws('|', region_id, t, cast(h as varchar), '{AS_OF}')) as prediction_id, region_id, t as disaster_type, h as forecast_horizon_h,
           sha256(concat_ws('|', region_id, '{AS_OF}')) as input_data_snapshot_id, '1.0.0' as model_version
    from (select distinct region_id from {VALID_BUFFER}), (select unnest(['flood', 'heatwave', 'drought', 'landslide', 'cyclone']) as t), (select unnest([6, 24, 72]) as h)""")
def ids(load):
    return prediction_cycle(load("sensor_readings"), load("region_adjacency"), as_of()).select(
        "prediction_id", "region_id", "disaster_type", "forecast_horizon_h", "input_data_snapshot_id", "model_version")


@query("p07_prediction_cycle", ["sensor_readings", "region_adjacency"], f"""
    with {_chain(VALID_BUFFER)}, {_FAN}
    select region_id, disaster_type, h as forecast_horizon_h, {_JUDGE}, round(p, 6) as probability_pct, round({_TTI}, 6) as time_to_impact_h,
           round(greatest(least(p * 0.9e0 * discount, 100), 0), 6) as severity_index, timestamp '{AS_OF}' as generated_at from fan""")
def cycle(load):
    return prediction_cycle(load("sensor_readings"), load("region_adjacency"), as_of()).select(
        "region_id", "disaster_type", "forecast_horizon_h", "risk_level", six("probability_pct"), six("time_to_impact_h"),
        six("severity_index"), "generated_at")


# --- all cycles -----------------------------------------------------------------


def _states(step_s: int, source: str) -> str:
    """CTE ``states``: the smoothed fields of a region as of each cycle that brought a reading."""
    # the same steps in the same order, so that the last digit agrees as well
    sums = ", ".join(
        f"list_reduce(list(coalesce(r.{f}, 0e0) order by r.j), lambda e, x: 0.3e0 * x + 0.7e0 * e) as e{i}" for i, f in enumerate(K.SENSOR_FIELDS))
    return f"""rows_of as (select *, row_number() over (partition by region_id order by reading_ts, reading_id) as j,
        cast(ceil(epoch_us(reading_ts) / {step_s}000000e0) as bigint) as slot from {source}),
    tops as (select region_id, slot, max(j) as top from rows_of group by 1, 2),
    states as (select x.region_id, x.slot, least(any_value(x.top), 24) as n_readings, {sums}
        from tops x join rows_of r on r.region_id = x.region_id and r.j between x.top - 23 and x.top group by 1, 2)"""


@query("w04_hourly_smoothing", ["sensor_readings"], f"""
    with {_states(3600, "sensor_readings")} select region_id, slot, n_readings, {", ".join(f"round(e{i} + 1e-9, 6) as e{i}" for i in range(6))} from states""")
def hourly(load):
    rows = newest_of_cycles(load("sensor_readings")).select("region_id", "slot", F.size("newest").cast("bigint").alias("n_readings"), smooth_list(F.col("newest")).alias("ema"))
    # short decimals often end in a 5 after the sixth place, which the engines round differently
    return rows.select("region_id", "slot", "n_readings", *[F.round(F.col("ema")[i] + 1e-9, 6).alias(f"e{i}") for i in range(6)])


FIRST_DAY, LAST_DAY = 19724, 19755  # 2024-01-02 to 2024-02-02, days after the epoch
_VALID = f"(select * from sensor_readings where {COMPLETE} and not {ANOMALOUS})"


def _history() -> str:
    """CTEs as of ``_chain``, with a snapshot for every day."""
    hazards = " union all ".join(
        f"select slot, region_id, '{h}' as disaster_type, {_project(fe.ROUTED_SENSOR_FIELDS[h])} as raw from ema" for h in K.HAZARDS)
    rounds = []
    for r in (1, 2):
        prev = "flood" if r == 1 else "g1"
        rounds.append(f"""
    m{r} as (select n.slot, a.region_id, n.vec, exp({_dot('n.vec', K.GRAPH_VECTOR)} * a.edge_weight) as e
             from region_adjacency a join {prev} n on n.region_id = a.neighbour_id),
    s{r} as (select slot, region_id, sum(e) as z, {", ".join(f"sum(e * vec[{k + 1}]) as s{k}" for k in DIM)} from m{r} group by 1, 2),
    g{r} as (select p.slot, p.region_id, case when s.z is null then p.vec else
             [{", ".join(f"0.6e0 * p.vec[{k + 1}] + 0.4e0 * s.s{k} / s.z" for k in DIM)}] end as vec
             from {prev} p left join s{r} s on s.region_id = p.region_id and s.slot = p.slot)""")
    return f"""{_states(86400, _VALID)},
    days as (select unnest(range({FIRST_DAY}, {LAST_DAY + 1})) as slot),
    ema as (select d.slot, s.* exclude (slot) from days d join states s on s.slot <= d.slot
            qualify row_number() over (partition by d.slot, s.region_id order by s.slot desc) = 1),
    hz as (select slot, region_id, disaster_type, {_UNIT} as vec from ({hazards})),
    flood as (select slot, region_id, vec from hz where disaster_type = 'flood'),
    tops_of as (select slot, max({_dot('vec', K.QUERY_VECTOR)}) as top from flood group by 1),
    att as (select f.slot, vec, exp({_dot('vec', K.QUERY_VECTOR)} - top) as w from flood f join tops_of t on t.slot = f.slot),
    ctx as (select slot, [{", ".join(f"sum(w * vec[{k + 1}]) / sum(w)" for k in DIM)}] as context from att group by 1),
    {",".join(rounds)},
    blended as (select h.slot, h.region_id, h.disaster_type, case when h.disaster_type in ('flood', 'landslide', 'cyclone')
        then [{", ".join(f"0.7e0 * h.vec[{k + 1}] + 0.3e0 * g2.vec[{k + 1}]" for k in DIM)}] else h.vec end as vec
        from hz h join g2 on g2.region_id = h.region_id and g2.slot = h.slot),
    scored as (select slot, region_id, disaster_type, 1e2 / (1e0 + exp(-(own * {_dot('vec', K.SCORE_VECTOR)} + (1e0 - own) * {_dot('context', K.SCORE_VECTOR)}))) as raw_pct
        from (select b.*, c.context, case disaster_type when 'flood' then 0.6e0 when 'heatwave' then 0.5e0 when 'drought' then 0.7e0
                when 'landslide' then 0.6e0 else 0.4e0 end as own from blended b join ctx c on c.slot = b.slot))"""


@query("w04_cycle_history", ["sensor_readings", "region_adjacency"], f"""
    with {_history()} select region_id, disaster_type, h as forecast_horizon_h, round(greatest(least(raw_pct * d, 100), 0), 6) as probability_pct,
        timestamp '1970-01-01' + to_days(slot::int) as generated_at
    from scored, (values (6, 1e0), (24, 0.92e0), (72, 0.82e0)) t(h, d)""")
def history(load):
    rows = cycle_history(load("sensor_readings"), load("region_adjacency"), FIRST_DAY, LAST_DAY, 86400)
    return rows.select("region_id", "disaster_type", "forecast_horizon_h", six("probability_pct"), "generated_at")


# --- explanations -------------------------------------------------------------

_FORMULAS = {
    ("flood", "rainfall_mm"): "p * 0.5", ("flood", "river_level_m"): "p * 0.03", ("flood", "soil_moisture_pct"): "s * 0.8",
    ("flood", "elevation"): "greatest(0, 100 - s)", ("flood", "drainage_capacity"): "greatest(0, 100 - p * 0.8)",
    ("heatwave", "temperature_c"): "20 + p * 0.2", ("heatwave", "humidity"): "s * 0.7",
    ("heatwave", "wind_speed_kmh"): "greatest(0, 30 - p * 0.2)",
    ("heatwave", "historical_heatwave_flag"): "case when p > 50 then 1 else 0 end",
    ("drought", "rainfall_deficit_mm"): "-p * 0.4", ("drought", "soil_moisture_trend"): "-s * 0.3",
    ("drought", "temperature_anomaly_c"): "p * 0.1", ("drought", "rolling_window_days"): "30",
    ("landslide", "rainfall_intensity_mm"): "p * 0.4", ("landslide", "soil_moisture_pct"): "s * 0.8",
    ("landslide", "elevation_gradient"): "p * 0.005", ("landslide", "terrain_slope"): "s * 0.3",
    ("cyclone", "wind_speed_kmh"): "p * 1.5", ("cyclone", "cloud_density"): "p * 0.008",
    ("cyclone", "sea_surface_temp_c"): "25 + p * 0.05", ("cyclone", "wind_direction_deg"): "180",
}


def _value_rows() -> str:
    parts = []
    for h, table in K.FACTOR_WEIGHTS.items():
        for i, (f, w) in enumerate(table.items()):
            parts.append(f"select prediction_id, disaster_type, risk_level, {i} as pos, '{f}' as feature, {w}::double as w, "
                         f"cast({_FORMULAS[(h, f)]} as double) as v from (select *, probability_pct as p, severity_index as s from predictions) where disaster_type = '{h}'")
    return " union all ".join(parts)


_FACTORS = f"""vals as ({_value_rows()}),
    sc as (select *, w * (abs(v) / (abs(v) + 1)) as score from vals),
    pc as (select *, round(score / case when total = 0 then 1 else total end * 100, 1) as pct
           from (select *, sum(score) over (partition by prediction_id) as total from sc)),
    kept as (select *, case when v >= 0 then 'positive' else 'negative' end as direction,
             row_number() over (partition by prediction_id order by score desc, pos) as place from pc where pct >= 0.5),
    unused as (select *, row_number() over (partition by prediction_id order by pos) as u from pc where pct < 0.5),
    n as (select prediction_id, count(*) filter (where pct >= 0.5) as n from pc group by 1),
    padded as (select prediction_id, disaster_type, risk_level, place, feature, pct, direction from kept
        union all select u.prediction_id, disaster_type, risk_level, n.n + u, feature, 1e0, 'positive' from unused u
            join n on n.prediction_id = u.prediction_id where risk_level in ('Medium', 'High') and u <= 3 - n.n)"""


@query("x01_proxy_values", ["predictions"], f"select prediction_id, feature, round(v, 6) + 0e0 as v from ({_value_rows()})")
def proxies(load):
    df = explain.with_proxy_values(load("predictions"))
    return df.select("prediction_id", F.explode("feature_values").alias("feature", "v")).select("prediction_id", "feature", six("v"))


def _factor_rows(df):
    return df.select("prediction_id", F.posexplode_outer("factors").alias("p", "f")).selectExpr(
        "prediction_id", "cast(p + 1 as bigint) as place", "f.feature_name as feature_name", "f.contribution_pct as contribution_pct", "f.direction as direction").filter("place is not null")


@query("x02_contributions", ["predictions"], f"""
    with {_FACTORS} select prediction_id, place, feature as feature_name, pct as contribution_pct, direction from kept""")
def contributions(load):
    return _factor_rows(explain.with_factors(explain.with_proxy_values(load("predictions"))))


@query("x03_padded_factors", ["predictions"], f"""
    with {_FACTORS} select prediction_id, place, feature as feature_name, pct as contribution_pct, direction from padded""")
def padded(load):
    return _factor_rows(explain.pad_factors(explain.with_factors(explain.with_proxy_values(load("predictions")))))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NAMES = "case feature " + " ".join(f"when '{f}' then {_sql_text(n)}" for f, n in K.FACTOR_NAMES.items()) + " else replace(feature, '_', ' ') end"
_SUMMARY = f"""with {_FACTORS} select p.prediction_id, concat(upper(substring(p.disaster_type, 1, 1)), substring(p.disaster_type, 2), ' risk is ', p.risk_level,
        coalesce(' due to: ' || t.txt, ''), '.') as plain_language_summary
    from predictions p left join (select prediction_id, string_agg(concat({_NAMES}, ' (', pct, '%)'), ', ' order by place) as txt
        from padded where place <= 3 group by 1) t on t.prediction_id = p.prediction_id"""


@query("x04_summaries", ["predictions"], _SUMMARY)
def summaries(load):
    return explain.explanations(load("predictions")).select("prediction_id", "plain_language_summary")


@query("x05_explanation_records", ["predictions"], f"""
    with {_FACTORS} select sha256(concat('explanation|', prediction_id)) as explanation_id, prediction_id,
        coalesce(f, '') as contributing_factors from predictions left join
        (select prediction_id, string_agg(concat(feature, ':', pct, ':', direction), ';' order by place) as f from padded group by 1) using (prediction_id)""")
def records(load):
    df = explain.explanations(load("predictions"))
    as_text = F.transform("contributing_factors", lambda f: F.concat_ws(":", f["feature_name"], f["contribution_pct"].cast("string"), f["direction"]))
    return df.select("explanation_id", "prediction_id", F.array_join(as_text, ";").alias("contributing_factors"))


@query("x05_explanation_lookup", ["predictions"], f"""
    with newest as (select prediction_id as pid from predictions where risk_level = 'High' order by generated_at desc, prediction_id desc limit 1)
    select * from ({_SUMMARY}) where prediction_id = (select pid from newest)""")
def lookup_one(load):
    newest = load("predictions").filter("risk_level = 'High'").orderBy(F.col("generated_at").desc(), F.col("prediction_id").desc()).limit(1)
    stored = explain.explanations(load("predictions"))
    return explain.explanation_for(stored, newest.select("prediction_id").scalar()).select("prediction_id", "plain_language_summary")


# --- user models --------------------------------------------------------------


@query("u01_sequence_model", ["sensor_readings"], f"""
    select region_id, round(avg(coalesce(rainfall_mm, 0)), 6) as mean_rain, round(max(coalesce(wind_speed_kmh, 0)), 6) as max_wind from {BUFFER} group by 1""")
def sequence_model(load):
    def model(pdf):
        return [pdf["rainfall_mm"].fillna(0.0).mean(), pdf["wind_speed_kmh"].fillna(0.0).max()]

    cols = _buffer(load).select("region_id", "recency", "rainfall_mm", "wind_speed_kmh")
    return with_model(cols, model).select("region_id", F.round(F.col("vec")[0], 6).alias("mean_rain"), F.round(F.col("vec")[1], 6).alias("max_wind"))


@query("u02_score_head", ["sensor_readings", "region_adjacency"], f"""
    with {_chain()} select region_id, disaster_type, round(100 * list_sum(list_transform(vec, lambda x: x * x)), 6) as raw_pct from blended""")
def score_head(load):
    ema = _ema(load)
    flood_vec = fe.region_vectors(ema, fe.ROUTED_SENSOR_FIELDS["flood"])
    blended = fe.blend_spatial(fe.hazard_vectors(ema), fe.propagate(flood_vec, load("region_adjacency")))
    out = with_head(fe.with_context(blended, flood=flood_vec), lambda vec, ctx, hazard: 100.0 * (vec * vec).sum(axis=1))
    return out.select("region_id", "disaster_type", six("raw_pct"))


@query("u03_image_model", ["image_pixels"], f"""
    select image_id, {_SHARES} from (select image_id, floor(r * 255e0 + 0.5e0) / 255e0 as r, floor(g * 255e0 + 0.5e0) / 255e0 as g,
        floor(b * 255e0 + 0.5e0) / 255e0 as b from image_pixels) group by 1""")
def image_model(load):
    out = with_image_model(load("image_rows"))
    return out.select(
        F.col("image_id").cast("bigint").alias("image_id"), six("flood_inundation_pct"), six("cloud_density"), six("vegetation_index"))
