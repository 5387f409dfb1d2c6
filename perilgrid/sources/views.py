"""Domain tables taken from the given Parquet tables.

Each view is a base table and one or two projections written in the subset of
SQL that Spark and DuckDB read alike, so both sides of a check see the same
rows.  ``@addsec[t|n]`` adds n seconds to t, ``@list[a|b]`` makes an array.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.functions import constants as K


def rid(e: str) -> str:
    return f"concat('r', lpad(cast({e} as string), 9, '0'))"


def tenth(e: str) -> str:
    return f"cast(floor({e} / 10e0) as bigint)"


def hazard(e: str) -> str:
    arms = " ".join(f"when {i} then '{h}'" for i, h in enumerate(K.HAZARDS[:-1]))
    return f"case {e} % 5 {arms} else '{K.HAZARDS[-1]}' end"


_P = "cast(cast(floor(o_totalprice) as bigint) % 1000 as double) / 10e0"

VIEWS: dict[str, tuple[str, list[dict[str, str]]]] = {
    "sensor_readings": ("events", [{
        "reading_id": "event_id",
        "sensor_id": "concat('s', lpad(cast(user_id * 10 + event_id % 7 as string), 10, '0'))",
        "region_id": rid("user_id"),
        "reading_ts": "ts",
        "rainfall_mm": "case when event_id % 11 = 0 then null else value * 0.2e0 end",
        "temperature_c": "case when event_id % 13 = 0 then null else value / 5e0 - 10e0 end",
        "river_level_m": "cast(event_id % 50 as double) / 10e0 - 0.1e0",
        "soil_moisture_pct": "cast(event_id % 104 as double)",
        "wind_speed_kmh": "value * 0.3e0",
        "wind_direction_deg": "cast(event_id % 365 as double)",
        "stream_status": "case when event_id % 97 = 0 then '' when event_type = 'error' then 'degraded' else 'ok' end",
    }]),
    "predictions": ("orders", [
        {
            "prediction_id": "o_orderkey",
            "region_id": rid(tenth("o_custkey")),
            "disaster_type": hazard("o_orderkey"),
            "forecast_horizon_h": "case o_orderkey % 3 when 0 then 6 when 1 then 24 else 72 end",
            "p": _P,
            "generated_at": "o_orderdate",
        },
        {
            "prediction_id": "prediction_id",
            "region_id": "region_id",
            "disaster_type": "disaster_type",
            "forecast_horizon_h": "forecast_horizon_h",
            "risk_level": "case when p >= 65e0 then 'High' when p >= 35e0 then 'Medium' else 'Low' end",
            "probability_pct": "p",
            "time_to_impact_h": "case when p >= 35e0 then 24e0 * (1e0 - (p - 35e0) / 65e0) end",
            "severity_index": "p * 0.9e0",
            "generated_at": "generated_at",
            "model_version": "'1.0.0'",
        },
    ]),
    "actual_outcomes": ("lineitem", [{
        "prediction_id": "l_orderkey",
        "outcome_no": "l_linenumber",
        "actual_occurred": "l_returnflag = 'R'",
        "actual_severity": "l_quantity * 2e0",
        "recorded_at": "l_shipdate",
    }]),
    "historical_disaster_events": ("orders", [{
        "event_id": "o_orderkey",
        "region_id": rid(tenth("o_custkey")),
        "disaster_type": hazard("o_orderkey"),
        "start_date": "cast(o_orderdate as date)",
        "end_date": "cast(@addsec[o_orderdate|86400 * (o_orderkey % 4)] as date)",
        "severity": "cast(cast(floor(o_totalprice) as bigint) % 101 as double)",
        "source": "o_orderpriority",
    }]),
    "users": ("customer", [{
        "user_id": "c_custkey",
        "phone_number": "case when c_acctbal >= 0e0 then concat('+1', lpad(cast(c_custkey as string), 10, '0')) end",
        "push_token": "case when c_custkey % 7 <> 0 then concat('tok', cast(c_custkey as string)) end",
        "language_code": "case c_mktsegment when 'BUILDING' then 'en-GB' when 'MACHINERY' then 'es' "
                         "when 'HOUSEHOLD' then 'fr' when 'AUTOMOBILE' then 'hi' else '' end",
        "region_ids": "@list[" + rid(tenth("c_custkey")) + "|" + rid(f"({tenth('c_custkey')} + 1)") + "]",
        "notification_channels": "case c_custkey % 4 when 0 then @list['sms'|'push'] when 1 then @list['push'|'voice'] "
                                 "when 2 then @list['voice'|'sms'] else @list['push'|'sms'] end",
        "is_infrastructure_operator": "c_custkey % 10 = 0",
    }]),
    "region_adjacency": ("customer", [
        {
            "here": tenth("c_custkey"),
            "there": f"{tenth('c_custkey')} + c_custkey % 10 - 4",
        },
        {
            "region_id": rid("here"),
            "neighbour_id": f"case when there >= 0 and there <> here then {rid('there')} end",
            "edge_weight": "1e0 / (1e0 + cast(abs(there - here) as double))",
        },
    ]),
    "infrastructure_assets": ("supplier", [{
        "asset_id": "s_suppkey",
        "region_id": rid("s_suppkey"),
        "asset_type": "case when s_suppkey % 2 = 0 then 'dam' else 'urban_drainage' end",
        "name": "s_name",
        "capacity_m3": "s_acctbal",
        "operator_user_ids": "@list[concat('u', cast(s_suppkey as string))|concat('u', cast(s_suppkey + 1 as string))]",
    }]),
    "terrain": ("part", [{
        "region_id": rid("cast(floor(p_partkey / 20e0) as bigint)"),
        "load_no": "p_partkey",
        "elevation_m": "cast(p_size as double) * 10e0",
        "terrain_type": "p_type",
        "slope_gradient": "cast(p_partkey % 9 as double) * 4e0",
    }]),
    "drainage": ("supplier", [{
        "region_id": rid("cast(floor(s_suppkey / 2e0) as bigint)"),
        "load_no": "s_suppkey",
        "capacity_m3": "s_acctbal",
        "is_urban": "s_suppkey % 3 <> 0",
        "is_operational": "s_suppkey % 5 <> 0",
    }]),
    "weather_forecasts": ("orders", [{
        "forecast_id": "o_orderkey",
        "region_id": "case when o_orderkey % 17 <> 0 then " + rid(tenth("o_custkey")) + " end",
        "fetched_at": "o_orderdate",
        "precipitation_prob_pct": _P + " + 2e0",
        "temperature_forecast_c": "cast(o_orderkey % 160 as double) - 95e0",
        "wind_forecast_kmh": "cast(o_orderkey % 120 as double) - 1e0",
        "forecast_horizon_h": "case o_orderkey % 4 when 0 then 6 when 1 then 24 when 2 then 72 else 48 end",
        "source": "case when o_orderkey % 19 <> 0 then o_orderpriority end",
    }]),
    "satellite_images": ("events", [{
        "image_id": "case when event_id % 41 = 0 then '' else concat('i', cast(event_id as string)) end",
        "region_id": rid("user_id"),
        "provider": "case when event_id % 43 = 0 then null else event_type end",
        "captured_at": "ts",
        "received_at": "@addsec[ts|event_id % 400]",
        "processed_at": "@addsec[ts|event_id % 400 + event_id % 457]",
        "resolution_m": "case when event_id % 47 = 0 then null else value - 5e0 end",
    }]),
    "cnn_features": ("events", [{
        "image_id": "event_id",
        "region_id": rid("user_id"),
        "extracted_at": "ts",
        "flood_inundation_pct": "cast(event_id % 101 as double)",
        "cloud_density": "cast(event_id % 100 as double) / 100e0",
        "vegetation_index": "cast(event_id % 37 as double) / 37e0",
    }]),
    "crowd_reports": ("events", [{
        "report_id": "event_id",
        "user_id": "user_id",
        "region_id": rid(tenth("user_id")),
        "disaster_type": "case event_type when 'click' then 'flood' when 'view' then 'heatwave' "
                         "when 'error' then 'landslide' else 'cyclone' end",
        "description": "case event_id % 4 when 0 then 'Road BLOCKED by debris' when 1 then 'road closed' "
                       "when 2 then 'water rising' end",
        "reported_at": "ts",
        "lat": "-60e0 + floor(user_id / 1000e0) * 0.1e0 + cast(event_id % 200 as double) * 0.0008e0",
        "lon": "-170e0 + cast(user_id % 1000 as double) * 0.3e0 + cast(event_id % 130 as double) * 0.003e0",
    }]),
    # a form as it arrives: everything is text
    "report_forms": ("events", [{
        "report_id": "event_id",
        "user_id": "case when event_id % 23 = 0 then '' else cast(user_id as string) end",
        "disaster_type": "case when event_id % 29 = 0 then null else event_type end",
        "lat": "case event_id % 31 when 0 then 'north' when 1 then null else cast(event_id % 90 as string) end",
        "lon": "case event_id % 37 when 0 then '12,5' else concat(cast(event_id % 180 as string), '.5') end",
    }]),
    "gov_payloads": ("events", [
        {
            "payload_id": "event_id",
            "feed": "event_type",
            "rec": "concat('{\"record_id\":\"g', cast(event_id as string), '\",\"region_id\":\"', "
                   + rid("user_id") + ", '\",\"data_type\":\"', event_type, '\",\"source\":\"', "
                   "case when event_id % 3 = 0 then '' else 'agency' end, '\"}')",
            "fetched": "ts",
        },
        {
            "payload_id": "payload_id",
            "feed": "feed",
            "fetched": "fetched",
            "payload": "case when payload_id % 2 = 1 then concat('[', rec, ',', replace(rec, '\"g', '\"h'), ']') else rec end",
        },
    ]),
    # what people wrote, with words of the domain put into the middle of it
    "chat_queries": ("conversations", [
        {
            "conv_id": "conv_id",
            "turn": "turn",
            "said": "coalesce(text, '')",
            "put": "case turn % 3 when 0 then concat('What is the ', case conv_id % 3 when 0 then 'Flood ' when 1 then 'cyclone ' "
                   "else '' end, 'risk in ', upper(" + rid("(conv_id * 2)") + ")) "
                   "when 1 then concat('Is it safe to travel to ', " + rid("(conv_id * 2)") + ") "
                   "else case when conv_id % 2 = 0 then 'what should I prepare' else concat('how to prepare in ', "
                   + rid("conv_id") + ") end end",
            "asked_region": "case when conv_id % 10 = 0 and turn % 3 = 2 then " + rid("(conv_id + 1)") + " end",
        },
        {
            "conv_id": "conv_id",
            "turn": "turn",
            "question": "concat(substring(said, 1, cast((conv_id * 13 + turn * 7) % (length(said) + 1) as int)), ' ', put, ' ', "
                        "substring(said, cast((conv_id * 13 + turn * 7) % (length(said) + 1) as int) + 1))",
            "asked_region": "asked_region",
        },
    ]),
    "zones": ("supplier", [{
        "zone_id": "s_suppkey",
        "region_id": rid("s_suppkey"),
        "hazard_type": "case s_suppkey % 3 when 0 then 'flood_inundation' when 1 then 'landslide_high' else 'wildfire' end",
        "lon0": "-170e0 + cast(s_suppkey % 1000 as double) * 0.3e0",
        "lat0": "-60e0 + floor(s_suppkey / 1000e0) * 0.1e0",
    }]),
    "road_nodes": ("supplier", [{
        "node_id": "s_suppkey",
        "lat": "-60e0 + floor(s_suppkey / 10e0) * 0.01e0",
        "lon": "-170e0 + cast(s_suppkey % 10 as double) * 0.05e0",
        "label": "case when s_suppkey % 4 <> 0 then s_name end",
    }]),
    "dispatches": ("orders", [
        {
            "prediction_id": "o_orderkey",
            "disaster_type": hazard("o_orderkey"),
            "p": _P,
            "generated_at": "o_orderdate",
            "dispatched_at": "@addsec[o_orderdate|o_orderkey % 1300]",
        },
        {
            "prediction_id": "prediction_id",
            "disaster_type": "disaster_type",
            "risk_level": "case when p >= 65e0 then 'High' when p >= 35e0 then 'Medium' else 'Low' end",
            "generated_at": "generated_at",
            "dispatched_at": "dispatched_at",
        },
    ]),
    "districts": ("supplier", [{
        "district_id": "concat('d', lpad(cast(s_suppkey as string), 8, '0'))",
        "region_id": rid("s_suppkey"),
        "name": "s_name",
        "lat": "10e0 + cast(s_suppkey % 60 as double)",
        "lon": "70e0 + cast(s_suppkey % 90 as double)",
    }]),
    "prone_villages": ("part", [{
        "village_id": "p_partkey",
        "village_name": "p_name",
        "district_id": "concat('d', lpad(cast(cast(floor(p_partkey / 20e0) as bigint) as string), 8, '0'))",
        "lat": "10e0 + cast(p_partkey % 60 as double)",
        "lon": "70e0 + cast(p_partkey % 90 as double)",
        "incidents": "p_size",
        "disaster_types": "@list[" + hazard("p_partkey") + "|" + hazard("(p_partkey + 1)") + "]",
        "last_event": "p_type",
    }]),
}

# Views that need an explode or a join: one Spark builder and one SQL text each.
_RING = ((0.0, 0.0), (0.33, 0.01), (0.3, 0.09), (0.15, 0.05), (0.02, 0.1))

DERIVED_SQL: dict[str, str] = {
    "image_pixels": """
        select vec_id as image_id, i as pixel_no,
               least(greatest(cast(embedding[i + 1] as double) * 2e0 + 0.5e0, 0e0), 1e0) as r,
               least(greatest(cast(embedding[(i + 1) % len(embedding) + 1] as double) * 2e0 + 0.5e0, 0e0), 1e0) as g,
               least(greatest(cast(embedding[(i + 2) % len(embedding) + 1] as double) * 2e0 + 0.5e0, 0e0), 1e0) as b
        from (select vec_id, embedding, unnest(range(0, len(embedding))) as i from embeddings)""",
    "road_edges": """
        select a.s_suppkey * 100 + d as edge_id, a.s_suppkey as from_node, b.s_suppkey as to_node,
               1e0 + cast((a.s_suppkey * 7 + b.s_suppkey * 3) % 11 as double) as distance_km,
               concat('road', cast(a.s_suppkey % 97 * 10 + d as varchar)) as road_id,
               (a.s_suppkey * 5 + b.s_suppkey) % 23 = 0 as is_blocked
        from (select s_suppkey, unnest([1, 10]) as d from supplier) a
        join supplier b on b.s_suppkey = a.s_suppkey + d
        where d = 10 or a.s_suppkey % 10 <> 9""",
    "send_attempts": """
        select l_orderkey as prediction_id, o_custkey as user_id,
               case when l_linenumber <= 3 then 'push' when l_linenumber <= 5 then 'sms' else 'voice' end as channel,
               case l_linenumber when 1 then 'push' when 6 then 'voice' else 'sms' end as transport,
               case l_linenumber when 3 then 1 when 5 then 1 else 0 end as attempt,
               cast(l_quantity as bigint) % 3 = 0 as ok
        from lineitem join orders on o_orderkey = l_orderkey""",
    "zone_edges": "select zone_id, k.i, "
        + "lon0 + k.x1 as x1, lat0 + k.y1 as y1, lon0 + k.x2 as x2, lat0 + k.y2 as y2 from zones, (values "
        + ", ".join(
            f"({i}, {x}::double, {y}::double, {_RING[i - 1][0]}::double, {_RING[i - 1][1]}::double)"
            for i, (x, y) in enumerate(_RING)
        )
        + ") k(i, x1, y1, x2, y2)",
}
DERIVED_NEEDS = {"zone_edges": ["zones"]}


def _render(expr: str, engine: str) -> str:
    if engine == "spark":
        expr = re.sub(r"@addsec\[([^|\]]*)\|([^\]]*)\]", r"(\1 + make_dt_interval(0, 0, 0, \2))", expr)
    else:
        expr = re.sub(r"@addsec\[([^|\]]*)\|([^\]]*)\]", r"(\1 + to_seconds(\2))", expr)
    while "@list[" in expr:
        start = expr.index("@list[")
        end = expr.index("]", start)
        items = expr[start + 6:end].split("|")
        made = f"array({', '.join(items)})" if engine == "spark" else f"list_value({', '.join(items)})"
        expr = expr[:start] + made + expr[end + 1:]
    return expr


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain table as a lazy DataFrame."""
    if name in _BUILDERS:
        return _BUILDERS[name](spark, sf_dir)
    table, steps = VIEWS[name]
    df = base(spark, sf_dir, table)
    for step in steps:
        df = df.selectExpr(*[f"{_render(e, 'spark')} as {c}" for c, e in step.items()])
    if name == "region_adjacency":
        df = df.filter("neighbour_id is not null")
    if name == "zones":
        ring = F.array(*[F.struct((F.col("lon0") + x).alias("lon"), (F.col("lat0") + y).alias("lat")) for x, y in _RING])
        df = df.select("zone_id", "region_id", "hazard_type", ring.alias("ring"))
    return df


def view_sql(name: str) -> str:
    """The same table as a query DuckDB runs over the raw tables."""
    if name in DERIVED_SQL:
        return DERIVED_SQL[name]
    table, steps = VIEWS[name]
    sql = table
    for step in steps:
        cols = ", ".join(f"{_render(e, 'duckdb')} as {c}" for c, e in step.items())
        sql = f"select {cols} from {sql}" if sql == table else f"select {cols} from ({sql})"
    if name == "region_adjacency":
        sql = f"select * from ({sql}) where neighbour_id is not null"
    return sql


def with_views(names: list[str], body: str) -> str:
    """Prefix a check query with the domain tables it reads."""
    ordered: list[str] = []
    for n in names:
        for need in [*DERIVED_NEEDS.get(n, []), n]:
            if need not in ordered:
                ordered.append(need)
    ctes = ",\n".join(f"{n} as ({view_sql(n)})" for n in ordered)
    body = body.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{body[len('with recursive'):].strip()}"
    if body.lower().startswith("with"):
        return f"with {ctes},\n{body[4:].strip()}"
    return f"with {ctes}\n{body}"


def _image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel per component of the vector; its colours are the component and the two after it, round the end."""
    e = base(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), "embedding", F.posexplode("embedding").alias("pixel_no", "_")
    )
    return e.select("image_id", "pixel_no", *[_shade("embedding", F.col("pixel_no"), c).alias("rgb"[c]) for c in range(3)])


def _shade(vector: str, place, channel: int):
    raw = F.element_at(vector, ((place + channel) % F.size(vector) + 1).cast("int")).cast("double")
    return F.least(F.greatest(raw * 2.0 + 0.5, F.lit(0.0)), F.lit(1.0))


def _image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of each image as Spark's ``image`` source gives them: one row high, bytes in the order b, g, r."""
    byte = lambda x: F.lpad(F.hex(F.floor(x * 255.0 + 0.5).cast("bigint")), 2, "0")
    pixel = lambda _, i: F.concat(*[byte(_shade("embedding", i, c)) for c in (2, 1, 0)])
    return base(spark, sf_dir, "embeddings").select(
        F.struct(
            F.col("vec_id").cast("string").alias("origin"),
            F.lit(1).alias("height"),
            F.size("embedding").alias("width"),
            F.lit(3).alias("nChannels"),
            F.lit(16).alias("mode"),
            F.unhex(F.array_join(F.transform("embedding", pixel), "")).alias("data"),
        ).alias("image")
    )


def _road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("from_node"))
    a = s.select("from_node", F.explode(F.array(F.lit(1), F.lit(10))).alias("d")).filter("d = 10 or from_node % 10 <> 9")
    a = a.withColumn("to_node", F.col("from_node") + F.col("d"))
    real = s.withColumnRenamed("from_node", "to_node")
    return a.join(real, "to_node", "left_semi").selectExpr(
        "from_node * 100 + d as edge_id",
        "from_node",
        "to_node",
        "1e0 + cast((from_node * 7 + to_node * 3) % 11 as double) as distance_km",
        "concat('road', cast(from_node % 97 * 10 + d as string)) as road_id",
        "(from_node * 5 + to_node) % 23 = 0 as is_blocked",
    )


def _send_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A try per order line: the order is the prediction, its customer the user, the line number says which try."""
    lines = base(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = base(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "l_orderkey as prediction_id",
        "o_custkey as user_id",
        "case when l_linenumber <= 3 then 'push' when l_linenumber <= 5 then 'sms' else 'voice' end as channel",
        "case l_linenumber when 1 then 'push' when 6 then 'voice' else 'sms' end as transport",
        "case l_linenumber when 3 then 1 when 5 then 1 else 0 end as attempt",
        "cast(l_quantity as bigint) % 3 = 0 as ok",
    )


_BUILDERS = {"image_pixels": _image_pixels, "image_rows": _image_rows, "road_edges": _road_edges, "send_attempts": _send_attempts}
