"""Checks on incoming records: required fields, plausibility, contracts, optional filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import constants as K
from perilgrid.functions.columns import clamp, sql_literal

SENSOR_REQUIRED = ("sensor_id", "region_id", "reading_ts", "stream_status")
SATELLITE_REQUIRED = ("image_id", "region_id", "provider", "captured_at", "received_at", "resolution_m")


def first_missing(fields: tuple[str, ...]) -> Column:
    """Name of the first field, in order, that is null or an empty string."""
    gone = [F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in fields]
    return F.coalesce(*gone)


def mark_rejects(df: DataFrame, fields: tuple[str, ...] = SENSOR_REQUIRED) -> DataFrame:
    return df.withColumn("reject_field", first_missing(fields))


def accepted(df: DataFrame, fields: tuple[str, ...] = SENSOR_REQUIRED) -> DataFrame:
    return df.filter(first_missing(fields).isNull())


def out_of_range(field: str) -> Column:
    lo, hi = K.PLAUSIBLE[field]
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (F.col(field) < lo)
    if hi is not None:
        bad = bad | (F.col(field) > hi)
    return F.coalesce(bad, F.lit(False))


def flag_anomalous(df: DataFrame) -> DataFrame:
    """Sets ``is_anomalous`` from the physical bounds; nulls are not judged."""
    any_bad = F.lit(False)
    for field in K.PLAUSIBLE:
        any_bad = any_bad | out_of_range(field)
    return df.withColumn("is_anomalous", any_bad)


def validated(df: DataFrame) -> DataFrame:
    """What reaches the validated feed: complete and plausible rows."""
    return flag_anomalous(accepted(df)).filter(~F.col("is_anomalous"))


def validation_summary(df: DataFrame) -> DataFrame:
    """Rejected rows per missing field and anomalous values per field, in one pass."""
    missing = first_missing(SENSOR_REQUIRED)
    checks = [("rejected", f, F.coalesce(missing == f, F.lit(False))) for f in SENSOR_REQUIRED]
    checks += [("anomalous", f, missing.isNull() & out_of_range(f)) for f in K.PLAUSIBLE]
    counts = df.agg(*[F.count_if(c).alias(f"{k}_{f}") for k, f, c in checks])
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("check"), F.lit(f).alias("field"), F.col(f"{k}_{f}").alias("n_rows"))
            for k, f, _ in checks
        ]
    )
    return counts.select(F.inline(rows))


def check_satellite(df: DataFrame) -> DataFrame:
    """Complete image metadata with a positive resolution."""
    return accepted(df, SATELLITE_REQUIRED).filter(F.col("resolution_m") > 0)


def check_report(df: DataFrame) -> DataFrame:
    """Crowd report forms with type, user and a numeric position."""
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    have = (F.coalesce("disaster_type", F.lit("")) != "") & (F.coalesce("user_id", F.lit("")) != "")
    return df.withColumns({"lat": lat, "lon": lon}).filter(have & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def clamp_scores(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: clamp(F.col(c), 0.0, 100.0) for c in ("probability_pct", "severity_index")}
    )


def optional_filter(
    df: DataFrame,
    time_col: str,
    region_id: str | None = None,
    disaster_type: str | None = None,
    from_: str | None = None,
    to: str | None = None,
) -> DataFrame:
    """Filters only for the arguments given; both time bounds are inclusive.

    The bounds are cast to the column's own type so that the predicate reaches
    the Parquet scan.
    """
    kind = dict(df.dtypes)[time_col]
    if region_id:
        df = df.filter(F.col("region_id") == region_id)
    if disaster_type:
        df = df.filter(F.col("disaster_type") == disaster_type)
    if from_:
        df = df.filter(F.col(time_col) >= F.lit(from_).cast(kind))
    if to:
        df = df.filter(F.col(time_col) <= F.lit(to).cast(kind))
    return df


def alertable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("risk_level") != "Low")


# The message contracts. type, enum, minimum, maximum.
_S, _N, _I = "string", "number", "integer"
CONTRACTS: dict[str, dict] = {
    "prediction": {
        "required": [
            "prediction_id", "region_id", "disaster_type", "forecast_horizon_h", "risk_level",
            "probability_pct", "severity_index", "generated_at", "model_version", "input_data_snapshot_id",
        ],
        "fields": {
            "prediction_id": {"type": _S},
            "region_id": {"type": _S},
            "disaster_type": {"type": _S, "enum": list(K.HAZARDS)},
            "forecast_horizon_h": {"type": _I, "enum": [6, 24, 72]},
            "risk_level": {"type": _S, "enum": list(K.RISKS)},
            "probability_pct": {"type": _N, "min": 0, "max": 100},
            "time_to_impact_h": {"type": _N, "null": True, "min": 0},
            "severity_index": {"type": _N, "min": 0, "max": 100},
            "generated_at": {"type": _S},
            "model_version": {"type": _S},
            "input_data_snapshot_id": {"type": _S},
        },
    },
    "alert": {
        "required": [
            "alert_id", "prediction_id", "region_id", "disaster_type", "risk_level", "time_to_impact_h",
            "recommended_action", "language_code", "channel", "dispatched_at", "delivery_status", "retry_count",
        ],
        "fields": {
            "alert_id": {"type": _S},
            "prediction_id": {"type": _S},
            "region_id": {"type": _S},
            "disaster_type": {"type": _S},
            "risk_level": {"type": _S, "enum": ["Medium", "High"]},
            "time_to_impact_h": {"type": _N, "min": 0},
            "recommended_action": {"type": _S},
            "evacuation_route_id": {"type": _S, "null": True},
            "language_code": {"type": _S},
            "channel": {"type": _S, "enum": ["sms", "push", "voice"]},
            "dispatched_at": {"type": _S},
            "delivery_status": {"type": _S, "enum": ["sent", "delivered", "failed"]},
            "retry_count": {"type": _I, "min": 0, "max": 3},
        },
    },
    "weather_schema": {
        "required": ["forecast_id", "region_id", "fetched_at", "provider"],
        "fields": {
            "forecast_id": {"type": _S},
            "region_id": {"type": _S},
            "fetched_at": {"type": _S},
            "provider": {"type": _S},
            "precipitation_probability_pct": {"type": _N, "null": True, "min": 0, "max": 100},
            "temperature_c": {"type": _N, "null": True, "min": -90, "max": 60},
            "wind_speed_kmh": {"type": _N, "null": True, "min": 0},
            "wind_direction_deg": {"type": _N, "null": True, "min": 0, "max": 360},
            "forecast_horizon_h": {"type": _I, "enum": [6, 24, 72]},
        },
    },
    # the shape the feed really sends
    "weather": {
        "required": ["region_id", "fetched_at", "source"],
        "fields": {
            "region_id": {"type": _S},
            "fetched_at": {"type": _S},
            "precipitation_prob_pct": {"type": _N, "min": 0, "max": 100},
            "temperature_forecast_c": {"type": _N, "min": -90, "max": 60},
            "wind_forecast_kmh": {"type": _N, "min": 0},
            "forecast_horizon_h": {"type": _I, "enum": [6, 24, 72]},
            "source": {"type": _S},
        },
    },
}


def contract_violations(df: DataFrame, contract: str, value: str = "value") -> DataFrame:
    """Adds ``violations``: sorted texts such as ``enum:risk_level``; empty when the JSON keeps the contract.

    Text that is not a JSON object gives the one violation ``json``.  The text
    is parsed once, then each field's kind and number are read once into
    columns of their own, which the rules share.
    """
    spec = CONTRACTS[contract]
    fields = list(spec["fields"].items())
    df = df.withColumns({"_doc": F.try_parse_json(value), "_keys": F.json_object_keys(value)})
    read: dict[str, Column] = {}
    for i, (name, rule) in enumerate(fields):
        path = f"$.{name}"
        read[f"_k{i}"] = F.when(
            F.array_contains("_keys", name),
            F.coalesce(F.schema_of_variant(F.try_variant_get("_doc", path, "variant")), F.lit("VOID")),
        )
        if rule["type"] == "string":
            if "enum" in rule:
                read[f"_v{i}"] = F.try_variant_get("_doc", path, "string")
        else:
            read[f"_v{i}"] = F.try_variant_get("_doc", path, "double")
    df = df.withColumns(read)
    rules = {f"required:{n}": f"not array_contains(_keys, '{n}')" for n in spec["required"]}
    for i, (name, rule) in enumerate(fields):
        k, v = f"_k{i}", f"_v{i}"
        right = f"{k} = 'STRING'"
        if rule["type"] != "string":
            right = f"({k} in ('BIGINT', 'DOUBLE', 'FLOAT') or startswith({k}, 'DECIMAL'))"
        if rule["type"] == "integer":
            right = f"({right} and {v} = floor({v}))"
        rules[f"type:{name}"] = f"{k} <> 'VOID' and not {right}" if rule.get("null") else f"not {right}"
        if "enum" in rule:
            inside = ", ".join(sql_literal(x) for x in rule["enum"])
            rules[f"enum:{name}"] = f"{right} and {v} not in ({inside})"
        if "min" in rule:
            rules[f"min:{name}"] = f"{right} and {v} < {rule['min']}"
        if "max" in rule:
            rules[f"max:{name}"] = f"{right} and {v} > {rule['max']}"
    # Texts are joined in their sorted order; concat_ws leaves out the rules that hold.
    known = ", ".join(f"'{n}'" for n, _ in fields)
    extras = f"transform(array_sort(array_except(_keys, array({known}))), k -> concat('extra:', k))"
    texts = {name: f"case when {broken} then '{name}' end" for name, broken in rules.items()}
    texts["extra:"] = extras
    joined = F.expr(f"concat_ws('\u0001', {', '.join(texts[name] for name in sorted(texts))})")
    listed = F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, "\u0001"))
    broken = F.col("_keys").isNull() | F.col("_doc").isNull()
    return df.withColumn("violations", F.when(broken, F.array(F.lit("json"))).otherwise(listed)).drop("_doc", "_keys", *read)
