"""Explanations of predictions.  Every step works inside the row; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import constants as K
from perilgrid.functions.columns import lookup, py_number, sql_literal, stable_id

MIN_FACTORS = 3
_FACTOR = "array<struct<feature_name:string,contribution_pct:double,direction:string>>"


def proxy_values(hazard: Column, prob: Column, sev: Column) -> Column:
    """Map of feature name to a plausible value, rebuilt from the prediction itself."""
    nil = F.lit(0.0)
    formulas = {
        "flood": {
            "rainfall_mm": prob * 0.5,
            "river_level_m": prob * 0.03,
            "soil_moisture_pct": sev * 0.8,
            "elevation": F.greatest(nil, F.lit(100.0) - sev),
            "drainage_capacity": F.greatest(nil, F.lit(100.0) - prob * 0.8),
        },
        "heatwave": {
            "temperature_c": F.lit(20.0) + prob * 0.2,
            "humidity": sev * 0.7,
            "wind_speed_kmh": F.greatest(nil, F.lit(30.0) - prob * 0.2),
            "historical_heatwave_flag": F.when(prob > 50, 1.0).otherwise(0.0),
        },
        "drought": {
            "rainfall_deficit_mm": -prob * 0.4,
            "soil_moisture_trend": -sev * 0.3,
            "temperature_anomaly_c": prob * 0.1,
            "rolling_window_days": F.lit(30.0),
        },
        "landslide": {
            "rainfall_intensity_mm": prob * 0.4,
            "soil_moisture_pct": sev * 0.8,
            "elevation_gradient": prob * 0.005,
            "terrain_slope": sev * 0.3,
        },
        "cyclone": {
            "wind_speed_kmh": prob * 1.5,
            "cloud_density": prob * 0.008,
            "sea_surface_temp_c": F.lit(25.0) + prob * 0.05,
            "wind_direction_deg": F.lit(180.0),
        },
    }
    made = {
        h: F.create_map(*[x for name, value in table.items() for x in (F.lit(name), value)])
        for h, table in formulas.items()
    }
    return lookup(hazard, made, F.expr("cast(map() as map<string,double>)"))


def with_proxy_values(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn(
        "feature_values", proxy_values(F.col("disaster_type"), F.col("probability_pct"), F.col("severity_index"))
    )


def _weights(hazard: str) -> Column:
    tables = " ".join(
        f"when '{h}' then array({', '.join(f'struct({i} as pos, {sql_literal(f)} as feature, {w}D as weight)' for i, (f, w) in enumerate(t.items()))})"
        for h, t in K.FACTOR_WEIGHTS.items()
    )
    equal = (
        "transform(map_keys(feature_values), (f, i) -> "
        "struct(i as pos, f as feature, 1D / size(map_keys(feature_values)) as weight))"
    )
    return F.expr(f"case {hazard} {tables} else {equal} end")


def with_factors(df: DataFrame) -> DataFrame:
    """Adds ``factors``: contributions in percent, largest first, those under 0.5 left out.

    The scores are summed and divided within one ``aggregate``.  A total kept
    in a column of its own would be inlined into the per-element lambda by the
    optimizer and summed anew for every factor.
    """

    def scored(w: Column) -> Column:
        v = F.coalesce(F.try_element_at("feature_values", w["feature"]), F.lit(0.0))
        return F.struct(
            (-(w["weight"] * F.abs(v) / (F.abs(v) + 1.0))).alias("order"), w["pos"].alias("pos"),
            w["feature"].alias("feature"), (v >= 0).alias("up"),
        )

    def add(acc: Column, s: Column) -> Column:
        return F.struct((acc["total"] - s["order"]).alias("total"), F.concat(acc["items"], F.array(s)).alias("items"))

    def shares(acc: Column) -> Column:
        total = acc["total"]

        def factor(s: Column) -> Column:
            share = F.when(total == 0, 0.0).otherwise(-s["order"] / total * 100.0)
            return F.struct(
                s["feature"].alias("feature_name"), F.round(share, 1).alias("contribution_pct"),
                F.when(s["up"], "positive").otherwise("negative").alias("direction"),
            )

        return F.filter(F.transform(acc["items"], factor), lambda f: f["contribution_pct"] >= 0.5)

    start = F.expr(
        "named_struct('total', 0D, 'items', cast(array() as array<struct<order:double,pos:int,feature:string,up:boolean>>))"
    )
    ordered = F.array_sort(F.transform(_weights("disaster_type"), scored))
    return df.withColumn("factors", F.aggregate(ordered, start, add, shares).cast(_FACTOR))


def pad_factors(df: DataFrame) -> DataFrame:
    """Medium and High predictions list at least three factors; the fill is 1.0 % each, in table order."""
    names = F.transform("factors", lambda f: f["feature_name"])
    unused = F.filter(_weights("disaster_type"), lambda w: ~F.array_contains(names, w["feature"]))
    fill = F.transform(
        F.slice(unused, 1, F.greatest(F.lit(MIN_FACTORS) - F.size("factors"), F.lit(0))),
        lambda w: F.struct(
            w["feature"].alias("feature_name"), F.lit(1.0).alias("contribution_pct"), F.lit("positive").alias("direction")
        ),
    ).cast(_FACTOR)
    short = F.col("risk_level").isin("Medium", "High") & (F.size("factors") < MIN_FACTORS)
    return df.withColumn("factors", F.when(short, F.concat("factors", fill)).otherwise(F.col("factors")))


def with_summary(df: DataFrame) -> DataFrame:
    """Plain sentence naming the top three factors."""

    def part(f: Column) -> Column:
        shown = lookup(f["feature_name"], K.FACTOR_NAMES, F.replace(f["feature_name"], F.lit("_"), F.lit(" ")))
        return F.concat(shown, F.lit(" ("), py_number(f["contribution_pct"]), F.lit("%)"))

    head = F.concat(
        F.upper(F.substring("disaster_type", 1, 1)), F.lower(F.expr("substring(disaster_type, 2)")),
        F.lit(" risk is "), F.col("risk_level"),
    )
    top = F.concat_ws(", ", F.transform(F.slice("factors", 1, 3), part))
    text = F.when(F.size("factors") > 0, F.concat(head, F.lit(" due to: "), top, F.lit("."))).otherwise(
        F.concat(head, F.lit("."))
    )
    return df.withColumn("plain_language_summary", text)


def explanations(predictions: DataFrame) -> DataFrame:
    """Explanation records, one per prediction."""
    full = with_summary(pad_factors(with_factors(with_proxy_values(predictions))))
    return full.select(
        stable_id(F.lit("explanation"), F.col("prediction_id").cast("string")).alias("explanation_id"),
        "prediction_id", "generated_at", F.col("factors").alias("contributing_factors"), "plain_language_summary",
    )


def store_explanations(records: DataFrame, path: str, parts: int = 32) -> None:
    """Writes records for lookup by prediction: dealt to parts by the id, sorted within, with Bloom filters on it."""
    part = _part_of(F.col("prediction_id"), parts)
    dealt = records.withColumn("part", part).repartition(parts, "part").sortWithinPartitions("part", "prediction_id")
    dealt.write.option("parquet.bloom.filter.enabled#prediction_id", "true").partitionBy("part").parquet(path)


def stored_explanation(stored: DataFrame, prediction_id, parts: int = 32) -> DataFrame:
    """The explanation of one prediction from a table that ``store_explanations`` wrote: only the id's part is read."""
    wanted = F.lit(prediction_id).cast(stored.schema["prediction_id"].dataType)
    return explanation_for(stored.filter(F.col("part") == _part_of(wanted, parts)).drop("part"), wanted)


def _part_of(prediction_id: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(prediction_id), F.lit(parts)).cast("int")


def explanation_for(stored: DataFrame, prediction_id) -> DataFrame:
    """The stored explanation of one prediction; the filter reaches the scan."""
    return stored.filter(F.col("prediction_id") == prediction_id).orderBy("generated_at", "explanation_id").limit(1)
