"""From region vectors to prediction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import constants as K
from perilgrid.functions.columns import clamp, dot, lookup, stable_id


def ensemble_score(vectors: DataFrame, weights: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Adds ``raw_pct``, the sigmoid of the weighted vector-and-context score, in percent."""
    table = {**K.ENSEMBLE_WEIGHTS, **(weights or {})}
    for hazard, (a, b) in table.items():
        if abs(a + b - 1.0) > 1e-6:
            raise ValueError(f"weights for '{hazard}' must sum to 1, got {a + b}")
    own = lookup("disaster_type", {h: w[0] for h, w in table.items()}, 0.5)
    shared = lookup("disaster_type", {h: w[1] for h, w in table.items()}, 0.5)
    raw = own * (dot("vec", K.SCORE_VECTOR)) + shared * (dot("context", K.SCORE_VECTOR))
    return vectors.withColumn("raw_pct", F.lit(100.0) / (F.lit(1.0) + F.exp(-raw)))


def fan_out_horizons(scored: DataFrame, horizons: tuple[int, ...] = tuple(K.HORIZON_DISCOUNT)) -> DataFrame:
    """One row per horizon, with the horizon's discount applied to the probability."""
    df = scored.withColumn("forecast_horizon_h", F.explode(F.array(*[F.lit(h) for h in horizons])))
    df = df.withColumn("discount", lookup("forecast_horizon_h", K.HORIZON_DISCOUNT, 1.0))
    return df.withColumn("probability_pct", clamp(F.col("raw_pct") * F.col("discount"), 0.0, 100.0))


def risk_class(p: Column) -> Column:
    return F.when(p >= K.HIGH_AT, "High").when(p >= K.MEDIUM_AT, "Medium").otherwise("Low")


def time_to_impact(p: Column, horizon: Column) -> Column:
    """Null for Low risk, otherwise sooner the higher the probability."""
    share = F.lit(1.0) - (p - K.MEDIUM_AT) / F.lit(100.0 - K.MEDIUM_AT)
    return F.when(p >= K.MEDIUM_AT, clamp(share * horizon, 0.0, horizon.cast("double")))


def severity(p: Column, discount: Column) -> Column:
    """The discount enters again here, on top of its effect on the probability."""
    return clamp(p * F.lit(0.9) * discount, 0.0, 100.0)


def judge(fanned: DataFrame) -> DataFrame:
    p = F.col("probability_pct")
    return fanned.withColumns(
        {
            "risk_level": risk_class(p),
            "time_to_impact_h": time_to_impact(p, F.col("forecast_horizon_h")),
            "severity_index": severity(p, F.col("discount")),
        }
    )


def prediction_records(judged: DataFrame, cycle_at: Column, model_version: str = K.MODEL_VERSION) -> DataFrame:
    """Full records; ids come from the business key, so a repeated cycle repeats them."""
    at = F.date_format(cycle_at, "yyyy-MM-dd HH:mm:ss")
    return judged.select(
        stable_id("region_id", "disaster_type", F.col("forecast_horizon_h").cast("string"), at).alias("prediction_id"),
        "region_id", "disaster_type", "forecast_horizon_h", "risk_level", "probability_pct", "time_to_impact_h",
        "severity_index", cycle_at.alias("generated_at"), F.lit(model_version).alias("model_version"),
        stable_id("region_id", at).alias("input_data_snapshot_id"),
    )
