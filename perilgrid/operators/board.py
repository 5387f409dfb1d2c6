"""Read-side questions over stored predictions, outcomes and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions.columns import risk_colour, risk_rank
from perilgrid.operators.skew import latest_per_key
from perilgrid.operators.validate import optional_filter


def newest_first() -> list[Column]:
    """Newest prediction first; one cycle's rows are told apart by horizon, then id."""
    return [F.col("generated_at").desc(), F.col("forecast_horizon_h"), F.col("prediction_id")]


def latest_by_type(predictions: DataFrame) -> DataFrame:
    return latest_per_key(predictions, ["region_id", "disaster_type"], newest_first())


def _highest(latest: DataFrame, key: str) -> DataFrame:
    order = [risk_rank(F.col("risk_level")).desc(), F.col("generated_at").desc(), F.col("disaster_type")]
    return latest_per_key(latest, [key], order)


def region_board(predictions: DataFrame, disaster_type: str | None = None) -> DataFrame:
    """Highest current risk of each region with its colour."""
    rows = optional_filter(predictions, "generated_at", disaster_type=disaster_type)
    return _highest(latest_by_type(rows), "region_id").select(
        "region_id", "risk_level", risk_colour(F.col("risk_level")).alias("color"),
        F.col("generated_at").alias("last_prediction_at"),
    )


_DETAIL = ["disaster_type", "risk_level", "probability_pct", "time_to_impact_h", "severity_index", "generated_at"]


def region_detail(predictions: DataFrame, region_id: str | None = None) -> DataFrame:
    """Newest prediction per hazard; an unknown region gives no rows."""
    rows = optional_filter(predictions, "generated_at", region_id=region_id)
    return latest_by_type(rows).select("region_id", *_DETAIL)


def region_detail_nested(predictions: DataFrame, region_id: str | None = None) -> DataFrame:
    """The same as one row per region; at most one entry per hazard goes into the list."""
    per = region_detail(predictions, region_id)
    return per.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct(*_DETAIL))).alias("disaster_types"))


def recent_predictions(predictions: DataFrame, n: int = 500, **filters) -> DataFrame:
    rows = optional_filter(predictions, "generated_at", **filters)
    return rows.orderBy(F.col("generated_at").desc(), F.col("prediction_id").desc()).limit(n)


def event_timeline(events: DataFrame, n: int = 500, **filters) -> DataFrame:
    rows = optional_filter(events, "start_date", **filters)
    return rows.orderBy(F.col("start_date").desc(), F.col("event_id").desc()).limit(n)


def predicted_vs_actual(predictions: DataFrame, outcomes: DataFrame, n: int = 500, **filters) -> DataFrame:
    """Newest outcomes next to what was predicted.

    The first ``n`` rows belong to the newest ``n`` predictions that have an outcome, so
    these few are found first and only their outcomes are put in order.
    """
    left = optional_filter(predictions, "generated_at", **filters).select(
        "prediction_id", "region_id", "disaster_type", "forecast_horizon_h",
        F.col("risk_level").alias("predicted_risk_level"),
        F.col("probability_pct").alias("predicted_probability_pct"), "generated_at",
    )
    newest = [F.col("generated_at").desc(), F.col("prediction_id").desc()]
    within = [F.col("outcome_no"), F.col("actual_severity"), F.col("actual_occurred")]
    seen = outcomes.select("prediction_id", "outcome_no", "actual_occurred", "actual_severity")
    few = left.join(seen.select("prediction_id"), "prediction_id", "left_semi").orderBy(*newest).limit(n)
    # ``n`` rows at most
    return seen.join(F.broadcast(few), "prediction_id").select(*few.columns, *seen.columns[1:]).orderBy(*newest, *within).limit(n)


def accuracy(predictions: DataFrame, outcomes: DataFrame, **filters) -> DataFrame:
    """Confusion counts and ratios per hazard.

    Outcomes are counted per prediction before the join.  That leaves one row
    per prediction on each side, so a prediction with very many outcomes is no
    hot key, and the join reuses the aggregate's partitioning.
    """
    tally = outcomes.groupBy("prediction_id").agg(
        F.count_if(F.col("actual_occurred")).alias("hit"),
        F.count_if(~F.col("actual_occurred")).alias("miss"),
        F.count(F.lit(1)).alias("n"),
    )
    rows = optional_filter(predictions, "generated_at", **filters).select(
        "prediction_id", "disaster_type", "risk_level", "generated_at"
    )
    warned = F.col("risk_level").isin("Medium", "High")
    quiet = F.col("risk_level").isNotNull() & ~warned
    grouped = (
        rows.join(tally, "prediction_id")
        .groupBy("disaster_type")
        .agg(
            F.coalesce(F.sum(F.when(warned, F.col("hit"))), F.lit(0)).alias("true_positives"),
            F.coalesce(F.sum(F.when(warned, F.col("miss"))), F.lit(0)).alias("false_positives"),
            F.coalesce(F.sum(F.when(quiet, F.col("hit"))), F.lit(0)).alias("false_negatives"),
            F.coalesce(F.sum(F.when(quiet, F.col("miss"))), F.lit(0)).alias("true_negatives"),
            F.sum("n").alias("total_predictions"),
            F.min("generated_at").alias("from_date"),
            F.max("generated_at").alias("to_date"),
        )
    )
    tp, fp, fn, tn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives", "true_negatives"))
    return grouped.withColumns(
        {
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "false_alarm_rate": F.try_divide(fp, fp + tn),
        }
    )


def seasonal_pattern(events: DataFrame, region_id: str | None = None, disaster_type: str | None = None, years: float = 2.0) -> DataFrame:
    """Events per hazard and month, for regions whose record spans at least two years.

    Both the span and the counts come from one aggregate by region, hazard and
    month; the gate is a window over those few rows.
    """
    rows = optional_filter(events, "start_date", region_id=region_id, disaster_type=disaster_type)
    monthly = rows.groupBy("region_id", "disaster_type", F.month("start_date").alias("month")).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("start_date").alias("lo"), F.max("start_date").alias("hi")
    )
    from pyspark.sql import Window

    region = Window.partitionBy("region_id")
    span = F.datediff(F.max("hi").over(region), F.min("lo").over(region)) / F.lit(365.25)
    return monthly.withColumn("span_years", span).filter(F.col("span_years") >= years).select(
        "region_id", "disaster_type", "month", "n_events"
    )


def known_regions(predictions: DataFrame) -> DataFrame:
    return predictions.select("region_id").distinct()


def prone_villages(
    villages: DataFrame, districts: DataFrame, district_id: str | None = None,
    region_id: str | None = None, disaster_type: str | None = None,
) -> DataFrame:
    """Villages with a record of disasters, worst first; a district's region may be unknown."""
    v = villages
    if district_id:
        v = v.filter(F.col("district_id") == district_id)
    if disaster_type:
        v = v.filter(F.array_contains("disaster_types", disaster_type))
    out = v.join(districts.select("district_id", "region_id"), "district_id", "left")
    if region_id:
        out = out.filter(F.col("region_id") == region_id)
    return out.select(
        "village_id", "village_name", "district_id", "region_id", "lat", "lon", "disaster_types",
        F.col("incidents").alias("historical_incidents"), "last_event",
        F.least(F.lit(100), F.col("incidents") * 5).alias("risk_score"),
    ).orderBy(F.col("historical_incidents").desc(), "village_id")


def district_board(predictions: DataFrame, districts: DataFrame, region_id: str | None = None, disaster_type: str | None = None) -> DataFrame:
    """Top risk per district with colour and position; districts without predictions are left out."""
    rows = optional_filter(predictions, "generated_at", region_id=region_id, disaster_type=disaster_type)
    order = [risk_rank(F.col("risk_level")).desc(), *newest_first()]
    top = latest_per_key(rows, ["region_id"], order).select("region_id", "risk_level", "generated_at")
    return districts.join(top, "region_id").select(
        "district_id", "name", "region_id", "lat", "lon", "risk_level",
        risk_colour(F.col("risk_level")).alias("color"), F.col("generated_at").alias("last_prediction_at"),
    )


def detail_with_sensor(predictions: DataFrame, districts: DataFrame, readings: DataFrame, horizon: int = 6) -> DataFrame:
    """Newest prediction per district and hazard at one horizon, beside the newest sensor row."""
    rows = latest_by_type(predictions.filter(F.col("forecast_horizon_h") == horizon))
    sensor = latest_reading(readings).select("region_id", "reading_id", "rainfall_mm", "temperature_c")
    return districts.select("district_id", "name", "region_id").join(
        rows.select("region_id", *_DETAIL), "region_id"
    ).join(sensor, "region_id", "left")


def latest_reading(readings: DataFrame) -> DataFrame:
    return latest_per_key(readings, ["region_id"], [F.col("reading_ts").desc(), F.col("reading_id").desc()])


def newest_alerts(dispatches: DataFrame, n: int = 50) -> DataFrame:
    return dispatches.orderBy(F.col("dispatched_at").desc(), F.col("prediction_id").desc()).limit(n)
