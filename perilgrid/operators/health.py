"""Feed silence and service targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import constants as K
from perilgrid.functions.columns import epoch_micros, seconds_between
from perilgrid.operators.skew import sliced_lag
from perilgrid.operators.validate import alertable


def silence_status(gap_seconds: Column) -> Column:
    return (
        F.when(gap_seconds >= K.UNAVAILABLE_MINUTES * 60, "unavailable")
        .when(gap_seconds >= K.DEGRADED_MINUTES * 60, "degraded")
        .otherwise("ok")
    )


def feed_gaps(readings: DataFrame, ts: str = "reading_ts", tie: str = "reading_id") -> DataFrame:
    """Each reading with the status its sensor had reached just before it arrived."""
    gap = (F.col("at_micros") - F.col("prev_micros")) / F.lit(1000000.0)
    return (
        sliced_lag(readings, ["sensor_id"], ts, tie)
        .withColumn("gap_s", gap)
        .withColumn("status_before", silence_status(F.coalesce("gap_s", F.lit(0.0))))
        .drop("at_micros", "prev_micros")
    )


def feed_status(readings: DataFrame, at: Column, ts: str = "reading_ts") -> DataFrame:
    """Status of each sensor as seen at one moment."""
    last = readings.groupBy("sensor_id").agg(F.max(ts).alias("last_received"))
    return last.withColumn("status", silence_status(seconds_between(F.col("last_received"), at)))


def feed_changes(
    readings: DataFrame, until: Column, key: str = "sensor_id", ts: str = "reading_ts", levels: tuple[tuple[int, str], ...] = K.FEED_LEVELS
) -> DataFrame:
    """``key``, ``since``, ``status``, ``changed_at``: each change of a feed's status up to ``until``.

    A feed reaches a level of silence when its last row is that many seconds old, and is
    ``ok`` again with the next row.  Rows without a key or a time, and later ones, do not count.
    """
    kind = readings.schema[ts].dataType
    heard = readings.filter(F.col(key).isNotNull() & (F.col(ts) <= until)).select(key, ts)
    pairs = sliced_lag(heard, [key], ts, ts).select(key, F.col("prev_micros").alias("since"), F.col("at_micros").alias("next"))
    ends = heard.groupBy(key).agg(F.max(epoch_micros(F.col(ts))).alias("since")).withColumn("next", F.lit(None).cast("bigint"))
    limit = F.coalesce("next", epoch_micros(until))
    reached = [F.when(F.col("since") + s * 1000000 <= limit, F.struct(F.lit(status).alias("status"), (F.col("since") + s * 1000000).alias("at"))) for s, status in levels]
    again = F.when(F.col("next") - F.col("since") >= levels[0][0] * 1000000, F.struct(F.lit("ok").alias("status"), F.col("next").alias("at")))
    changes = pairs.filter("since is not null").union(ends).select(key, "since", F.explode(F.array_compact(F.array(*reached, again))).alias("c"))
    moment = lambda c: F.timestamp_micros(c).cast(kind)
    return changes.select(key, moment(F.col("since")).alias("since"), "c.status", moment(F.col("c.at")).alias("changed_at"))


def satellite_silence(images: DataFrame, at: Column) -> DataFrame:
    """Providers silent for two hours or more; one never seen gives no row."""
    last = images.filter(F.col("provider").isNotNull()).groupBy("provider").agg(F.max("received_at").alias("unavailable_since"))
    return last.filter(seconds_between(F.col("unavailable_since"), at) >= K.SATELLITE_SILENCE_HOURS * 3600)


def mark_alert_sla(dispatches: DataFrame) -> DataFrame:
    limit = F.when(F.col("risk_level") == "High", K.SLA_SECONDS["High"]).otherwise(K.SLA_SECONDS["other"])
    took = seconds_between(F.col("generated_at"), F.col("dispatched_at"))
    return dispatches.withColumns({"elapsed_s": took, "sla_s": limit}).withColumn(
        "sla_breached", F.col("elapsed_s") > F.col("sla_s")
    )


def alert_sla_by_risk(dispatches: DataFrame) -> DataFrame:
    return mark_alert_sla(dispatches).groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.count_if("sla_breached").alias("n_breached"),
        (F.count_if("sla_breached") / F.count(F.lit(1))).alias("breach_rate"),
    )


def mark_image_sla(images: DataFrame, at: str = "processed_at") -> DataFrame:
    took = seconds_between(F.col("received_at"), F.col(at))
    return images.withColumn("elapsed_s", took).withColumn("sla_breached", F.col("elapsed_s") > K.IMAGE_SLA_SECONDS)


def dispatch_outcomes(predictions: DataFrame, dispatches: DataFrame) -> DataFrame:
    """Each prediction that calls for an alert with the dispatch that came in time, or as a breach if none did.

    The same for tables and streams; on streams both sides need a watermark (on
    ``generated_at`` and ``dispatched_at``), and a breach appears once the watermark has
    passed its deadline.  Several dispatches in time give a row each.
    """
    latest = max(K.SLA_SECONDS.values())
    due = alertable(predictions).select("prediction_id", "risk_level", "generated_at")
    due = due.withColumn("sla_s", F.when(F.col("risk_level") == "High", K.SLA_SECONDS["High"]).otherwise(K.SLA_SECONDS["other"]))
    sent = dispatches.select(F.col("prediction_id").alias("_of"), "dispatched_at")
    in_time = (
        (F.col("prediction_id") == F.col("_of"))
        & (F.col("dispatched_at") >= F.col("generated_at"))
        & (F.col("dispatched_at") <= F.col("generated_at") + F.expr(f"interval {latest} seconds"))
        & (seconds_between(F.col("generated_at"), F.col("dispatched_at")) <= F.col("sla_s"))
    )
    return due.join(sent, in_time, "left_outer").drop("_of").withColumn("sla_breached", F.col("dispatched_at").isNull())


def dispatch_outcomes_by_risk(outcomes: DataFrame) -> DataFrame:
    each = outcomes.groupBy("prediction_id", "risk_level").agg(F.min("sla_breached").alias("sla_breached"))
    return each.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.count_if("sla_breached").alias("n_breached"),
        (F.count_if("sla_breached") / F.count(F.lit(1))).alias("breach_rate"),
    )
