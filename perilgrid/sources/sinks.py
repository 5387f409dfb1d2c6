"""Writes: topics, insert-if-absent, upsert, flag updates, points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.operators.skew import latest_per_key


def topic_rows(df: DataFrame, key: str, keep_nulls: bool = True) -> DataFrame:
    """(key, value): the row as JSON under its id, the shape a Kafka sink takes."""
    opts = {"ignoreNullFields": "false" if keep_nulls else "true"}
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*"), opts).alias("value"))


def publish(df: DataFrame, key: str, path: str | None = None, fmt: str = "json", **options: str) -> None:
    """Batch publish; ``fmt='kafka'`` with topic and servers as options, or files."""
    w = topic_rows(df, key).write.format(fmt).options(**options)
    w.save() if path is None else w.mode("append").save(path)


def first_per_key(new: DataFrame, stored: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Rows whose key is not stored yet, each key once: the first by ``order``.

    Without an order the row's JSON decides, so that a repeated run picks the same row.
    """
    return latest_per_key(new, [key], order or [F.to_json(F.struct("*"))]).join(stored.select(key), key, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: str, replace: list[str]) -> DataFrame:
    """The table after an upsert: a known key takes the new values of the
    ``replace`` columns and keeps the rest, an unknown one is added whole.
    ``new`` has one row per key."""
    s, n = stored.alias("s"), new.withColumn("_new", F.lit(True)).alias("n")
    cols = []
    for c in stored.columns:
        old, fresh = F.col(f"s.{c}"), F.col(f"n.{c}")
        if c == key:
            cols.append(F.coalesce(old, fresh).alias(c))
        elif c in replace:
            cols.append(F.when(F.col("n._new"), fresh).otherwise(old).alias(c))
        else:
            cols.append(F.when(F.col("_old"), old).otherwise(fresh).alias(c))
    s = stored.withColumn("_old", F.lit(True)).alias("s")
    return s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def mark_blocked(routes: DataFrame, ids: DataFrame, key: str = "route_id") -> DataFrame:
    """Routes with ``is_blocked`` set for the given ids."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return (
        routes.join(hit, key, "left")
        .withColumn("is_blocked", F.coalesce(F.col("_hit"), F.col("is_blocked")))
        .drop("_hit")
    )


def prediction_points(predictions: DataFrame) -> DataFrame:
    """Time-series points: tags, numeric fields and the time; no impact time is written as -1."""
    return predictions.select(
        "region_id", "disaster_type", "risk_level", "probability_pct", "severity_index",
        F.coalesce("time_to_impact_h", F.lit(-1.0)).alias("time_to_impact_h"),
        F.col("forecast_horizon_h").cast("double").alias("forecast_horizon_h"),
        F.col("generated_at").alias("time"),
    )


def write_points(predictions: DataFrame, path: str) -> None:
    """Append points, one folder per hazard, near rows of a region kept together."""
    points = prediction_points(predictions)
    points.sortWithinPartitions("region_id", "time").write.mode("append").partitionBy("disaster_type").parquet(path)


def append_reports(reports: DataFrame, path: str) -> None:
    from perilgrid.operators.reports import intake

    intake(reports).write.mode("append").parquet(path)
