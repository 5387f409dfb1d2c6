"""Dimension and bulk loads, and the union of feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.operators.skew import latest_per_key
from perilgrid.operators.validate import optional_filter


def read_table(
    spark: SparkSession, source: str, fmt: str = "parquet", schema: str | None = None, **options: str
) -> DataFrame:
    """A stored table; ``fmt='jdbc'`` with url and dbtable reads a database.

    ``perilgrid.schemas`` has the schema of each domain table; given one, files
    without a schema of their own need no extra pass to infer it.
    """
    reader = spark.read.format(fmt).options(**options)
    reader = reader.schema(schema) if schema else reader
    return reader.load() if fmt == "jdbc" else reader.load(source)


def historical_events(table: DataFrame, **filters) -> DataFrame:
    """Past events in order of their start."""
    return optional_filter(table, "start_date", **filters).orderBy("start_date", "event_id")


def terrain(table: DataFrame, load_order: str = "load_no") -> DataFrame:
    """One row per region; the last one loaded wins."""
    return latest_per_key(table, ["region_id"], [F.col(load_order).desc()]).drop(load_order)


def urban_drainage(table: DataFrame, load_order: str = "load_no") -> DataFrame:
    return terrain(table.filter("is_urban"), load_order)


def region_graph(table: DataFrame) -> DataFrame:
    return table.select("region_id", "neighbour_id", F.col("edge_weight").cast("double").alias("edge_weight"))


def road_nodes(table: DataFrame) -> DataFrame:
    """Nodes; one without a label is named by its id."""
    return table.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.col("node_id").cast("string")))


def road_network(edges: DataFrame) -> DataFrame:
    """Open edges, usable in both directions; one pass over the table."""
    there = F.struct(F.col("from_node"), F.col("to_node"))
    back = F.struct(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"))
    return edges.filter(~F.col("is_blocked")).select(
        "edge_id", "road_id", F.col("distance_km").cast("double").alias("distance_km"), F.inline(F.array(there, back))
    )


def region_feed(readings: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Sensor rows and forecasts in one feed; rows that name no region are dropped."""
    s = readings.withColumns({"kind": F.lit("sensor"), "event_at": F.col("reading_ts")}).drop("reading_ts")
    w = forecasts.withColumns({"kind": F.lit("weather"), "event_at": F.col("fetched_at")}).drop("fetched_at")
    return s.unionByName(w, allowMissingColumns=True).filter(F.coalesce("region_id", F.lit("")) != "")
