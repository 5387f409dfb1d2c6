"""Streaming forms of the operators.

Sessions, de-duplication and watermarks use what Structured Streaming offers, and state
with timers is in ``keyed``.  What others read is a table kept from ``foreachBatch``: a batch
reads and writes only the parts that it touches, and gives the same result if it
runs again.  ``run`` names the checkpoint to the tables, as each counts batches anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from perilgrid.functions import constants as K
from perilgrid.operators import board, buffers, reports, validate
from perilgrid.operators.skew import latest_per_key
from perilgrid.plans.cycle import prediction_cycle
from perilgrid.sources import sinks, streams
from perilgrid.streaming.parts import HourLog, KeyLog, PartTable

LATENESS = "2 hours"

READING = (
    "reading_id bigint, sensor_id string, region_id string, reading_ts timestamp, rainfall_mm double, temperature_c double, "
    "river_level_m double, soil_moisture_pct double, wind_speed_kmh double, wind_direction_deg double, stream_status string"
)
REPORT = "report_id bigint, region_id string, disaster_type string, description string, reported_at timestamp"
BOARD = (
    "region_id string, disaster_type string, prediction_id string, forecast_horizon_h int, risk_level string, "
    "probability_pct double, time_to_impact_h double, severity_index double, generated_at timestamp"
)


# --- stateless ----------------------------------------------------------------


def validated_stream(raw: DataFrame) -> DataFrame:
    """Raw JSON readings to the validated feed, each with an id made of its sensor and time."""
    rows = validate.flag_anomalous(streams.sensor_rows(raw, fill_time=False).filter("reject_field is null"))
    return (
        rows.filter("not is_anomalous")
        .drop("reject_field", "value")
        .withColumn("reading_id", F.xxhash64("sensor_id", F.unix_micros(F.col("reading_ts").cast("timestamp"))))
    )


def publish_stream(df: DataFrame, key: str, fmt: str = "json", **options: str) -> DataStreamWriter:
    """Key and JSON value to a topic (``fmt='kafka'``) or to files."""
    return sinks.topic_rows(df, key).writeStream.format(fmt).options(**options).outputMode("append")


def report_intake_stream(reports_in: DataFrame, key: str = "report_id", lateness: str = LATENESS) -> DataFrame:
    """New crowd reports, each id once within the lateness bound, waiting for review."""
    once = reports_in.withWatermark("reported_at", lateness).dropDuplicatesWithinWatermark([key])
    return reports.intake(once)


# --- sessions -------------------------------------------------------------------


def blockage_session_stream(reports_in: DataFrame, gap: str = K.DEBOUNCE, lateness: str = LATENESS) -> DataFrame:
    """Closed quiet periods per region; a row appears once the watermark has passed its end.

    Set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    to merge reports of a busy region before the shuffle.
    """
    s = F.session_window("reported_at", gap)
    return (
        reports.blockage_reports(reports_in)
        .withWatermark("reported_at", lateness)
        .groupBy(s.alias("s"), "region_id")
        .agg(F.max("reported_at").alias("last_report"), F.count(F.lit(1)).alias("n_reports"))
        .select("region_id", F.col("s.start").alias("first_report"), "last_report", "n_reports", F.col("s.end").alias("recompute_at"))
    )


# --- maintained tables ------------------------------------------------------------


def cycle_step(
    table: PartTable, predictions: KeyLog, adjacency: DataFrame, clock: Column | None = None, run: str = ""
) -> Callable[[DataFrame, int], None]:
    """For ``keyed.last_readings_stream``: stores the buffers that changed, then runs a cycle over every region with data.

    Start it with ``trigger(processingTime='1 hour')``.  ``clock`` is the cycle
    time; without one it is the newest reading's.
    """

    def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select("region_id").distinct(), "region_id", "left_anti").unionByName(new)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = table.read(spark)
        table.update(batch.select(stored.columns), replaced, batch_id, run)
        rows = table.read(spark)
        at = clock if clock is not None else rows.agg(F.max("reading_ts").alias("t")).scalar()
        new = prediction_cycle(rows, adjacency, at)
        predictions.insert(new, lambda df: df.dropDuplicates(["prediction_id"]), batch_id, run)

    return step


def insert_step(table: KeyLog, order: list[Column] | None = None, run: str = "") -> Callable[[DataFrame, int], None]:
    """Insert-if-absent by primary key; ``order`` picks among the rows of one batch."""

    def first(batch: DataFrame) -> DataFrame:
        # without an order the row's JSON decides, so that a repeated run picks the same row
        return latest_per_key(batch, [table.key], order or [F.to_json(F.struct("*"))])

    return lambda batch, batch_id: table.insert(batch, first, batch_id, run)


def upsert_step(table: PartTable, replace: list[str], order: list[Column], run: str = "") -> Callable[[DataFrame, int], None]:
    """Upsert by key; the first row by ``order`` speaks for a key within one batch."""
    key = table.key[0]

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return sinks.upsert(old, latest_per_key(new.select(old.columns), [key], order), key, replace)

    return lambda batch, batch_id: table.update(batch, merge, batch_id, run)


def board_step(table: PartTable, run: str = "") -> Callable[[DataFrame, int], None]:
    """Live board: the newest prediction per region and hazard, refreshed where the batch touches it."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        new = new.select(old.columns)
        regions = new.select("region_id").distinct()
        touched = old.join(regions, "region_id", "left_semi")
        kept = old.join(regions, "region_id", "left_anti")
        return kept.unionByName(board.latest_by_type(touched.unionByName(new)))

    return lambda batch, batch_id: table.update(batch, merge, batch_id, run)


def burst_step(stored: HourLog, out: HourLog, seconds: int = K.REPORT_WINDOW_SECONDS, run: str = "") -> Callable[[DataFrame, int], None]:
    """Exact trailing counts as reports arrive.

    Counts look at the batch and at stored reports of the hours that its windows reach
    back to; only this batch's reports are put out.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        new = batch.select("report_id", "region_id", "disaster_type", "description", "reported_at")
        since, until = new.agg(F.min("reported_at") - F.make_dt_interval(secs=F.lit(seconds)), F.max("reported_at")).first()
        recent = stored.between(batch.sparkSession, since, until, batch_id, run)
        hits = buffers.report_bursts(recent.unionByName(new), seconds=seconds)
        out.append(hits.join(new.select("report_id"), "report_id", "left_semi"), batch_id, run)
        stored.append(new, batch_id, run)

    return step


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger) -> DataStreamWriter:
    """A writer for maintained tables; ``availableNow=True`` works off what is there."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode(mode)
    return writer.trigger(**trigger) if trigger else writer
