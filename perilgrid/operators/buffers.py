"""Per-region buffers, trailing windows and debouncing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilgrid.functions import constants as K
from perilgrid.functions.columns import epoch_micros
from perilgrid.operators.skew import latest_per_key, trailing_count


def last_readings(
    readings: DataFrame, n: int = K.BUFFER_SIZE, as_of: Column | None = None, ts: str = "reading_ts", tie: str = "reading_id"
) -> DataFrame:
    """The newest ``n`` readings of each region; ``recency`` is 1 for the newest."""
    if as_of is not None:
        readings = readings.filter(F.col(ts) <= as_of)
    return latest_per_key(readings, ["region_id"], [F.col(ts).desc(), F.col(tie).desc()], n, "recency")


def latest_features(cnn: DataFrame) -> DataFrame:
    return latest_per_key(cnn, ["region_id"], [F.col("extracted_at").desc(), F.col("image_id").desc()])


def satellite_switch(cnn: DataFrame, silences: DataFrame) -> DataFrame:
    """One row: whether image features may be used at all.

    A silence turns them off for every region; any feature row at or after it
    turns them on again.  With no silence on record they are on.
    """
    seen = cnn.agg(F.max("extracted_at").alias("last_feature"))
    quiet = silences.agg(F.max("unavailable_since").alias("last_silence"))
    return seen.withColumn("last_silence", quiet.scalar()).withColumn(
        "available", F.coalesce(F.col("last_feature") >= F.col("last_silence"), F.col("last_silence").isNull())
    )


def report_bursts(
    reports: DataFrame, threshold: int = K.REPORT_THRESHOLD, seconds: int = K.REPORT_WINDOW_SECONDS
) -> DataFrame:
    """A row for every report that brings its region and type to the threshold
    within the trailing hour, and for each one after it."""
    keys = ["region_id", "disaster_type"]
    placed = reports.filter(F.col("region_id").isNotNull())
    burst = trailing_count(placed, keys, "reported_at", seconds).filter(F.col("trailing") >= threshold)
    return (
        placed.withColumn("at_micros", epoch_micros(F.col("reported_at")))
        .join(burst, [*keys, "at_micros"])
        .select("report_id", *keys, "reported_at", F.col("trailing").alias("report_count"))
    )


def silences(provider_changes: DataFrame) -> DataFrame:
    """``unavailable_since`` of the silence events among the changes of providers' status, as the switch takes them."""
    return provider_changes.filter("status = 'unavailable'").select(F.col("changed_at").alias("unavailable_since"))


def arrival_fate(
    rows: DataFrame, key: str, id_col: str, ts: str, arrived: str, lateness_s: int = K.LATENESS_SECONDS, slice_seconds: int = 3600
) -> DataFrame:
    """Every row with its ``fate``: ``kept``, ``late`` or ``repeated``.

    A row is late if its time is more than ``lateness_s`` before the greatest time that
    its feed (``key``) had shown when it arrived, by ``arrived``, then time, then id.  It is
    repeated if a row of the feed with the same id and time has been kept before.
    A row without a time is never late.  The greatest time is carried along per slice
    of arrival, so the one window over a whole feed is bounded by time.
    """
    order = [F.col(c).asc_nulls_first() for c in ("_arrived", "_at", "_name")]
    wide = rows.withColumns({
        "_arrived": epoch_micros(F.col(arrived)),
        "_at": epoch_micros(F.col(ts)),
        "_name": F.col(id_col).cast("string"),
        "_key": F.coalesce(F.col(key).cast("string"), F.lit("\0")),
    }).withColumn("_slice", F.coalesce(F.floor(F.col("_arrived") / (slice_seconds * 1000000)), F.lit(-(2**62))))
    ends = wide.groupBy("_key", "_slice").agg(F.max("_at").alias("_top"))
    upto = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.max("_top").over(upto)).drop("_top")
    inside = Window.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    clock = F.greatest(F.max("_at").over(inside), F.col("_before"))
    timed = wide.join(ends, ["_key", "_slice"]).withColumn("_late", F.coalesce(F.col("_at") < clock - lateness_s * 1000000, F.lit(False)))
    place = F.row_number().over(Window.partitionBy("_key", "_name", "_at", "_late").orderBy(*order))
    fate = F.when(F.col("_late"), "late").when(place > 1, "repeated").otherwise("kept")
    return timed.withColumn("fate", fate).select(*rows.columns, "fate")


def blockage_sessions(reports: DataFrame, gap_seconds: int = 600) -> DataFrame:
    """Quiet-period debounce per region: each report moves the deadline, the
    recompute falls ``gap_seconds`` after the last one.

    Reports are first folded into slices of a minute, or of the gap if that is
    shorter.  Reports of one slice always share a session, so the rows left per
    region are bounded by time, not by the number of reports.
    """
    if gap_seconds <= 0:
        raise ValueError("the gap must be positive")
    width = int(min(60, gap_seconds) * 1000000)
    at = epoch_micros(F.col("reported_at"))
    slices = (
        reports.filter(F.col("region_id").isNotNull())
        .groupBy("region_id", F.floor(at / width).alias("slice"))
        .agg(F.min("reported_at").alias("first_at"), F.max("reported_at").alias("last_at"), F.count(F.lit(1)).alias("n"))
    )
    by_region = Window.partitionBy("region_id").orderBy("slice")
    gap = epoch_micros(F.col("first_at")) - epoch_micros(F.lag("last_at").over(by_region))
    opened = F.when(gap < gap_seconds * 1000000, 0).otherwise(1)
    return (
        slices.withColumn("opened", opened)
        .withColumn("session", F.sum("opened").over(by_region))
        .groupBy("region_id", "session")
        .agg(F.min("first_at").alias("first_report"), F.max("last_at").alias("last_report"), F.sum("n").alias("n_reports"))
        .withColumn("recompute_at", F.col("last_report") + F.make_dt_interval(secs=F.lit(gap_seconds)))
        .drop("session")
    )
