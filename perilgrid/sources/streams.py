"""JSON feeds.  Each parser takes rows with a string ``value`` column, from a
batch or a stream, so Kafka, files and memory sources look the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid import schemas
from perilgrid.operators.validate import SENSOR_REQUIRED, first_missing


def open_stream(spark: SparkSession, source: str, fmt: str = "text", **options: str) -> DataFrame:
    """A stream of ``value`` strings.  ``fmt='kafka'`` needs the connector jar and
    takes subscribe and kafka.bootstrap.servers as options."""
    reader = spark.readStream.format(fmt).options(**options)
    raw = reader.load() if fmt == "kafka" else reader.load(source)
    return raw.select(F.col("value").cast("string").alias("value"))


def _parsed(raw: DataFrame, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Typed fields; ``_corrupt`` holds the text of rows that are no such JSON."""
    j = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return raw.select(*extra, "value", j.alias("_j")).select(*extra, "value", "_j.*")


def _time_or(text: str, fallback: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(F.nullif(text, F.lit(""))), fallback)


def sensor_rows(raw: DataFrame, fill_time: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed readings with ``reject_field``: ``json`` for unreadable text or a
    value of the wrong type, else the first required field that is missing.

    ``fill_time`` stamps readings without a time, as is right at intake; a check
    further on turns it off and rejects them.  ``keep`` names columns beside
    ``value`` to carry along.
    """
    df = _parsed(raw, schemas.SENSOR_JSON, keep)
    when = _time_or("timestamp", F.current_timestamp()) if fill_time else _time_or("timestamp", F.lit(None))
    df = df.withColumn("reading_ts", when).drop("timestamp")
    bad = F.col("_corrupt").isNotNull() | F.col("value").isNull()
    return df.withColumn("reject_field", F.when(bad, "json").otherwise(first_missing(SENSOR_REQUIRED))).drop("_corrupt")


def weather_rows(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed forecasts; unreadable text is dropped, a missing fetch time is filled."""
    df = _parsed(raw, schemas.WEATHER_JSON, keep).filter("_corrupt is null and value is not null")
    return df.withColumn("fetched_at", _time_or("fetched_at", F.current_timestamp())).drop("_corrupt", "value")


def satellite_rows(raw: DataFrame, provider: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed image metadata, stamped with the provider and an ``ok`` feed status."""
    df = _parsed(raw, schemas.SATELLITE_JSON, keep).filter("_corrupt is null and value is not null")
    return df.withColumns(
        {
            "provider": F.lit(provider),
            "feed_status": F.lit("ok"),
            "captured_at": F.try_to_timestamp("captured_at"),
            "received_at": _time_or("received_at", F.current_timestamp()),
        }
    ).drop("_corrupt", "value")


def gov_records(payloads: DataFrame, feed: Column, fetched: Column | None = None) -> DataFrame:
    """Records of payloads that hold an array of records or a single one.

    A blank source takes the feed's name and a blank fetch time the time of the
    fetch; payloads that are neither form give no rows.
    """
    stamp = F.date_format(fetched if fetched is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rec = f"struct<{', '.join(f.strip().replace(' ', ':') for f in schemas.GOV_JSON.split(','))}>"
    is_list = F.ltrim("payload").startswith("[")
    many = F.when(is_list, F.from_json("payload", f"array<{rec}>")).otherwise(F.array(F.from_json("payload", rec)))
    rows = payloads.withColumns({"_feed": feed, "_at": stamp}).withColumn("_r", F.explode(many)).filter("_r is not null")
    return rows.select(
        *[c for c in payloads.columns if c != "payload"],
        "_r.record_id", "_r.region_id", "_r.data_type", F.col("_r.payload").alias("record_payload"),
        F.coalesce(F.nullif(F.col("_r.fetched_at"), F.lit("")), F.col("_at")).alias("fetched_at"),
        F.coalesce(F.nullif(F.col("_r.source"), F.lit("")), F.col("_feed")).alias("source"),
    )
