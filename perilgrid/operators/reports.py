"""Crowd reports: wording tests and newest-first lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tells_of_blockage(description: Column) -> Column:
    """The text speaks of a road and of it being blocked, closed or flooded."""
    d = F.lower(F.coalesce(description, F.lit("")))
    return d.contains("road") & (d.contains("block") | d.contains("closed") | d.contains("flood"))


def blockage_reports(reports: DataFrame) -> DataFrame:
    return reports.filter(tells_of_blockage(F.col("description")))


def latest_reports(reports: DataFrame, n: int = 200) -> DataFrame:
    return reports.orderBy(F.col("reported_at").desc(), F.col("report_id").desc()).limit(n)


def intake(reports: DataFrame) -> DataFrame:
    """New reports wait for review."""
    return reports.withColumn("validation_status", F.lit("pending"))
