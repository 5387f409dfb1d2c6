"""The prediction cycle: readings in, fifteen records per region out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import constants as K
from perilgrid.operators import features as fe
from perilgrid.operators import predict as pr
from perilgrid.operators.buffers import last_readings
from perilgrid.operators.validate import validated


def scored_hazards(
    ema: DataFrame,
    adjacency: DataFrame,
    temperature: float = 1.0,
    degraded: bool = False,
    routed_only: bool = True,
    weights: dict[str, tuple[float, float]] | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """(region_id, disaster_type, raw_pct) from the smoothed sensor fields.

    Every region contributes its flood vector to the shared context and to the
    graph, as one snapshot.  ``by`` names columns that tell several snapshots apart.
    What moves between regions are the fields of the vectors, not their projections.
    """
    flood_fields = fe.ROUTED_SENSOR_FIELDS["flood"] if routed_only else K.SENSOR_FIELDS
    flood = fe.region_parts(ema, flood_fields, by)
    graph = fe.propagate(flood, adjacency, degraded=degraded, by=by, weights=fe.seen_by(flood_fields, K.GRAPH_VECTOR))
    blended = fe.blend_spatial(fe.hazard_vectors(ema, routed_only, by), fe.projected(graph, flood_fields), by)
    return pr.ensemble_score(fe.with_context(blended, temperature, flood, by, flood_fields), weights)


def prediction_cycle(
    readings: DataFrame,
    adjacency: DataFrame,
    cycle_at: Column,
    forecasts: DataFrame | None = None,
    buffer_size: int = K.BUFFER_SIZE,
    alpha: float = K.SMOOTHING,
    **options,
) -> DataFrame:
    """Five hazards by three horizons for every region with valid readings up to ``cycle_at``.

    ``forecasts`` (region_id, fetched_at) take places in the buffers as rows
    without sensor values, as they do where both feeds share a topic; leave
    them out to score readings only.
    """
    rows = validated(readings).select("region_id", "reading_id", "reading_ts", *K.SENSOR_FIELDS)
    if forecasts is not None:
        blank = forecasts.filter(F.coalesce("region_id", F.lit("")) != "").select(
            "region_id", F.lit(None).cast("bigint").alias("reading_id"), F.col("fetched_at").alias("reading_ts")
        )
        rows = rows.unionByName(blank, allowMissingColumns=True)
    buffer = last_readings(rows, buffer_size, cycle_at)
    # One small row per region.  The shuffle after it is what the context, the
    # graph rounds and the hazards all reuse, so the buffer is built only once.
    ema = fe.smooth(buffer, alpha).repartition("region_id")
    scored = scored_hazards(ema, adjacency, **options)
    return pr.prediction_records(pr.judge(pr.fan_out_horizons(scored)), cycle_at)
