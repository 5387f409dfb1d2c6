"""All prediction cycles of a stretch of time in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilgrid.functions import constants as K
from perilgrid.functions.columns import epoch_micros, zero
from perilgrid.operators import predict as pr
from perilgrid.operators.skew import latest_per_key
from perilgrid.operators.validate import validated
from perilgrid.plans.cycle import scored_hazards


def newest_of_cycles(readings: DataFrame, step_s: int = 3600, size: int = K.BUFFER_SIZE) -> DataFrame:
    """``region_id``, ``slot``, ``newest``: the region's newest ``size`` readings, newest first, as of each cycle that brought one.

    Cycle ``slot`` runs ``slot * step_s`` seconds after the epoch and sees all readings up to that
    moment.  The newest readings of a region lie in its last ``size`` slots that are not
    empty, and of each slot no more than ``size`` count.  So what is merged per region
    is bounded by time, however many readings there are.
    """
    slot = F.ceil(epoch_micros(F.col("reading_ts")) / F.lit(step_s * 1000000))
    rows = readings.filter("reading_ts is not null").withColumn("slot", slot.cast("bigint"))
    order = [F.col("reading_ts").desc(), F.col("reading_id").desc()]
    few = latest_per_key(rows, ["region_id", "slot"], order, size, "place")
    entry = F.struct("place", F.array(*[zero(f) for f in K.SENSOR_FIELDS]).alias("values"))
    slots = few.groupBy("region_id", "slot").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["values"]).alias("own"))
    back = Window.partitionBy("region_id").orderBy(F.col("slot"))
    merged = F.collect_list("own").over(back.rowsBetween(-(size - 1), 0))
    newest = F.slice(F.flatten(F.reverse(merged)), 1, size)
    return slots.select("region_id", "slot", newest.alias("newest"), F.lead("slot").over(back).alias("next_slot"))


def smooth_list(newest: Column, alpha: float = K.SMOOTHING) -> Column:
    """Exponential smoothing of readings given newest first; the oldest one starts the recursion."""
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha must be in (0, 1], got {alpha}")
    oldest_first = F.reverse(newest)
    return F.aggregate(
        F.slice(oldest_first, 2, K.BUFFER_SIZE * 1000),
        F.element_at(oldest_first, 1),
        lambda e, x: F.zip_with(e, x, lambda old, new: F.lit(alpha) * new + F.lit(1.0 - alpha) * old),
    )


def cycle_states(readings: DataFrame, first: int, last: int, step_s: int = 3600, size: int = K.BUFFER_SIZE, alpha: float = K.SMOOTHING) -> DataFrame:
    """``slot``, ``region_id``, ``ema``, ``n_readings`` for every cycle from ``first`` to ``last`` and every region with readings by then.

    A region's state is worked out once per change and holds until the next.
    """
    states = newest_of_cycles(readings, step_s, size)
    held = states.withColumn("from", F.greatest("slot", F.lit(first))).withColumn("to", F.least(F.coalesce(F.col("next_slot") - 1, F.lit(last)), F.lit(last)))
    held = held.filter(F.col("from") <= F.col("to")).select("region_id", "from", "to", smooth_list(F.col("newest"), alpha).alias("ema"), F.size("newest").alias("n_readings"))
    return held.select(F.explode(F.sequence("from", "to")).alias("slot"), "region_id", "ema", "n_readings")


def cycle_history(
    readings: DataFrame, adjacency: DataFrame, first: int, last: int, step_s: int = 3600, size: int = K.BUFFER_SIZE, alpha: float = K.SMOOTHING, **options
) -> DataFrame:
    """The prediction records of all cycles from slot ``first`` to ``last``, as ``prediction_cycle`` gives them one by one.

    ``slot * step_s`` seconds after the epoch is the time of a cycle.
    """
    rows = validated(readings).select("region_id", "reading_id", "reading_ts", *K.SENSOR_FIELDS)
    kind = readings.schema["reading_ts"].dataType
    ema = cycle_states(rows, first, last, step_s, size, alpha).repartition("slot", "region_id")
    scored = scored_hazards(ema, adjacency, by=("slot",), **options)
    at = F.timestamp_micros(F.col("slot") * (step_s * 1000000)).cast(kind)
    return pr.prediction_records(pr.judge(pr.fan_out_horizons(scored)), at)
