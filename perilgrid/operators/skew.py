"""Joins and trailing counts that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilgrid.functions.columns import epoch_micros


def hot_keys(df: DataFrame, keys: list[str], share: float | None = None) -> DataFrame:
    """Keys with more than ``share`` of the rows, and ``_parts``, the number of
    tasks such a key should be split over.

    By default a key is hot when it alone fills half of an even partition.
    There are at most ``1/share`` hot keys whatever the data, which is twice the
    number of shuffle partitions, so the result may be broadcast.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(share or 0.0, 0.5 / partitions)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.agg(F.sum("_n").alias("t")).scalar()
    parts = F.greatest(F.ceil(F.col("_n") * F.lit(float(partitions)) / rows), F.lit(2)).cast("int")
    return counts.filter(F.col("_n") > F.lit(share) * rows).select(*keys, parts.alias("_parts"))


def skew_safe_join(
    many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", share: float | None = None
) -> DataFrame:
    """Equi-join in which rows of ``many`` under a hot key go to several tasks.

    Only hot keys are salted, each by its own weight, and only their partners
    in ``few`` are copied, so the plain rows pay nothing.  Rows with a null key
    match nothing and are spread as well.  The salt is a hash of the row, which
    gives the same value when a lost task is run again.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the side that is split must be the preserved one")
    hot = F.broadcast(hot_keys(many, keys, share))
    lost = F.lit(False)
    for k in keys:
        lost = lost | F.col(k).isNull()
    parts = F.when(lost, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))).otherwise(
        F.coalesce("_parts", F.lit(1))
    )
    left = many.join(hot, keys, "left")
    hashed = [c for c, kind in many.dtypes if "map<" not in kind]
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*hashed), parts.cast("bigint"))).drop("_parts")
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)).cast("bigint") - 1)
    right = few.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key.  Catalyst turns the rank filter into a
    WindowGroupLimit, so each map task sends at most ``n`` rows per key."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def trailing_count(df: DataFrame, keys: list[str], ts: str, seconds: int, slice_seconds: int = 60) -> DataFrame:
    """For each key and distinct time, rows in the closed window ``[ts - seconds, ts]``.

    A window function over the key would put a hot key into one task.  Here the
    rows are first counted per (key, time); running counts are then taken
    within (key, slice) and shifted by the count of all earlier slices, and the
    trailing count is the running count at ``ts`` less the one just before the
    window opens.  The one window over a whole key runs over its slices, whose
    number is bounded by time.
    """
    width, step = seconds * 1000000, slice_seconds * 1000000
    points = df.groupBy(*keys, epoch_micros(F.col(ts)).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    # each time closes its own window (kind 1) and opens it (kind 0, before rows at that instant)
    marks = points.select(
        *keys,
        F.col("at").alias("owner"),
        F.explode(
            F.array(
                F.struct(F.col("at").alias("at"), F.lit(1).alias("kind"), F.col("n").alias("n")),
                F.struct((F.col("at") - width).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("n")),
            )
        ).alias("m"),
    ).select(*keys, "owner", "m.*", F.floor(F.col("m.at") / step).alias("slice"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marks.groupBy(*keys, "slice")
        .agg(F.sum("n").alias("in_slice"))
        .select(*keys, "slice", F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("offset"))
    )
    running = Window.partitionBy(*keys, "slice").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.withColumn("upto", F.sum("n").over(running)).join(offsets, [*keys, "slice"])
    upto = F.col("upto") + F.col("offset")
    return counted.groupBy(*keys, F.col("owner").alias("at_micros")).agg(
        F.sum(F.when(F.col("kind") == 1, upto).otherwise(-upto)).alias("trailing")
    )


def sliced_lag(
    df: DataFrame, keys: list[str], ts: str, tie: str, slice_seconds: int = 3600, fine_seconds: int = 1, share: float | None = None
) -> DataFrame:
    """Adds ``prev_micros``, the time of the key's previous row.

    The window runs per (key, slice) of time; only the first row of a slice
    looks further back, at the newest time of the key's earlier slices.  A
    slice that holds more than ``share`` of all rows is cut into fine ones.
    As with ``lag``, a null key is a key of its own and rows without a time come
    first, so no row is lost.
    """
    coarse, fine = slice_seconds * 1000000, fine_seconds * 1000000
    start = lambda width: F.floor(F.col("_at") / width) * width
    cut = df.withColumn("_at", epoch_micros(F.col(ts))).withColumn("_slice", start(coarse))
    crowded = F.broadcast(hot_keys(cut, [*keys, "_slice"], share))
    cut = cut.join(crowded, [*keys, "_slice"], "left")
    cut = cut.withColumn("_slice", F.when(F.col("_parts").isNotNull(), start(fine)).otherwise(F.col("_slice"))).drop("_parts")
    ends = cut.groupBy(*keys, "_slice").agg(F.max("_at").alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_slice"))).drop("_end")
    inside = F.lag("_at").over(Window.partitionBy(*keys, "_slice").orderBy("_at", tie))
    left = cut.withColumn("_in", inside)
    same = F.lit(True)
    for k in (*keys, "_slice"):
        same = same & left[k].eqNullSafe(ends[k])
    return (
        left.join(ends, same)
        .select(*[left[c] for c in left.columns], ends["_before"])
        .withColumn("prev_micros", F.coalesce("_in", "_before"))
        .drop("_in", "_before", "_slice")
        .withColumnRenamed("_at", "at_micros")
    )
