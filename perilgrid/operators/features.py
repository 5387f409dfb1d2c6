"""Feature sets per hazard, smoothed region vectors, context, graph step and image features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilgrid.functions import constants as K
from perilgrid.functions.columns import clamp, dot, sql_literal, zero

# fields of a routed reading that the smoothing model knows by name
ROUTED_SENSOR_FIELDS = {
    h: tuple(f for f in K.SENSOR_FIELDS if f in K.FEATURES[h]) for h in K.HAZARDS
}


def with_terrain(readings: DataFrame, terrain: DataFrame | None, drainage: DataFrame | None = None) -> DataFrame:
    """Left lookup of the region's ground; a region without one gets zeros."""
    df = readings
    if terrain is not None:
        df = df.join(terrain.select("region_id", "elevation_m", "slope_gradient"), "region_id", "left")
    if drainage is not None:
        df = df.join(drainage.select("region_id", "capacity_m3"), "region_id", "left")
    for c in ("elevation_m", "slope_gradient", "capacity_m3"):
        df = df.withColumn(c, zero(c) if c in df.columns else F.lit(0.0))
    return df


def flood_features(buffer: DataFrame, terrain: DataFrame | None = None, drainage: DataFrame | None = None) -> DataFrame:
    return with_terrain(buffer, terrain, drainage).select(
        "region_id", "reading_id",
        *[zero(c).alias(c) for c in ("rainfall_mm", "river_level_m", "soil_moisture_pct")],
        F.col("elevation_m").alias("elevation"),
        F.col("capacity_m3").alias("drainage_capacity"),
    )


def heatwave_features(buffer: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    df = buffer
    if flags is not None:
        df = df.join(flags.select("region_id", "historical_heatwave_flag"), "region_id", "left")
    flag = zero(F.col("historical_heatwave_flag").cast("double")) if flags is not None else F.lit(0.0)
    return df.select(
        "region_id", "reading_id",
        zero("temperature_c").alias("temperature_c"),
        zero("wind_speed_kmh").alias("wind_speed_kmh"),
        zero("soil_moisture_pct").alias("humidity"),
        flag.alias("historical_heatwave_flag"),
    )


def drought_features(buffer: DataFrame, window_days: int = 30) -> DataFrame:
    """Deficit, trend and anomaly against the means of the region's whole buffer."""
    whole = Window.partitionBy("region_id")
    in_time = whole.orderBy(F.col("recency").desc())
    rain, soil, temp = zero("rainfall_mm"), zero("soil_moisture_pct"), zero("temperature_c")
    return buffer.select(
        "region_id", "reading_id",
        F.when(rain < F.avg(rain).over(whole), -rain).otherwise(0.0).alias("rainfall_deficit_mm"),
        F.coalesce(soil - F.lag(soil).over(in_time), F.lit(0.0)).alias("soil_moisture_trend"),
        (temp - F.avg(temp).over(whole)).alias("temperature_anomaly_c"),
        F.lit(float(window_days)).alias("rolling_window_days"),
    )


def landslide_features(buffer: DataFrame, terrain: DataFrame | None = None) -> DataFrame:
    return with_terrain(buffer, terrain).select(
        "region_id", "reading_id",
        zero("rainfall_mm").alias("rainfall_intensity_mm"),
        zero("soil_moisture_pct").alias("soil_moisture_pct"),
        F.col("slope_gradient").alias("elevation_gradient"),
        F.col("slope_gradient").alias("terrain_slope"),
    )


def cyclone_features(buffer: DataFrame) -> DataFrame:
    def optional(c: str) -> Column:
        return zero(c) if c in buffer.columns else F.lit(0.0)

    return buffer.select(
        "region_id", "reading_id",
        *[optional(c).alias(c) for c in ("wind_speed_kmh", "wind_direction_deg", "sea_surface_temp_c", "cloud_density")],
    )


def with_cloud_density(buffer: DataFrame, latest_cnn: DataFrame, switch: DataFrame) -> DataFrame:
    """Adds the region's newest cloud density while the satellite switch is on."""
    on = switch.select("available").scalar()
    known = latest_cnn.select("region_id", F.col("cloud_density").alias("_cloud"))
    return (
        buffer.join(known, "region_id", "left")
        .withColumn("cloud_density", F.when(on, F.col("_cloud")))
        .drop("_cloud")
    )


def hazard_readings(buffer: DataFrame, latest_cnn: DataFrame, switch: DataFrame) -> DataFrame:
    """The buffer once per hazard; the hazards that clouds tell of get the region's newest cloud density while the switch is on."""
    seen = with_cloud_density(buffer.drop("cloud_density"), latest_cnn, switch)
    per = seen.withColumn("disaster_type", F.explode(F.array(*[F.lit(h) for h in K.HAZARDS])))
    return per.withColumn("cloud_density", F.when(F.col("disaster_type").isin(*K.CLOUD_HAZARDS), F.col("cloud_density")))


def feature_catalogue(spark: SparkSession) -> DataFrame:
    rows = [(h, i, f) for h in K.HAZARDS for i, f in enumerate(K.FEATURES[h])]
    return spark.createDataFrame(rows, "disaster_type string, position int, field string")


def smooth(buffer: DataFrame, alpha: float = K.SMOOTHING) -> DataFrame:
    """Exponential smoothing of the six sensor fields, oldest reading first.

    The recursion ``e = a*x + (1-a)*e`` equals a weighted sum over the buffer:
    ``a*(1-a)^i`` for the i-th newest and ``(1-a)^(n-1)`` for the oldest, so one
    aggregate does it.  The result is one array, so every later use asks for
    the same columns and can share the exchange.
    """
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha must be in (0, 1], got {alpha}")
    n = F.count(F.lit(1)).over(Window.partitionBy("region_id"))
    i = F.col("recency") - 1
    weight = F.when(F.col("recency") == n, F.pow(F.lit(1.0 - alpha), i)).otherwise(
        F.lit(alpha) * F.pow(F.lit(1.0 - alpha), i)
    )
    weighted = buffer.withColumn("_w", weight)
    sums = [F.sum(F.col("_w") * zero(f)) for f in K.SENSOR_FIELDS]
    return weighted.groupBy("region_id").agg(F.array(*sums).alias("ema"), F.count(F.lit(1)).alias("n_readings"))


def project(ema: str, fields: tuple[str, ...]) -> str:
    """SQL text of the fixed 6 to 16 projection of the named fields; not yet normalised."""
    rows = [K.SENSOR_FIELDS.index(f) for f in fields]
    cells = [
        " + ".join(f"{ema}[{r}] * {sql_literal(K.PROJECTION[r][k])}" for r in rows) or "0D" for k in range(K.VECTOR_DIM)
    ]
    return f"array({', '.join(cells)})"


def unit(vec: Column) -> Column:
    """Scaled to length one; the zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(vec)


def mix(a: float, left: Column, b: float, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: F.lit(a) * x + F.lit(b) * y)


def weighted_sums(weight: str, vec: str, size: int = K.VECTOR_DIM) -> Column:
    """Component-wise ``sum(weight * vec)`` as an array; plain sums, so they combine before a shuffle."""
    return F.expr("array(" + ", ".join(f"sum({weight} * {vec}[{k}])" for k in range(size)) + ")")


def region_vectors(ema: DataFrame, fields: tuple[str, ...] = K.SENSOR_FIELDS, by: tuple[str, ...] = ()) -> DataFrame:
    """(region_id, vec): the unit vector built from the given sensor fields.

    Here and below ``by`` names columns that tell several cycles in one table apart.
    """
    raw = ema.select(*by, "region_id", F.expr(project("ema", fields)).alias("raw"))
    return raw.select(*by, "region_id", unit(F.col("raw")).alias("vec"))


def region_parts(ema: DataFrame, fields: tuple[str, ...] = K.SENSOR_FIELDS, by: tuple[str, ...] = ()) -> DataFrame:
    """(region_id, vec): the fields themselves, scaled so that ``projected`` makes the unit vector of them.

    Context and graph only weigh and add vectors, so they may as well work on these few
    numbers, with weights as the fields see them (``seen_by``), and what moves between
    regions is that much smaller.
    """
    norm = F.aggregate(F.expr(project("ema", fields)), F.lit(0.0), lambda acc, x: acc + x * x, F.sqrt)
    own = F.expr(f"array({', '.join(f'ema[{K.SENSOR_FIELDS.index(f)}]' for f in fields)})")
    raw = ema.select(*by, "region_id", own.alias("raw"), norm.alias("norm"))
    scaled = F.when(F.col("norm") > 0, F.transform("raw", lambda x: x / F.col("norm"))).otherwise(F.col("raw"))
    return raw.select(*by, "region_id", scaled.alias("vec"))


def seen_by(fields: tuple[str, ...], weights: list[float]) -> list[float]:
    """Weights of the fields that give the dot product of their projection with ``weights``."""
    return [sum(w * p for w, p in zip(weights, K.PROJECTION[K.SENSOR_FIELDS.index(f)])) for f in fields]


def projected(df: DataFrame, fields: tuple[str, ...], vec: str = "vec") -> DataFrame:
    """Vectors in place of the values of their fields."""
    cells = [" + ".join(f"{vec}[{i}] * {sql_literal(K.PROJECTION[K.SENSOR_FIELDS.index(f)][k])}" for i, f in enumerate(fields)) for k in range(K.VECTOR_DIM)]
    return df.withColumn(vec, F.expr(f"array({', '.join(cells)})"))


def hazard_vectors(ema: DataFrame, routed_only: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(region_id, disaster_type, vec) for the five hazards.

    A routed reading carries only its hazard's own fields, and the smoothing
    knows raw sensor names only, so each hazard sees a subset of the six fields
    and drought, whose fields are all derived, has the zero vector.
    """
    per = ", ".join(
        f"struct('{h}' as disaster_type, {project('ema', ROUTED_SENSOR_FIELDS[h] if routed_only else K.SENSOR_FIELDS)} as raw)"
        for h in K.HAZARDS
    )
    rows = ema.select(*by, "region_id", F.expr(f"inline(array({per}))"))
    return rows.select(*by, "region_id", "disaster_type", unit(F.col("raw")).alias("vec"))


def attention_context(vectors: DataFrame, temperature: float = 1.0, by: tuple[str, ...] = (), query: list[float] = K.QUERY_VECTOR) -> DataFrame:
    """One row (one for each cycle): the softmax-weighted mean of all region vectors.

    Softmax does not change when all scores move by a constant, which here is
    the greatest score: one aggregate over a row per region.  ``query`` weighs the
    components, of which there are as many.
    """
    if temperature <= 0:
        raise ValueError(f"temperature must be > 0, got {temperature}")
    score = dot("vec", query) / F.lit(temperature)
    if by:
        tops = vectors.groupBy(*by).agg(F.max(score).alias("_top"))
        weighed = vectors.join(tops, list(by)).select(*by, "vec", F.exp(score - F.col("_top")).alias("w"))
    else:
        shift = vectors.agg(F.max(score).alias("m")).scalar()
        weighed = vectors.select("vec", F.exp(score - shift).alias("w"))
    sums = weighed.groupBy(*by).agg(
        F.sum("w").alias("z"), weighted_sums("w", "vec", len(query)).alias("s")
    )
    return sums.select(*by, F.transform("s", lambda x: x / F.col("z")).alias("context"))


def with_context(
    vectors: DataFrame, temperature: float = 1.0, flood: DataFrame | None = None, by: tuple[str, ...] = (), fields: tuple[str, ...] | None = None
) -> DataFrame:
    """Gives every row the same context, as a scalar subquery; each cycle its own, if there are several.

    With ``fields``, ``flood`` has the ``region_parts`` of these fields.
    """
    if fields:
        context = projected(attention_context(flood, temperature, by, seen_by(fields, K.QUERY_VECTOR)), fields, "context")
    else:
        context = attention_context(flood if flood is not None else vectors, temperature, by)
    return vectors.join(context, list(by)) if by else vectors.withColumn("context", context.scalar())


def propagate(
    vectors: DataFrame, adjacency: DataFrame, rounds: int = 2, degraded: bool = False, by: tuple[str, ...] = (), weights: list[float] = K.GRAPH_VECTOR
) -> DataFrame:
    """Message passing over the region graph: 0.6 of the own vector, 0.4 of the
    neighbours' softmax-weighted mean; all regions update at once.

    Each region's scores are shifted by their greatest before the exponential,
    so any edge weight will do.  Both the greatest score and the sums are
    pre-aggregated before their shuffle; a hub's edges in the joins are left to
    adaptive execution, which splits them.  ``weights`` give a vector's score and
    are as many as its components; a message carries that many numbers.
    """
    if degraded:
        return vectors
    edges = adjacency.select("region_id", "neighbour_id", "edge_weight")
    place = [*by, "region_id"]
    for _ in range(rounds):
        theirs = vectors.select(*by, F.col("region_id").alias("neighbour_id"), F.col("vec").alias("nvec"))
        scored = edges.join(theirs, "neighbour_id").withColumn("score", dot("nvec", weights) * F.col("edge_weight"))
        top = scored.groupBy(*place).agg(F.max("score").alias("top"))
        mail = (
            scored.join(top, place)
            .withColumn("e", F.exp(F.col("score") - F.col("top")))
            .groupBy(*place)
            .agg(F.sum("e").alias("z"), weighted_sums("e", "nvec", len(weights)).alias("sums"))
        )
        mean = F.transform("sums", lambda x: x / F.col("z"))
        mixed = mix(0.6, F.col("vec"), 0.4, mean)
        vectors = vectors.join(mail, place, "left").select(
            *place, F.when(F.col("z").isNull(), F.col("vec")).otherwise(mixed).alias("vec")
        )
    return vectors


def blend_spatial(hazards: DataFrame, graph: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """0.7 own + 0.3 graph vector for the hazards that spread between regions."""
    g = graph.select(*by, "region_id", F.col("vec").alias("gvec"))
    mixed = mix(0.7, F.col("vec"), 0.3, F.col("gvec"))
    spreads = F.col("disaster_type").isin(*K.SPATIAL_HAZARDS) & F.col("gvec").isNotNull()
    return hazards.join(g, [*by, "region_id"], "left").withColumn("vec", F.when(spreads, mixed).otherwise(F.col("vec"))).drop("gvec")


def image_features(pixels: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Water, cloud and vegetation shares of images given as pixel rows with r, g, b in [0, 1]."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    water = (b > 0.4) & (b > r + 0.1) & (b > g + 0.05)
    cloud = (r + g + b) / 3.0 > 0.75
    return pixels.groupBy(*keys).agg(
        (F.avg(water.cast("double")) * 100.0).alias("flood_inundation_pct"),
        F.avg(cloud.cast("double")).alias("cloud_density"),
        clamp(F.avg((g - r) / (g + r + 1e-6)) + 0.5, 0.0, 1.0).alias("vegetation_index"),
    )
