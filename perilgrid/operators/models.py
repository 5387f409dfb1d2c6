"""Places where a user's own model replaces a built-in formula."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# functions of this module travel with the job, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])



def with_model(buffer: DataFrame, fn: Callable[[pd.DataFrame], list[float]]) -> DataFrame:
    """(region_id, vec) from a user's sequence model.

    ``fn`` gets one region's buffer, oldest first.  A buffer is bounded by its
    size, so no task holds more than one small frame.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("recency", ascending=False)
        return pd.DataFrame({"region_id": [pdf["region_id"].iloc[0]], "vec": [[float(x) for x in fn(ordered)]]})

    return buffer.groupBy("region_id").applyInPandas(run, "region_id string, vec array<double>")


def with_head(vectors: DataFrame, fn: Callable[[np.ndarray, np.ndarray, pd.Series], np.ndarray]) -> DataFrame:
    """Adds ``raw_pct`` from a user's score head over (vectors, contexts, hazards), in Arrow batches."""

    @F.pandas_udf("double")
    def head(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vec, ctx, hazard in batches:
            out = fn(np.stack(vec.to_numpy()), np.stack(ctx.to_numpy()), hazard) if len(vec) else []
            yield pd.Series(out, dtype="float64")

    return vectors.withColumn("raw_pct", head("vec", "context", "disaster_type"))


def pixel_shares(rgb: np.ndarray) -> tuple[float, float, float]:
    """Water percent, cloud share and vegetation index of an (n, 3) array in [0, 1]."""
    r, g, b = rgb[:, 0], rgb[:, 1], rgb[:, 2]
    water = (b > 0.4) & (b > r + 0.1) & (b > g + 0.05)
    cloud = rgb.mean(axis=1) > 0.75
    veg = np.clip(((g - r) / (g + r + 1e-6)).mean() + 0.5, 0.0, 1.0)
    return float(water.mean() * 100.0), float(cloud.mean()), float(veg)


def with_image_model(images: DataFrame, fn: Callable[[np.ndarray], tuple[float, float, float]] = pixel_shares) -> DataFrame:
    """Three features per file of Spark's ``image`` source, by a user's model.

    Rows are decoded one image at a time inside the task; undecodable files
    arrive with height -1 and are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for origin, h, w, c, data in pdf.itertuples(index=False):
                px = np.frombuffer(data, dtype=np.uint8).reshape(h * w, c)
                px = px[:, [2, 1, 0]] if c >= 3 else np.repeat(px[:, :1], 3, axis=1)
                rows.append((origin, *fn(px / 255.0)))
            yield pd.DataFrame(rows, columns=["image_id", "flood_inundation_pct", "cloud_density", "vegetation_index"])

    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").filter(
        "height > 0 and width > 0"
    )
    return flat.mapInPandas(
        run, "image_id string, flood_inundation_pct double, cloud_density double, vegetation_index double"
    )


