"""Points against polygons, by way of grid cells of a size that fits each zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import constants as K
from perilgrid.operators.skew import skew_safe_join

#: Cells of level n are 360 / 2**n degrees wide; a zone's box takes at most this many, and one more, along each side.
ACROSS = 8
_WIDEST = 360.0
_FINEST = 40


def _cell(c: Column, level: Column) -> Column:
    return F.floor(c / _width(level))


def _width(level: Column) -> Column:
    return F.lit(_WIDEST) / F.pow(F.lit(2.0), level)


def zone_cells(zones: DataFrame, across: int = ACROSS) -> DataFrame:
    """The cells that cover each zone: ``level``, ``cx``, ``cy``, ``inner``, ``edges`` and the zone's columns but its ring.

    A zone is covered at the level at which its bounding box is at most ``across`` cells
    wide and high, so the number of cells does not depend on its size.  A cell that no
    edge touches lies inside or outside as a whole: the latter are left out and the
    former need no test.  Any other cell keeps the edges that a ray to the right of one of
    its points may cross, which are those of its rows that do not end left of it.
    A ring without points covers nothing.
    """
    n = F.size("ring")
    before = lambda i: F.element_at("ring", F.when(i == 0, n).otherwise(i))
    edges = F.transform(
        "ring",
        lambda v, i: F.struct(v["lon"].alias("x1"), v["lat"].alias("y1"), before(i)["lon"].alias("x2"), before(i)["lat"].alias("y2")),
    )
    lons, lats = F.transform("ring", lambda v: v["lon"]), F.transform("ring", lambda v: v["lat"])
    box = {"_x1": F.array_min(lons), "_x2": F.array_max(lons), "_y1": F.array_min(lats), "_y2": F.array_max(lats)}
    span = F.greatest(F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1"))
    fits = F.floor(F.log2(F.lit(_WIDEST * across) / F.greatest(span, F.lit(1e-12))))
    level = F.least(F.greatest(fits, F.lit(0)), F.lit(_FINEST)).cast("int")
    covered = zones.filter(n > 0).withColumn("_edges", edges).withColumns(box).withColumn("level", level)
    for c, low, high in (("cx", "_x1", "_x2"), ("cy", "_y1", "_y2")):
        covered = covered.withColumn(c, F.explode(F.sequence(_cell(F.col(low), F.col("level")), _cell(F.col(high), F.col("level")))))
    w = _width(F.col("level"))
    left, low = F.col("cx") * w, F.col("cy") * w
    slack = w * 1e-9  # cell borders are rounded numbers
    overlaps = lambda a, b, start, end: (F.greatest(a, b) >= start - slack) & (F.least(a, b) <= end + slack)
    in_rows = lambda e: overlaps(e["y1"], e["y2"], low, low + w) & (F.greatest(e["x1"], e["x2"]) >= left - slack)
    touches = lambda e: overlaps(e["y1"], e["y2"], low, low + w) & overlaps(e["x1"], e["x2"], left, left + w)
    covered = covered.withColumn("inner", ~F.exists("_edges", touches)).withColumn("edges", F.filter("_edges", in_rows))
    whole = ~F.col("inner") | _odd(left + w / 2, low + w / 2, F.col("edges"))
    kept = covered.filter(whole).withColumn("edges", F.when(~F.col("inner"), F.col("edges")))
    return kept.drop("ring", "_edges", *box)


def _odd(lon: Column, lat: Column, edges: Column) -> Column:
    """Whether a ray to the right crosses an odd number of the edges."""

    def crosses(e: Column) -> Column:
        straddles = (e["y1"] > lat) != (e["y2"] > lat)
        at = (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return straddles & F.coalesce(lon < at, F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def points_in_zones(points: DataFrame, zones: DataFrame, across: int = ACROSS) -> DataFrame:
    """Pairs of a point and a zone that contains it.

    Cells turn the spatial test into an equi-join: a point looks up its cell at each
    level that some zone uses.  Points of an inner cell are in the zone; only for
    border cells is a ray tested, against the edges of the cell.  A crowded cell is salted.
    """
    cells = zone_cells(zones, across)
    levels = cells.agg(F.array_sort(F.collect_set("level"))).scalar()  # at most one entry per level
    spots = points.withColumn("level", F.explode(levels))
    spots = spots.withColumns({"cx": _cell(F.col("lon"), F.col("level")), "cy": _cell(F.col("lat"), F.col("level"))})
    near = skew_safe_join(spots, cells, ["level", "cx", "cy"])
    return near.filter(F.col("inner") | _odd(F.col("lon"), F.col("lat"), F.col("edges"))).drop("level", "cx", "cy", "inner", "edges")


def locate(points: DataFrame, zones: DataFrame, key: str, across: int = ACROSS) -> DataFrame:
    """Region of each point: the least region id among the zones holding it, else null."""
    spots = points.select(key, "lat", "lon")
    hits = points_in_zones(spots, zones.select("region_id", "ring"), across)
    first = hits.groupBy(key).agg(F.min("region_id").alias("region_id"))
    return spots.join(first, key, "left")


def hazard_nodes(nodes: DataFrame, zones: DataFrame, kinds: tuple[str, ...] = K.ROUTE_HAZARDS) -> DataFrame:
    """Road nodes inside a dangerous zone, per region of the zone."""
    bad = zones.filter(F.col("hazard_type").isin(*kinds)).select("region_id", "ring")
    return points_in_zones(nodes.select("node_id", "lat", "lon"), bad).select("region_id", "node_id").distinct()
