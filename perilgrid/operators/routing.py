"""Evacuation routes over the road graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import constants as K
from perilgrid.functions.columns import haversine_km, stable_id
from perilgrid.operators.buffers import blockage_sessions
from perilgrid.operators.reports import blockage_reports
from perilgrid.operators.skew import latest_per_key, skew_safe_join
from perilgrid.session import cut_lineage


def usable_edges(edges: DataFrame, two_way: DataFrame) -> DataFrame:
    """Edges of no blocked road; one blocked edge closes every edge of its road."""
    closed = edges.filter("is_blocked").select("road_id").distinct()
    return two_way.join(closed, "road_id", "left_anti")


_TRIP = ["query_id", "region_id", "origin", "destination"]
_LABEL = "struct<km:double,path:{nodes},round:int>"


def _trip_control(best: DataFrame, r: int) -> DataFrame:
    """Trips still worth extending, with the length of their best meeting so far.

    A trip whose two sides have not met can only succeed while both still grow,
    so a dead end around either place settles it.
    """
    opened = lambda side: F.bool_or(F.coalesce(F.col(f"{side}.round") == r, F.lit(False)))
    return (
        best.groupBy("query_id")
        .agg(F.min(F.col("f.km") + F.col("b.km")).alias("limit_km"), opened("f").alias("_f"), opened("b").alias("_b"))
        .filter(F.col("limit_km").isNotNull() | (F.col("_f") & F.col("_b")))
        .select("query_id", "limit_km")
    )


def _front(best: DataFrame, control: DataFrame, r: int) -> DataFrame:
    """Labels improved in step ``r``, one row per side, less those past the half of the best meeting."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("label")) for s in ("f", "b")])
    return (
        best.select(*_TRIP, "node", F.inline(sides))
        .filter(F.col("label.round") == r)
        .join(control, "query_id")
        .filter(F.col("limit_km").isNull() | (F.col("label.km") * 2 <= F.col("limit_km")))
    )


def _one_edge_further(best: DataFrame, hops: DataFrame, avoid: DataFrame | None, control: DataFrame, r: int) -> DataFrame:
    """``best`` after the labels improved in step ``r - 1`` are extended by one edge."""
    forward = F.col("side") == "f"
    to = F.array("to_node")
    step = (
        _front(best, control, r - 1)
        .join(hops, ["side", "node"])
        .filter(~F.array_contains("label.path", F.col("to_node")))
        .select(
            *_TRIP, "side", F.col("to_node").alias("node"),
            F.struct(
                (F.col("label.km") + F.col("km")).alias("km"),
                F.when(forward, F.concat("label.path", to)).otherwise(F.concat(to, "label.path")).alias("path"),
                F.lit(r).alias("round"),
            ).alias("label"),
        )
    )
    if avoid is not None:
        # searching back from the destination, the origin may be entered: it is not tested
        step = step.join(avoid, ["region_id", "node"], "left").filter(
            F.col("_bad").isNull() | (~forward & (F.col("node") == F.col("origin")))
        )
    added = step.select(*_TRIP, "node", *[F.when(F.col("side") == s, F.col("label")).alias(s) for s in ("f", "b")])
    both = best.unionByName(added)
    return both.groupBy(*_TRIP, "node").agg(F.min("f").alias("f"), F.min("b").alias("b"))


def shortest_paths(
    edges: DataFrame, trips: DataFrame, hazards: DataFrame | None = None, steps_per_write: int = 2
) -> DataFrame:
    """Cheapest path of every trip (query_id, region_id, origin, destination).

    ``edges`` is directed (from_node, to_node, distance_km).  Nodes listed in
    ``hazards`` for the trip's region are not entered; the origin is not
    tested.  Equal lengths are decided by the smaller node list.  Trips with no
    path give no row.

    All trips advance together from both ends, one edge per step.  Only labels
    improved in the last step are extended, and only while they are within half
    of the best meeting of the two sides: of a path of length L, each side
    needs the nodes up to L/2 and one edge beyond.  The best label per trip,
    node and side is kept by an aggregate.  After every few steps the labels
    are written to the shared folder, so the plan stays short and a lost
    executor does not replay earlier rounds.
    """
    there = F.struct(F.lit("f").alias("side"), F.col("from_node").alias("node"), F.col("to_node").alias("to_node"))
    back = F.struct(F.lit("b").alias("side"), F.col("to_node").alias("node"), F.col("from_node").alias("to_node"))
    hops = edges.groupBy("from_node", "to_node").agg(F.min("distance_km").alias("km"))
    hops = cut_lineage(hops.select("km", F.inline(F.array(there, back))))
    # a destination that may not be entered is never reached
    ends = trips.select(*_TRIP)
    avoid = None
    if hazards is not None:
        avoid = hazards.select("region_id", F.col("node_id").alias("node"), F.lit(True).alias("_bad")).distinct()
        avoid = cut_lineage(avoid)
        closed = avoid.withColumnRenamed("node", "destination")
        ends = ends.join(closed, ["region_id", "destination"], "left").filter("_bad is null or origin = destination")
    kind = _LABEL.format(nodes=f"array<{dict(trips.dtypes)['origin']}>")

    def start(side: str, node: str) -> DataFrame:
        label = F.struct(F.lit(0.0).alias("km"), F.array(node).alias("path"), F.lit(0).alias("round"))
        return ends.select(
            *_TRIP, F.col(node).alias("node"),
            *[(label if s == side else F.lit(None)).cast(kind).alias(s) for s in ("f", "b")],
        )

    seeds = start("f", "origin").unionByName(start("b", "destination"))
    best = cut_lineage(seeds.groupBy(*_TRIP, "node").agg(F.min("f").alias("f"), F.min("b").alias("b")))
    r = 0
    while True:
        control = _trip_control(best, r)
        if _front(best, control, r).isEmpty():
            break
        grown = best
        for _ in range(steps_per_write):
            r += 1
            grown = _one_edge_further(grown, hops, avoid, control, r)
        best = cut_lineage(grown)
    met = best.filter("f is not null and b is not null").select(
        *_TRIP,
        F.struct(
            (F.col("f.km") + F.col("b.km")).alias("km"), F.concat("f.path", F.expr("slice(b.path, 2, size(b.path))")).alias("path")
        ).alias("route"),
    )
    return met.groupBy(*_TRIP).agg(F.min("route").alias("route")).select(
        *_TRIP, F.col("route.km").alias("graph_km"), F.col("route.path").alias("path")
    )


def route_records(paths: DataFrame, nodes: DataFrame, hazards: DataFrame, computed_at: Column) -> DataFrame:
    """Stored form of each path: way points, great-circle length, minutes at 40 km/h, avoided nodes."""
    stops = paths.select("query_id", F.posexplode("path").alias("pos", "node_id")).join(nodes, "node_id")
    at = F.array_sort(F.collect_list(F.struct("pos", "lat", "lon", F.coalesce("label", F.col("node_id").cast("string")).alias("label"))))
    line = stops.groupBy("query_id").agg(at.alias("s"))
    legs = F.zip_with(
        F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))),
        F.slice("s", 2, F.size("s")),
        lambda a, b: haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]),
    )
    km = F.aggregate(legs, F.lit(0.0), lambda acc, x: acc + x)
    # five least hazard nodes per region
    five = latest_per_key(hazards, ["region_id"], [F.col("node_id")], 5)
    avoids = five.groupBy("region_id").agg(F.array_sort(F.collect_list("node_id")).alias("avoids"))
    first, last = F.element_at("s", 1), F.element_at("s", -1)
    place = lambda n: F.struct(n["lat"].alias("lat"), n["lon"].alias("lon"), n["label"].alias("label"))
    return (
        paths.join(line, "query_id")
        .join(avoids, "region_id", "left")
        .select(
            stable_id(F.lit("route"), F.col("query_id").cast("string")).alias("route_id"), "query_id", "region_id",
            place(first).alias("origin"), place(last).alias("destination"),
            F.transform(
                F.slice("s", 2, F.greatest(F.size("s") - 2, F.lit(0))),
                lambda n: F.struct(n["lat"].alias("lat"), n["lon"].alias("lon")),
            ).alias("waypoints"),
            F.round(km, 2).alias("distance_km"),
            F.round(km / K.EVACUATION_KMH * 60.0, 1).alias("estimated_duration_min"),
            F.coalesce("avoids", F.array().cast("array<bigint>")).alias("avoids"),
            computed_at.alias("computed_at"), F.lit(False).alias("is_blocked"),
        )
    )


def repair_paths(
    stored: DataFrame, edges: DataFrame, trips: DataFrame, hazards: DataFrame | None = None
) -> DataFrame:
    """Paths after roads have closed or hazards have spread, with ``repaired`` for those searched anew.

    ``stored`` has the paths of ``trips`` before (as ``shortest_paths`` gives them), ``edges`` and
    ``hazards`` hold now.  A path that uses no closed edge and enters no hazard node is
    still the shortest, as other ways have only become fewer; so only the broken trips
    are searched.  Roads that open again, or hazards that end, call for a full search.
    """
    steps = stored.select("query_id", "region_id", "path", F.explode(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1)))).alias("i"))
    steps = steps.filter(F.col("i") < F.size("path")).select(
        "query_id", "region_id", F.element_at("path", F.col("i")).alias("from_node"), F.element_at("path", F.col("i") + 1).alias("to_node")
    )
    lost = steps.join(edges.select("from_node", "to_node").distinct(), ["from_node", "to_node"], "left_anti").select("query_id")
    if hazards is not None:
        bad = hazards.select("region_id", F.col("node_id").alias("to_node")).distinct()
        lost = lost.union(steps.join(bad, ["region_id", "to_node"], "left_semi").select("query_id"))
    broken = cut_lineage(lost.distinct())
    again = shortest_paths(edges, trips.join(broken, "query_id", "left_semi"), hazards)
    kept = stored.join(broken, "query_id", "left_anti")
    return kept.withColumn("repaired", F.lit(False)).unionByName(again.withColumn("repaired", F.lit(True)))


def requested_routes(routes: DataFrame, requests: DataFrame) -> DataFrame:
    """A route record for each request of its region: under the prediction that asked for it, or ``recompute``.

    ``routes`` are the records of the region's trips; each is worked out once, however many ask.
    """
    asked = requests.select("region_id", F.coalesce("prediction_id", F.lit("recompute")).alias("prediction_id"), F.col("due_at").alias("computed_at"))
    named = skew_safe_join(asked, routes.drop("computed_at", "route_id"), ["region_id"])
    at = F.date_format("computed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return named.withColumn("route_id", stable_id(F.lit("route"), F.col("query_id").cast("string"), "prediction_id", at))


def route_requests(predictions: DataFrame, reports: DataFrame) -> DataFrame:
    """Who needs a route: every High prediction, and each region whose blockage reports have gone quiet."""
    high = predictions.filter(F.col("risk_level") == "High").select(
        "region_id", F.col("prediction_id").cast("string").alias("prediction_id"), F.col("generated_at").alias("due_at")
    )
    again = blockage_sessions(blockage_reports(reports)).select(
        "region_id", F.lit(None).cast("string").alias("prediction_id"), F.col("recompute_at").alias("due_at")
    )
    return high.unionByName(again).distinct()
