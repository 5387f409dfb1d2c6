"""Queries on places, hazard zones and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilgrid.catalog.intake import SESSIONS, as_of
from perilgrid.catalog.registry import query
from perilgrid.functions.columns import haversine_km
from perilgrid.operators import geo, routing
from perilgrid.sources import tables
from perilgrid.sources.views import rid

# ray casting over the zones' edges, bounding box first
_INSIDE = """select p.{key}, z.region_id from {points} p
    join (select zone_id, min(x1) as xlo, max(x1) as xhi, min(y1) as ylo, max(y1) as yhi from zone_edges group by 1) b
      on p.lon between b.xlo and b.xhi and p.lat between b.ylo and b.yhi
    join zone_edges e on e.zone_id = b.zone_id join zones z on z.zone_id = b.zone_id {where}
    group by p.{key}, z.zone_id, z.region_id
    having count(*) filter (where (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1"""
HAZARD = _INSIDE.format(
    key="node_id", points="road_nodes", where="where z.hazard_type in ('flood_inundation', 'landslide_high')")


def _trips(load):
    """One trip per supplier node, three regions taking turns; the target is two rows up and three columns on."""
    n = load("road_nodes").select("node_id")
    ends = n.withColumnRenamed("node_id", "destination")
    return n.withColumn("destination", F.col("node_id") + 23).join(ends, "destination", "left_semi").selectExpr(
        "node_id as query_id", f"{rid('node_id % 3')} as region_id", "node_id as origin", "destination")


TRIPS = f"""trips as (select node_id as query_id, {rid('node_id % 3')} as region_id, node_id as origin, node_id + 23 as destination
    from road_nodes where node_id + 23 in (select node_id from road_nodes))"""


def _hazards(load):
    return geo.hazard_nodes(load("road_nodes"), load("zones"))


def _edges(load):
    return routing.usable_edges(load("road_edges"), tables.road_network(load("road_edges")))


OPEN_EDGES = """(select from_node as a, to_node as b, distance_km as km, edge_id, road_id from road_edges
        where not is_blocked and road_id not in (select road_id from road_edges where is_blocked)
    union all select to_node, from_node, distance_km, edge_id, road_id from road_edges
        where not is_blocked and road_id not in (select road_id from road_edges where is_blocked))"""


@query("c01_report_region", ["crowd_reports", "zones", "zone_edges"], f"""
    select r.report_id, r.lat, r.lon, f.region_id from crowd_reports r
    left join (select report_id, min(region_id) as region_id from ({_INSIDE.format(key='report_id', points='crowd_reports', where='')}) group by 1) f
      on f.report_id = r.report_id""")
def report_region(load):
    return geo.locate(load("crowd_reports").drop("region_id"), load("zones"), "report_id")


@query("r01_haversine", ["crowd_reports"], """
    select report_id, round(2 * 6371 * asin(sqrt(pow(sin(radians(lat - 12.5) / 2), 2)
        + cos(radians(12.5)) * cos(radians(lat)) * pow(sin(radians(lon - 77.25) / 2), 2))), 6) as km from crowd_reports""")
def haversine(load):
    km = haversine_km(F.lit(12.5), F.lit(77.25), F.col("lat"), F.col("lon"))
    return load("crowd_reports").select("report_id", F.round(km, 6).alias("km"))


@query("r02_hazard_nodes", ["road_nodes", "zones", "zone_edges"], f"select distinct region_id, node_id from ({HAZARD})")
def hazard_nodes(load):
    return _hazards(load)


@query("r03_usable_edges", ["road_edges"], f"select edge_id, road_id, km as distance_km, a as from_node, b as to_node from {OPEN_EDGES}")
def usable(load):
    return _edges(load).select("edge_id", "road_id", "distance_km", "from_node", "to_node")


_PATHS = f"""with recursive {TRIPS}, hz as materialized (select distinct region_id, node_id from ({HAZARD})),
    ed as materialized (select a, b, min(km) as km from {OPEN_EDGES} group by 1, 2),
    lab as (
        select query_id, region_id, destination, origin as node, 0e0 as km from trips
        union all
        select query_id, region_id, destination, node, km from (
            select l.query_id, l.region_id, l.destination, e.b as node, min(l.km + e.km) as km
            from lab l join ed e on e.a = l.node
            where not exists (select 1 from hz where hz.region_id = l.region_id and hz.node_id = e.b)
            group by all) n
        where n.km < coalesce((select x.km from recurring.lab x where x.query_id = n.query_id and x.node = n.node), 1e9)
    )"""
_PATHS = _PATHS.replace("lab as (\n", "lab(query_id, region_id, destination, node, km) using key (query_id, node) as (\n")


@query("r04_shortest_paths", ["road_nodes", "road_edges", "zones", "zone_edges"],
       _PATHS + " select query_id, km as graph_km from lab where node = destination")
def shortest(load):
    return routing.shortest_paths(_edges(load), _trips(load), _hazards(load)).select("query_id", "graph_km")


_ROUTES = f"""with recursive {TRIPS}, hz as materialized (select distinct region_id, node_id from ({HAZARD})),
    ed as materialized (select a, b, min(km) as km from {OPEN_EDGES} group by 1, 2),
    lab(query_id, region_id, destination, node, l) using key (query_id, node) as (
        select query_id, region_id, destination, origin, {{'km': 0e0, 'path': [origin]}} from trips
        union all
        select query_id, region_id, destination, node, l from (
            select p.query_id, p.region_id, p.destination, e.b as node,
                   min({{'km': p.l.km + e.km, 'path': list_append(p.l.path, e.b)}}) as l
            from lab p join ed e on e.a = p.node
            where not exists (select 1 from hz where hz.region_id = p.region_id and hz.node_id = e.b)
              and not list_contains(p.l.path, e.b) group by all) n
        where n.l < coalesce((select x.l from recurring.lab x where x.query_id = n.query_id and x.node = n.node),
                             {{'km': 1e9, 'path': []::bigint[]}})),
    route as (select query_id, region_id, l.path as path from lab where node = destination),
    named as (select node_id, lat, lon, coalesce(label, cast(node_id as varchar)) as label from road_nodes),
    legs as (select query_id, sum(2 * 6371 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
                 + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) as km
             from (select query_id, path, unnest(range(1, len(path))) as i from route) r
             join named a on a.node_id = path[i] join named b on b.node_id = path[i + 1] group by 1),
    avoid as (select region_id, string_agg(cast(node_id as varchar), ',' order by node_id) as avoids
              from (select *, row_number() over (partition by region_id order by node_id) as rn from hz) where rn <= 5 group by 1)
    select sha256(concat('route|', r.query_id)) as route_id, r.query_id, r.region_id, o.label as origin_label, d.label as destination_label,
           (len(path) - 2)::int as n_waypoints, round(km, 2) as distance_km, round(km / 40 * 60, 1) as estimated_duration_min,
           coalesce(avoids, '') as avoids, false as is_blocked
    from route r join legs g on g.query_id = r.query_id join named o on o.node_id = path[1] join named d on d.node_id = path[-1]
    left join avoid v on v.region_id = r.region_id"""


@query("r05_route_records", ["road_nodes", "road_edges", "zones", "zone_edges"], _ROUTES)
def route_records(load):
    hazards = _hazards(load)
    paths = routing.shortest_paths(_edges(load), _trips(load), hazards)
    nodes = tables.road_nodes(load("road_nodes"))
    out = routing.route_records(paths, nodes, hazards, as_of())
    return out.select(
        "route_id", "query_id", "region_id", F.col("origin.label").alias("origin_label"),
        F.col("destination.label").alias("destination_label"), F.size("waypoints").alias("n_waypoints"),
        "distance_km", "estimated_duration_min", F.array_join(F.col("avoids").cast("array<string>"), ",").alias("avoids"), "is_blocked")


_REQUESTS = f"""(select region_id, cast(prediction_id as varchar) as prediction_id, generated_at as due_at from predictions where risk_level = 'High'
    union select region_id, 'recompute', recompute_at from {SESSIONS})"""


@query("r05_requested_routes", ["road_nodes", "road_edges", "zones", "zone_edges", "predictions", "crowd_reports"], f"""
    select sha256(concat('route|', r.query_id, '|', q.prediction_id, '|', strftime(q.due_at, '%Y-%m-%d %H:%M:%S.%f'))) as route_id,
           r.query_id, r.region_id, q.prediction_id, r.distance_km, r.estimated_duration_min, q.due_at as computed_at
    from ({_ROUTES}) r join {_REQUESTS} q on q.region_id = r.region_id""")
def requested(load):
    hazards = _hazards(load)
    paths = routing.shortest_paths(_edges(load), _trips(load), hazards)
    records = routing.route_records(paths, tables.road_nodes(load("road_nodes")), hazards, as_of())
    out = routing.requested_routes(records, routing.route_requests(load("predictions"), load("crowd_reports")))
    return out.select("route_id", "query_id", "region_id", "prediction_id", "distance_km", "estimated_duration_min", "computed_at")


@query("r06_route_requests", ["predictions", "crowd_reports"], f"""
    select region_id, cast(prediction_id as varchar) as prediction_id, generated_at as due_at from predictions where risk_level = 'High'
    union select region_id, null, recompute_at from {SESSIONS}""")
def requests(load):
    return routing.route_requests(load("predictions"), load("crowd_reports"))
