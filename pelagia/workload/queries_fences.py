"""Fence, proximity and alert-level queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia import dims
from pelagia.functions import marine
from pelagia.operators import fences as ops, tools
from pelagia.plans.ordered import balanced
from pelagia.plans.spatial import nearest_features, polygons_containing
from pelagia.session import cut_lineage
from pelagia.workload.registry import query, r6
from pelagia.workload.views import Views

FENCE_TABLE = dims.rows_sql(dims.FENCE_CLASSES, dims.FENCE_COLUMNS)
SEVERITY_TABLE = dims.rows_sql(dims.SEVERITIES, "severity, severity_rank")

HAVERSINE = ("2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * "
             "cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2)))) / 1852")
BEARING = ("(degrees(atan2(sin(radians({o2} - {o1})) * cos(radians({a2})), cos(radians({a1})) * sin(radians({a2})) - "
           "sin(radians({a1})) * cos(radians({a2})) * cos(radians({o2} - {o1})))) + 360) % 360")


def hav(a1, o1, a2, o2):
    return "(" + HAVERSINE.format(a1=a1, o1=o1, a2=a2, o2=o2) + ")"


def brg(a1, o1, a2, o2):
    return "(" + BEARING.format(a1=a1, o1=o1, a2=a2, o2=o2) + ")"


def nearest_sql(points: str, keys: str, layer_pick: bool = True) -> str:
    """CTEs seg -> feat -> near: every point against every segment, then the best feature."""
    return f"""
    seg AS (
        SELECT p.*, s.layer, s.fkey, s.is_polygon, s.x1, s.y1, s.x2, s.y2,
               CASE WHEN (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) = 0 THEN 0 ELSE greatest(0, least(1,
               ((p.lon-x1)*(x2-x1)+(p.lat-y1)*(y2-y1)) / ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) END AS t
        FROM {points} p, {{fence_segments}} s),
    feat AS (
        SELECT {keys}, layer, fkey, min(lat) AS lat, min(lon) AS lon,
               arg_min(x1+t*(x2-x1), pow(lon-(x1+t*(x2-x1)),2)+pow(lat-(y1+t*(y2-y1)),2)) AS qx,
               arg_min(y1+t*(y2-y1), pow(lon-(x1+t*(x2-x1)),2)+pow(lat-(y1+t*(y2-y1)),2)) AS qy,
               bool_or(is_polygon) AND sum(CASE WHEN (y1>lat) <> (y2>lat) AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END) % 2 = 1 AS inside
        FROM seg GROUP BY {keys}, layer, fkey),
    near AS (
        SELECT {keys}, layer, fkey, inside, lat, lon,
               CASE WHEN inside THEN 0 ELSE {hav('lat','lon','qy','qx')} END AS distance_nm,
               CASE WHEN inside THEN lat ELSE qy END AS closest_lat, CASE WHEN inside THEN lon ELSE qx END AS closest_lon
        FROM feat),
    best AS (
        SELECT *, CASE WHEN distance_nm > 0.000001 THEN {brg('lat','lon','closest_lat','closest_lon')} END AS bearing_deg
        FROM near QUALIFY row_number() OVER (PARTITION BY {keys}{', layer' if layer_pick else ''} ORDER BY round(distance_nm, 9), {'' if layer_pick else 'layer, '}fkey) = 1)"""


LEVELS_SQL = f"""
    classes AS ({FENCE_TABLE}), severities AS ({SEVERITY_TABLE}),
    levelled AS (
        SELECT b.*, f.name, c.severity, c.class_order, s.severity_rank,
               CAST(CASE WHEN inside THEN 3 WHEN distance_nm <= coalesce(f.own_critical_nm, c.critical_nm) THEN 2
                    WHEN distance_nm <= coalesce(f.own_warn_nm, c.warn_nm) THEN 1 ELSE 0 END AS INT) AS level_rank
        FROM best b JOIN {{fences}} f ON b.layer = f.layer AND b.fkey = f.fkey
        JOIN classes c ON c.fence_class = b.layer JOIN severities s ON s.severity = c.severity)"""
LEVEL_NAME = "CASE level_rank WHEN 3 THEN 'BREACH' WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARN' ELSE 'INFO' END"

TICKS_SQL = """
    ticked AS (
        SELECT *, HOUR_OF(ts) AS tick_start FROM {positions}
        QUALIFY row_number() OVER (PARTITION BY vessel_id, HOUR_OF(ts) ORDER BY ts DESC, event_id DESC) = 1)"""


def proximities(v: Views, include_info: bool = True):
    return ops.fence_proximities(v.spread(v.positions), v.fence_segments, v.fences, include_info)


@query("flagship_hourly_proximity", f"""
WITH {TICKS_SQL}, {nearest_sql('ticked', 'vessel_id, tick_start', False)}, {LEVELS_SQL}
SELECT vessel_id, tick_start, layer, fkey, name, inside, level_rank, {LEVEL_NAME} AS level, severity_rank,
       {r6('distance_nm', 'bearing_deg')} FROM levelled""")
def flagship(v: Views):
    """Closest boundary, distance and alert level for every vessel and hour."""
    hourly = cut_lineage(balanced(ops.latest_per_tick(v.positions, 3600).select("vessel_id", "tick_start", "lat", "lon")))
    near = ops.with_levels(
        nearest_features(hourly, v.fence_segments), v.fences)
    best = ops.nearest_fence_per_vessel(near.select("vessel_id", "tick_start", "layer", "fkey", "name", "inside", "level_rank", "level", "severity_rank", "distance_nm",
                                                    "bearing_deg"), ["vessel_id", "tick_start"])
    return best.select("vessel_id", "tick_start", "layer", "fkey", "name", "inside", "level_rank", "level",
                       "severity_rank", "distance_nm", "bearing_deg")


@query("j1_nearest_fence_per_layer", f"""
WITH {nearest_sql('{positions}', 'event_id')}
SELECT event_id, layer, fkey, inside, {r6('distance_nm', 'bearing_deg', 'closest_lat', 'closest_lon')} FROM best""")
def j1(v: Views):
    return nearest_features(v.spread(v.positions), v.fence_segments).select(
        "event_id", "layer", "fkey", "inside", "distance_nm", "bearing_deg", "closest_lat", "closest_lon")


@query("j1_every_hazard_zone", f"""
WITH {nearest_sql('{positions}', 'event_id').replace("PARTITION BY event_id, layer ", "PARTITION BY event_id, layer, CASE WHEN layer = 'HAZARD_EXCLUSION' THEN fkey END ")}, {LEVELS_SQL}
SELECT event_id, layer, fkey, inside, level_rank, {r6('distance_nm')} FROM levelled WHERE level_rank > 0""")
def j1_zones(v: Views):
    """What each position is warned of: every hazard zone, of the other classes the nearest fence."""
    return ops.alerting_proximities(v.spread(v.positions), v.fence_segments, v.fences).select("event_id", "layer", "fkey", "inside", "level_rank", "distance_nm")


@query("f15_alert_level", f"""
WITH {nearest_sql('{positions}', 'event_id')}, {LEVELS_SQL}
SELECT event_id, layer, fkey, level_rank, {LEVEL_NAME} AS level FROM levelled""")
def f15(v: Views):
    return proximities(v).select("event_id", "layer", "fkey", "level_rank", "level")


@query("t1_proximity_order", f"""
WITH {nearest_sql('{positions}', 'event_id')}, {LEVELS_SQL}
SELECT event_id, layer, fkey, level_rank, severity_rank, round(distance_nm, 6) AS distance_nm
FROM levelled WHERE level_rank > 0
ORDER BY level_rank DESC, severity_rank DESC, distance_nm, fkey""")
def t1(v: Views):
    # Written first, as the bounds of the sort are drawn in a pass of their own; the event parts the many rows at distance 0.
    warned = cut_lineage(proximities(v, include_info=False).select("event_id", "layer", "fkey", "level_rank", "severity_rank", "distance_nm"))
    return warned.orderBy(*ops.proximity_order(), "event_id")


@query("a6_nearest_fence_per_vessel", f"""
WITH {nearest_sql('{positions}', 'event_id', False)}
SELECT event_id, layer, fkey, round(distance_nm, 6) AS distance_nm FROM best""")
def a6(v: Views):
    return ops.nearest_fence_per_vessel(proximities(v).select("event_id", "layer", "fkey", "distance_nm"), ["event_id"])


@query("j4_point_in_polygon", """
SELECT p.event_id, s.layer, s.fkey FROM {positions} p, {fence_segments} s WHERE s.is_polygon
GROUP BY 1, 2, 3
HAVING sum(CASE WHEN (y1>lat) <> (y2>lat) AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END) % 2 = 1""")
def j4(v: Views):
    return polygons_containing(v.positions, v.fence_segments).select("event_id", "layer", "fkey")


PROJECT = """
    stepped AS (
        SELECT b.event_id, b.layer, b.fkey, b.distance_nm, p.lat AS lat0, p.lon AS lon0, p.speed_kn, i,
               p.speed_kn * 1852 * (3600.0 * i / 40) / 3600.0 / 6371008.8 AS reach, radians(p.heading_deg) AS course
        FROM best b JOIN {positions} p USING (event_id), range(1, 41) r(i)
        WHERE p.speed_kn >= 0.5 AND b.distance_nm <= 4.004 * p.speed_kn),
    moved AS (
        SELECT *, asin(sin(radians(lat0))*cos(reach) + cos(radians(lat0))*sin(reach)*cos(course)) AS la FROM stepped),
    tracked AS (
        SELECT event_id, layer, fkey, distance_nm, i, degrees(la) AS lat,
               (degrees(radians(lon0) + atan2(sin(course)*sin(reach)*cos(radians(lat0)), cos(reach) - sin(radians(lat0))*sin(la))) + 540) % 360 - 180 AS lon
        FROM moved),
    step_seg AS (
        SELECT k.*, s.is_polygon, s.x1, s.y1, s.x2, s.y2,
               greatest(0, least(1, ((k.lon-x1)*(x2-x1)+(k.lat-y1)*(y2-y1)) / ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS t
        FROM tracked k JOIN {fence_segments} s ON k.layer = s.layer AND k.fkey = s.fkey),
    step_feat AS (
        SELECT event_id, layer, fkey, i, min(distance_nm) AS d0, min(lat) AS lat, min(lon) AS lon,
               arg_min(x1+t*(x2-x1), pow(lon-(x1+t*(x2-x1)),2)+pow(lat-(y1+t*(y2-y1)),2)) AS qx,
               arg_min(y1+t*(y2-y1), pow(lon-(x1+t*(x2-x1)),2)+pow(lat-(y1+t*(y2-y1)),2)) AS qy,
               bool_or(is_polygon) AND sum(CASE WHEN (y1>lat) <> (y2>lat) AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END) % 2 = 1 AS inside
        FROM step_seg GROUP BY event_id, layer, fkey, i),
    step_d AS (
        SELECT event_id, layer, fkey, i, d0, CASE WHEN inside THEN 0 ELSE """ + hav("lat", "lon", "qy", "qx") + """ END AS d FROM step_feat),
    run AS (
        SELECT *, min(d) OVER w AS best_before FROM step_d
        WINDOW w AS (PARTITION BY event_id, layer, fkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    stops AS (
        SELECT event_id, layer, fkey, min(d0) AS d0,
               min(CASE WHEN d <= 0 THEN i END) AS hit_i,
               min(CASE WHEN best_before < d0 AND d > best_before THEN i END) AS past_i
        FROM run GROUP BY event_id, layer, fkey),
    closest AS (
        SELECT s.event_id, s.layer, s.fkey, s.d0, s.hit_i, s.past_i, min(r.d) AS best, arg_min(r.i, r.d) AS best_i0
        FROM stops s JOIN run r USING (event_id, layer, fkey)
        WHERE r.i < coalesce(s.past_i, 41) GROUP BY ALL),
    etas AS (
        SELECT event_id, layer, fkey,
               CASE WHEN hit_i IS NOT NULL AND hit_i < coalesce(past_i, 41) THEN hit_i * 90.0
                    WHEN best < d0 AND d0 - best > 0.000001 AND (d0 - best) / (best_i0 * 90.0 / 3600) >= 0.25
                         AND d0 / ((d0 - best) / (best_i0 * 90.0 / 3600)) * 3600 <= 14400
                    THEN d0 / ((d0 - best) / (best_i0 * 90.0 / 3600)) * 3600 END AS eta_s
        FROM closest)"""


@query("w6_closing_eta", f"""
WITH {nearest_sql('{positions}', 'event_id')}, {PROJECT}
SELECT b.event_id, b.layer, b.fkey, round(eta_s, 6) AS eta_s
FROM best b LEFT JOIN etas e ON b.event_id = e.event_id AND b.layer = e.layer AND b.fkey = e.fkey""")
def w6(v: Views):
    near = proximities(v).select("event_id", "layer", "fkey", "lat", "lon", "heading_deg", "speed_kn", "distance_nm", "closest_lat", "closest_lon")
    return ops.closing_eta(near, v.fence_segments, ["event_id"]).select("event_id", "layer", "fkey", "eta_s")


WANTED = "CASE event_id % 4 WHEN 1 THEN {a}'MPA', 'ECO_SENSITIVE'{z} WHEN 2 THEN {a}'IMBL_HISTORIC_WATERS', 'HAZARD_EXCLUSION'{z} WHEN 3 THEN {a}'ECO_SENSITIVE'{z} END"
_EACH = nearest_sql("{positions}", "event_id").replace("PARTITION BY event_id, layer ", "PARTITION BY event_id, layer, CASE WHEN layer = 'HAZARD_EXCLUSION' THEN fkey END ").replace(
    "{fence_segments} s", "(SELECT * FROM {fence_segments} WHERE layer <> 'ECO_SENSITIVE') s")


@query("tool_check_geofences", f"""
WITH {_EACH}, {LEVELS_SQL}, {PROJECT},
asked AS (SELECT event_id, {WANTED.format(a='[', z=']')} AS wanted FROM {{positions}}),
hits AS (SELECT l.event_id, count(*) AS n, max(level_rank) AS level_rank, string_agg(DISTINCT l.layer, ',' ORDER BY l.layer) AS classes, min(l.distance_nm) AS nm, min(e.eta_s) AS eta_s
         FROM levelled l JOIN asked a USING (event_id) LEFT JOIN etas e ON e.event_id = l.event_id AND e.layer = l.layer AND e.fkey = l.fkey
         WHERE level_rank > 0 AND (wanted IS NULL OR list_contains(wanted, l.layer)) GROUP BY l.event_id),
req AS (SELECT event_id, list_filter(['ECO_SENSITIVE', 'IMBL_HISTORIC_WATERS', 'IMBL_MARITIME_BOUNDARY', 'MPA'], lambda c: wanted IS NULL OR list_contains(wanted, c)) AS required FROM asked),
st AS (SELECT event_id, list_contains(required, 'ECO_SENSITIVE') AS gap, len(list_filter(required, lambda c: c <> 'ECO_SENSITIVE')) > 0 AS can FROM req)
SELECT event_id, CASE WHEN NOT can THEN 'abstain' WHEN gap THEN 'partial' ELSE 'checked' END AS status, CAST(CASE WHEN can THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS n_found,
       CASE WHEN can THEN CASE coalesce(level_rank, 0) WHEN 3 THEN 'BREACH' WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARN' ELSE 'INFO' END END AS worst_level,
       CASE WHEN can THEN coalesce(classes, '') END AS classes_present, round(CASE WHEN can THEN nm END, 6) AS nearest_nm, round(CASE WHEN can THEN eta_s END, 6) AS eta_s,
       CASE WHEN gap THEN 'ECO_SENSITIVE' ELSE '' END AS unchecked, false AS hard_gap
FROM st LEFT JOIN hits USING (event_id)""")
def check_geofences(v: Views):
    """Every position asked for some classes, while one advisory layer has not been loaded."""
    requests = v.spread(v.positions).withColumn("wanted", F.expr(WANTED.format(a="array(", z=")")))
    return tools.check_geofences(requests, v.fence_segments.where("layer <> 'ECO_SENSITIVE'"), v.fences, "event_id")
