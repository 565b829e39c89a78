"""Nearest-port, directory, time and grid joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia import dims
from pelagia.functions import geo, marine
from pelagia.operators import fences as fence_ops, joins
from pelagia.plans.asof import nearest_time
from pelagia.plans.spatial import nearest_features
from pelagia.workload.queries_fences import brg, hav, nearest_sql
from pelagia.workload.registry import query, r6
from pelagia.workload.views import Views

LAT_AXIS, LON_AXIS = (8.0, 0.07, 40), (78.0, 0.05, 50)

def in_every_slice(points, v: Views):
    """Each point once for every slice of the grid; slices are as few as the products loaded."""
    names = sorted(r[0] for r in v.grid_cells.select("slice").distinct().collect())
    return points.withColumn("slice", F.explode(F.array(*map(F.lit, names)).cast("array<string>")))


PORT_RANKS = f"""
    d AS (SELECT r.request_id, r.lat AS rlat, r.lon AS rlon, p.*, {hav('r.lat', 'r.lon', 'p.lat', 'p.lon')} AS nm
          FROM {{requests}} r, {{ports}} p),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(nm, 9), port_id) AS INT) AS rnk FROM d)"""


@query("j2_k_nearest_ports", f"""
WITH {PORT_RANKS} SELECT request_id, port_id, rnk AS rank, district AS port_district, round(nm, 6) AS distance_nm,
round(CASE WHEN nm > 0.000001 THEN {brg('rlat', 'rlon', 'lat', 'lon')} END, 6) AS bearing_deg FROM k WHERE rnk <= 5""")
def j2(v: Views):
    return joins.nearest_ports(v.spread(v.requests), v.ports, "request_id", 5).select(
        "request_id", "port_id", "rank", "port_district", "distance_nm", "bearing_deg")


@query("j2_nearest_zone_line", f"""
WITH v AS (SELECT lat, lon, min(fkey) AS line_id FROM (SELECT fkey, y1 AS lat, x1 AS lon FROM {{fence_segments}} WHERE NOT is_polygon UNION ALL SELECT fkey, y2, x2 FROM {{fence_segments}} WHERE NOT is_polygon) GROUP BY 1, 2),
d AS (SELECT r.request_id, r.lat AS rlat, r.lon AS rlon, v.*, {hav('r.lat', 'r.lon', 'v.lat', 'v.lon')} AS nm FROM {{requests}} r, v QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(nm, 9), v.lat, v.lon) = 1)
SELECT request_id, line_id, round(nm, 3) AS distance_nm, round({brg('rlat', 'rlon', 'lat', 'lon')}, 1) AS bearing_deg, {r6('lat', 'lon')} FROM d""")
def j2_lines(v: Views):
    found = joins.nearest_line_vertex(v.spread(v.requests).select("request_id", "lat", "lon"), v.fence_segments.where("NOT is_polygon"))
    return found.select("request_id", "line_id", "distance_nm", "bearing_deg", F.col("closest_lat").alias("lat"), F.col("closest_lon").alias("lon"))


#: Readings of the stations, which stand at the ports.
_STATION_READINGS = "SELECT location_id AS station_id, variable, valid_time, value_num AS value FROM {observations} WHERE source_id IS NOT NULL"


@query("j2_nearest_stations", f"""
WITH {PORT_RANKS}, o AS (SELECT station_id, variable, max(valid_time) AS valid_time, arg_max(value, (valid_time, value)) AS value FROM ({_STATION_READINGS}) q WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT request_id, port_id AS station_id, rnk AS rank, round(nm, 6) AS distance_nm, variable, valid_time, round(value, 6) AS value FROM k LEFT JOIN o ON o.station_id = k.port_id WHERE rnk <= 5""")
def j2_stations(v: Views):
    stations = v.ports.select(F.col("port_id").alias("station_id"), "lat", "lon")
    return joins.nearest_stations(v.spread(v.requests).select("request_id", "lat", "lon"), stations, v.sql(_STATION_READINGS), 5).select(
        "request_id", "station_id", "rank", "distance_nm", "variable", "valid_time", "value")


@query("j2_region_first", f"""
WITH r AS (SELECT *, CAST(request_id % 6 AS INT) AS zone FROM {{requests}}), z AS (SELECT DISTINCT zone FROM {{ports}}),
d AS (SELECT r.request_id, p.port_id, z.zone IS NULL AS widened, {hav('r.lat', 'r.lon', 'p.lat', 'p.lon')} AS nm FROM r LEFT JOIN z ON z.zone = r.zone JOIN {{ports}} p ON z.zone IS NULL OR p.zone = r.zone)
SELECT request_id, port_id, widened, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(nm, 9), port_id) AS INT) AS rank, round(nm, 6) AS distance_nm FROM d
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(nm, 9), port_id) <= 3""")
def j2_regions(v: Views):
    asked = v.spread(v.requests).select("request_id", "lat", "lon", (F.col("request_id") % 6).cast("int").alias("zone"))
    return joins.nearest_in_region(asked, v.ports.select("port_id", "lat", "lon", F.col("zone").cast("int").alias("zone")), "zone", "port_id").select(
        "request_id", "port_id", "widened", "rank", "distance_nm")


@query("j3_nearest_port_district", f"WITH {PORT_RANKS} SELECT request_id, port_id, district AS port_district FROM k WHERE rnk = 1")
def j3(v: Views):
    return joins.nearest_ports(v.spread(v.requests), v.ports, "request_id", 1).select("request_id", "port_id", "port_district")


@query("j5_bucketed_spatial_join", f"""
WITH {nearest_sql('{positions}', 'event_id')}
SELECT event_id, layer, fkey, inside, {r6('distance_nm')} FROM best""")
def j5(v: Views):
    """The shuffled form used when the candidate list is too large to broadcast."""
    return nearest_features(v.spread(v.positions.select("event_id", "lat", "lon")), v.fence_segments, broadcast_rows=0).select(
        "event_id", "layer", "fkey", "inside", "distance_nm")


@query("j6_directory_lookup", """
WITH a AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_name || ' (closed)' END AS name, '+91 ' || CAST(s_suppkey AS VARCHAR(10)) AS contact, s_suppkey % 2 = 0 AS verified FROM {supplier}),
b AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || ' (old)' END AS district, '+92 ' || CAST(n_nationkey AS VARCHAR(10)) AS contact, n_nationkey % 4 = 0 AS verified FROM {nation})
SELECT port_id, CASE WHEN a.contact IS NOT NULL THEN 'centre' WHEN b.contact IS NOT NULL THEN 'district' END AS matched_by,
       coalesce(CASE WHEN a.contact IS NOT NULL THEN a.verified ELSE b.verified END, false) AS verified,
       CASE WHEN CASE WHEN a.contact IS NOT NULL THEN a.verified ELSE b.verified END THEN coalesce(a.contact, b.contact) END AS contact
FROM {ports} p LEFT JOIN a USING (name) LEFT JOIN b USING (district)""")
def j6(v: Views):
    renamed = lambda c, keep, tail: F.when(keep, F.col(c)).otherwise(F.concat(F.col(c), F.lit(tail)))
    own = v.supplier.select(
        renamed("s_name", F.col("s_suppkey") % 3 == 0, " (closed)").alias("name"), F.concat(F.lit("+91 "), F.col("s_suppkey").cast("string")).alias("contact"),
        (F.col("s_suppkey") % 2 == 0).alias("verified"))
    area = v.nation.select(
        renamed("n_name", F.col("n_nationkey") % 2 == 0, " (old)").alias("district"), F.concat(F.lit("+92 "), F.col("n_nationkey").cast("string")).alias("contact"),
        (F.col("n_nationkey") % 4 == 0).alias("verified"))
    return joins.directory_lookup(v.ports, own, area).select("port_id", "matched_by", "verified", "contact")


_PRESENT = """(SELECT user_id, CASE event_type WHEN 'view' THEN 'IMBL_HISTORIC_WATERS' WHEN 'click' THEN 'IMBL_MARITIME_BOUNDARY'
    WHEN 'purchase' THEN 'MPA' WHEN 'signup' THEN 'ECO_SENSITIVE' ELSE 'USER_DEFINED' END AS layer, DAY_OF(ts) AS day FROM {events})"""


@query("j7_class_coverage", f"""
WITH p AS (SELECT DISTINCT user_id || '/' || CAST(CAST(day AS DATE) AS VARCHAR) AS scan, layer FROM {_PRESENT} x),
every AS (SELECT * FROM (VALUES ('ECO_SENSITIVE', false), ('HAZARD_EXCLUSION', false), ('IMBL_HISTORIC_WATERS', true),
          ('IMBL_MARITIME_BOUNDARY', true), ('MPA', false)) t(c, legal)),
have AS (SELECT scan, layer FROM p WHERE layer <> 'USER_DEFINED'), scans AS (SELECT DISTINCT scan FROM p)
SELECT s.scan, coalesce(string_agg(c, ',' ORDER BY c), '') AS unchecked, bool_or(legal) AS hard_gap,
       CASE WHEN count(*) = 5 THEN 'abstain' WHEN count(*) > 0 THEN 'partial' ELSE 'checked' END AS status
FROM scans s, every e WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.scan = s.scan AND h.layer = e.c) GROUP BY s.scan""")
def j7(v: Views):
    present = v.sql(_PRESENT.strip()[1:-1]).select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("day", "yyyy-MM-dd")).alias("scan"), "layer")
    return fence_ops.class_coverage(present, "scan")


_FILES = """(SELECT DISTINCT event_type AS product, ADDS(DAY_OF(ts); (user_id % 3) * 21600) AS file_time FROM {events})"""
_TARGETS = """(SELECT event_id, event_type AS product, ADDS(ts; -43200) AS target FROM {events})"""


@query("j8_latest_file_asof", f"""
WITH f AS {_FILES}, t AS {_TARGETS},
b AS (SELECT t.event_id, t.product, f.file_time FROM t ASOF LEFT JOIN f ON t.product = f.product AND t.target >= f.file_time),
n AS (SELECT product, max(file_time) AS newest FROM f GROUP BY 1)
SELECT event_id, coalesce(file_time, newest) AS file_time, file_time IS NULL AS fell_back FROM b LEFT JOIN n USING (product)""")
def j8(v: Views):
    return joins.latest_file(v.sql(_TARGETS.strip()[1:-1]), v.sql(_FILES.strip()[1:-1]), ["product"], "target", "file_time") \
        .select("event_id", "file_time", "fell_back")


_SLICES = """(SELECT DISTINCT event_type AS product, HOUR_OF(ts) AS valid_time FROM {events})"""


@query("j9_nearest_time_slice", f"""
WITH s AS {_SLICES}, t AS {_TARGETS}
SELECT event_id, arg_min(valid_time, (abs(epoch_us(target) - epoch_us(valid_time)), valid_time)) FILTER
       (WHERE abs(epoch_us(target) - epoch_us(valid_time)) <= 21600000000) AS valid_time
FROM t JOIN s USING (product) GROUP BY event_id""")
def j9(v: Views):
    got = nearest_time(v.sql(_TARGETS.strip()[1:-1]), v.sql(_SLICES.strip()[1:-1]), ["product"], "target", "valid_time", [], 6 * 3600)
    return got.select("event_id", F.col("match.match_time").alias("valid_time"))


@query("j10_nearest_cell", f"""
WITH a AS (SELECT event_id, slice, lat, lon, greatest(0, least(39, CAST(ceil((lat - 8.0::DOUBLE) / 0.07::DOUBLE - 0.5) AS INT))) AS i,
                  greatest(0, least(49, CAST(ceil((lon - 78.0::DOUBLE) / 0.05::DOUBLE - 0.5) AS INT))) AS j FROM {{positions}}, (SELECT DISTINCT slice FROM {{grid_cells}}) s)
SELECT event_id, a.slice, a.i, a.j, round(value, 6) AS cell_value, round({hav('a.lat', 'a.lon', '(8.0 + a.i * 0.07)', '(78.0 + a.j * 0.05)')}, 6) AS cell_nm
FROM a LEFT JOIN {{grid_cells}} g ON g.slice = a.slice AND g.i = a.i AND g.j = a.j""")
def j10(v: Views):
    found = joins.nearest_cell(in_every_slice(v.positions, v), v.grid_cells, ["slice"], LAT_AXIS, LON_AXIS)
    return found.select("event_id", "slice", "i", "j", "cell_value", "cell_nm")


@query("j11_bulletin_for_request", """
WITH b AS (SELECT 'NATION_' || CAST(block_id AS VARCHAR(5)) AS area, * FROM {bulletins}),
f AS (SELECT area, arg_min(sea_condition, bulletin_id) FILTER (WHERE sea_condition IS NOT NULL) AS sea_condition,
             arg_min(port_signal, bulletin_id) FILTER (WHERE port_signal IS NOT NULL) AS port_signal,
             arg_min(storm_surge_warning, bulletin_id) FILTER (WHERE storm_surge_warning IS NOT NULL) AS storm_surge_warning,
             min_by(bulletin_id, bulletin_id) AS first_id FROM b GROUP BY area)
SELECT request_id, f.sea_condition, f.port_signal, f.storm_surge_warning, x.valid_from, x.valid_to
FROM {requests} r LEFT JOIN f ON f.area = r.district LEFT JOIN b x ON x.bulletin_id = f.first_id""")
def j11(v: Views):
    area = v.bulletins.drop("district").withColumn("district", F.concat(F.lit("NATION_"), F.col("block_id").cast("string")))
    return joins.bulletin_for(v.requests, area, "district").select(
        "request_id", "sea_condition", "port_signal", "storm_surge_warning", "valid_from", "valid_to")


@query("j13_contour_depth", """
WITH c AS (SELECT s.fkey, CASE WHEN s.fkey % 3 = 0 THEN s.fkey * 2.5::DOUBLE WHEN s.fkey % 3 = 1 THEN s.fkey * 1.5::DOUBLE END AS depth_m,
                  s.x1, s.y1, s.x2, s.y2 FROM {fence_segments} s),
t AS (SELECT p.event_id, p.lat, p.lon, c.*, greatest(0, least(1, ((lon-x1)*(x2-x1)+(lat-y1)*(y2-y1)) / ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS t
      FROM {positions} p, c WHERE depth_m IS NOT NULL),
d AS (SELECT event_id, fkey, depth_m, min(sqrt(pow(lon-(x1+t*(x2-x1)),2)+pow(lat-(y1+t*(y2-y1)),2))) AS d FROM t GROUP BY ALL)
SELECT event_id, fkey, round(depth_m, 6) AS depth_m FROM d QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(d, 9), fkey) = 1""")
def j13(v: Views):
    k = F.col("fkey")
    depths = v.fences.select("fkey", F.when(k % 3 == 0, (k * F.lit(2.5)).cast("string")).when(k % 3 == 2, "unknown").alias("depth_1"),
                             F.when(k % 3 == 1, (k * F.lit(1.5)).cast("string")).alias("depth_2"))
    return joins.contour_depth(v.spread(v.positions.select("event_id", "lat", "lon")), v.fence_segments, depths, "event_id").select(
        "event_id", "fkey", "depth_m")


@query("t3_handoff_with_alternates", f"""
WITH {PORT_RANKS}
SELECT request_id, max(CASE WHEN rnk = 1 THEN port_id END) AS handoff_id, round(max(CASE WHEN rnk = 1 THEN nm END), 6) AS handoff_nm,
       round(max(CASE WHEN rnk = 1 AND nm > 0.000001 THEN {brg('rlat', 'rlon', 'lat', 'lon')} END), 6) AS handoff_bearing,
       max(CASE WHEN rnk = 1 THEN district END) AS handoff_district, max(CASE WHEN rnk = 2 THEN port_id END) AS alternate_1,
       max(CASE WHEN rnk = 3 THEN port_id END) AS alternate_2 FROM k GROUP BY request_id""")
def t3(v: Views):
    return joins.handoff(v.spread(v.requests), v.ports, "request_id")


@query("t2_nearest_n_ranking", f"""
WITH {nearest_sql('{positions}', 'event_id', False)}
SELECT event_id, layer, round(distance_nm, 6) AS distance_nm FROM best ORDER BY round(distance_nm, 9), event_id LIMIT 50""")
def t2(v: Views):
    """Fleet ranking by distance, the 50 nearest."""
    near = nearest_features(v.spread(v.positions), v.fence_segments)
    best = fence_ops.nearest_fence_per_vessel(near.select("event_id", "layer", "fkey", "distance_nm"), ["event_id"])
    return best.orderBy(F.round("distance_nm", 9), "event_id").limit(50).select("event_id", "layer", "distance_nm")


@query("t5_boat_top_three", f"""
WITH {nearest_sql('{positions}', 'event_id')}, levels AS (
    SELECT b.*, CASE WHEN inside THEN 3 WHEN distance_nm <= coalesce(f.own_critical_nm, c.critical_nm) THEN 2
           WHEN distance_nm <= coalesce(f.own_warn_nm, c.warn_nm) THEN 1 ELSE 0 END AS level_rank
    FROM best b JOIN {{fences}} f ON b.layer = f.layer AND b.fkey = f.fkey
    JOIN ({dims.rows_sql(dims.FENCE_CLASSES, dims.FENCE_COLUMNS)}) c ON c.fence_class = b.layer)
SELECT event_id, layer, fkey, CAST(level_rank AS INT) AS level_rank, CAST(row_number() OVER (PARTITION BY event_id ORDER BY level_rank DESC, round(distance_nm, 9), layer, fkey) AS INT) AS place
FROM levels QUALIFY place <= 3""")
def t5(v: Views):
    prox = fence_ops.fence_proximities(v.spread(v.positions), v.fence_segments, v.fences)
    return fence_ops.top_three(prox.select("event_id", "layer", "fkey", "level_rank", "distance_nm"), ["event_id"]).select(
        "event_id", "layer", "fkey", "level_rank", F.col("rank").alias("place"))


@query("t7_offline_nearest_list", f"""
WITH {nearest_sql('{positions}', 'event_id')}, levels AS (
    SELECT b.*, p.speed_kn, CASE WHEN inside THEN 3 WHEN distance_nm <= coalesce(f.own_critical_nm, c.critical_nm) THEN 2
           WHEN distance_nm <= coalesce(f.own_warn_nm, c.warn_nm) THEN 1 ELSE 0 END AS level_rank
    FROM best b JOIN {{fences}} f ON b.layer = f.layer AND b.fkey = f.fkey JOIN {{positions}} p USING (event_id)
    JOIN ({dims.rows_sql(dims.FENCE_CLASSES, dims.FENCE_COLUMNS)}) c ON c.fence_class = b.layer)
SELECT event_id, layer, fkey, round(distance_nm, 2) AS shown_nm,
       round(CASE WHEN speed_kn > 0 THEN distance_nm / speed_kn * 3600 END, 6) AS simple_eta_s FROM levels WHERE level_rank > 0""")
def t7(v: Views):
    prox = fence_ops.fence_proximities(v.spread(v.positions), v.fence_segments, v.fences)
    return fence_ops.simple_eta_list(prox).select("event_id", "layer", "fkey", "shown_nm", "simple_eta_s")
