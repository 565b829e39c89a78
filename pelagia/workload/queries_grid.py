"""Grid and zone queries over the derived lattice (40 x 50 cells per slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia import dims
from pelagia.operators import grid as ops, joins
from pelagia.workload.queries_fences import brg, hav
from pelagia.workload.queries_joins import LAT_AXIS, LON_AXIS, in_every_slice
from pelagia.workload.registry import query, r6
from pelagia.workload.views import Views

H, W, TILE = 40, 50, 16
M = "(6371008.8 * pi() / 180)"

GRADIENT = """
    gs AS (SELECT c.*, n.{v} AS vn, s.{v} AS vs, e.{v} AS ve, w.{v} AS vw, n.lat AS ln, s.lat AS ls, e.lon AS le, w.lon AS lw
           FROM {{grid_cells}} c LEFT JOIN {{grid_cells}} n ON n.slice = c.slice AND n.i = c.i + 1 AND n.j = c.j
           LEFT JOIN {{grid_cells}} s ON s.slice = c.slice AND s.i = c.i - 1 AND s.j = c.j
           LEFT JOIN {{grid_cells}} e ON e.slice = c.slice AND e.i = c.i AND e.j = c.j + 1
           LEFT JOIN {{grid_cells}} w ON w.slice = c.slice AND w.i = c.i AND w.j = c.j - 1),
    gd AS (SELECT *, CASE WHEN i = 0 THEN (vn - {v}) / (ln - lat) WHEN i = 39 THEN ({v} - vs) / (lat - ls) ELSE
                  (pow(lat-ls,2)*vn + (pow(ln-lat,2)-pow(lat-ls,2))*{v} - pow(ln-lat,2)*vs) / ((lat-ls)*(ln-lat)*(ln-ls)) END AS dla,
                  CASE WHEN j = 0 THEN (ve - {v}) / (le - lon) WHEN j = 49 THEN ({v} - vw) / (lon - lw) ELSE
                  (pow(lon-lw,2)*ve + (pow(le-lon,2)-pow(lon-lw,2))*{v} - pow(le-lon,2)*vw) / ((lon-lw)*(le-lon)*(le-lw)) END AS dlo FROM gs),
    {name} AS (SELECT slice, i, j, lat, lon, value, chl, 1000 * sqrt(pow(dlo / (6371008.8 * pi() / 180 * cos(radians(lat))), 2) + pow(dla / (6371008.8 * pi() / 180), 2)) AS gradient FROM gd)"""
FRONT = GRADIENT.format(v="value", name="grad").replace("{{", "{").replace("}}", "}")
CHL_FRONT = GRADIENT.format(v="chl", name="cgrad").replace("{{", "{").replace("}}", "}") \
    .replace("gs AS", "cgs AS").replace("gd AS", "cgd AS").replace("FROM gs", "FROM cgs").replace("FROM gd", "FROM cgd")
MASK = """
    cut AS (SELECT slice, quantile_cont(gradient, 0.85) AS thr FROM grad WHERE gradient IS NOT NULL GROUP BY 1),
    mask AS (SELECT g.* FROM grad g JOIN cut USING (slice) WHERE round(gradient, 9) >= round(thr, 9))"""
LABELS = """
    lab(slice, i, j, label) USING KEY (slice, i, j) AS (
        SELECT slice, i, j, i * 50 + j FROM mask
        UNION
        SELECT n.slice, n.i, n.j, min(t.label) FROM lab t JOIN mask n ON n.slice = t.slice AND abs(n.i - t.i) + abs(n.j - t.j) = 1
        LEFT JOIN recurring.lab r ON r.slice = n.slice AND r.i = n.i AND r.j = n.j WHERE t.label < r.label GROUP BY 1, 2, 3),
    zones AS (SELECT m.*, l.label FROM mask m JOIN lab l USING (slice, i, j) WHERE (l.slice, l.label) IN (SELECT (slice, label) FROM lab GROUP BY slice, label HAVING count(*) >= 4))"""


def zones(v: Views):
    return ops.front_zones(v.grid_cells, ["slice"], H, W, TILE)


@query("g1_point_sample", f"""
WITH a AS (SELECT port_id, lat, lon, greatest(0, least(39, CAST(ceil((lat - 8.0::DOUBLE) / 0.07::DOUBLE - 0.5) AS INT))) AS i,
                  greatest(0, least(49, CAST(ceil((lon - 78.0::DOUBLE) / 0.05::DOUBLE - 0.5) AS INT))) AS j FROM {{ports}})
SELECT port_id, slice, round(value, 6) AS cell_value, round({hav('a.lat', 'a.lon', '(8.0 + a.i * 0.07)', '(78.0 + a.j * 0.05)')}, 6) AS cell_nm
FROM a LEFT JOIN {{grid_cells}} g ON g.i = a.i AND g.j = a.j""")
def g1(v: Views):
    cells = v.grid_cells.select("i", "j", F.struct("slice", "value").alias("value"))
    got = joins.nearest_cell(v.ports, cells, [], LAT_AXIS, LON_AXIS)
    return got.select("port_id", F.col("cell_value.slice").alias("slice"), F.col("cell_value.value").alias("cell_value"), "cell_nm")


_TARGET = "(SELECT slice, k.i AS ti, k.j AS tj, (803 + k.i * 13) / 100 AS lat, (7801 + k.j * 11) / 100 AS lon FROM (SELECT DISTINCT l_returnflag AS slice FROM {lineitem}) s, (SELECT DISTINCT CAST(l_orderkey % 20 AS INT) AS i, CAST(l_partkey % 22 AS INT) AS j FROM {lineitem}) k)"


@query("g2_regrid_nearest", f"""
WITH t AS {_TARGET},
ai AS (SELECT slice, ti, arg_min(g.i, (round(abs(g.lat - t.lat), 9), g.lat)) AS i FROM (SELECT DISTINCT slice, ti, lat FROM t) t JOIN (SELECT DISTINCT slice, i, lat FROM {{grid_cells}}) g USING (slice) GROUP BY 1, 2),
aj AS (SELECT slice, tj, arg_min(g.j, (round(abs(g.lon - t.lon), 9), g.lon)) AS j FROM (SELECT DISTINCT slice, tj, lon FROM t) t JOIN (SELECT DISTINCT slice, j, lon FROM {{grid_cells}}) g USING (slice) GROUP BY 1, 2)
SELECT t.slice, t.ti, t.tj, round(g.value, 6) AS value FROM t JOIN ai USING (slice, ti) JOIN aj USING (slice, tj) LEFT JOIN {{grid_cells}} g ON g.slice = t.slice AND g.i = ai.i AND g.j = aj.j""")
def g2(v: Views):
    # The target lattice: every slice with the distinct target rows and columns.
    keys = v.lineitem.select(F.col("l_returnflag").alias("slice")).distinct()
    idx = v.lineitem.select((F.col("l_orderkey") % 20).cast("int").alias("ti"), (F.col("l_partkey") % 22).cast("int").alias("tj")).distinct()
    slices = F.array(*[F.lit(s) for s in ("A", "N", "R")])
    target = idx.withColumn("slice", F.explode(slices)).join(keys, "slice", "left_semi").withColumns(
        {"lat": (803 + F.col("ti") * 13) / 100, "lon": (7801 + F.col("tj") * 11) / 100})
    return ops.regrid(v.grid_cells, target, ["slice"]).select("slice", "ti", "tj", "value")


@query("g3_bilinear_sample", """
WITH r AS (SELECT event_id, slice, greatest(0, least(39, (lat - 8.0::DOUBLE) / 0.07::DOUBLE)) AS y, greatest(0, least(49, (lon - 78.0::DOUBLE) / 0.05::DOUBLE)) AS x FROM {positions}, (SELECT DISTINCT slice FROM {grid_cells}) g),
b AS (SELECT event_id, slice, least(38, CAST(floor(y) AS INT)) AS i, least(48, CAST(floor(x) AS INT)) AS j, y - least(38, CAST(floor(y) AS INT)) AS ty, x - least(48, CAST(floor(x) AS INT)) AS tx FROM r),
s AS (SELECT b.*, p.value AS v00, q.value AS v01, u.value AS v10, w.value AS v11 FROM b
 LEFT JOIN {grid_cells} p ON p.slice=b.slice AND p.i=b.i AND p.j=b.j LEFT JOIN {grid_cells} q ON q.slice=b.slice AND q.i=b.i AND q.j=b.j+1
 LEFT JOIN {grid_cells} u ON u.slice=b.slice AND u.i=b.i+1 AND u.j=b.j LEFT JOIN {grid_cells} w ON w.slice=b.slice AND w.i=b.i+1 AND w.j=b.j+1)
SELECT event_id, slice, round(coalesce((1-ty)*(1-tx)*v00 + (1-ty)*tx*v01 + ty*(1-tx)*v10 + ty*tx*v11,
       CASE WHEN ty > 0.5 THEN CASE WHEN tx > 0.5 THEN v11 ELSE v10 END ELSE CASE WHEN tx > 0.5 THEN v01 ELSE v00 END END), 6) AS sample FROM s""")
def g3(v: Views):
    return ops.bilinear(in_every_slice(v.positions, v), v.grid_cells, "event_id", LAT_AXIS, LON_AXIS, keys=("slice",))


@query("g4_gradient_per_km", f"WITH {FRONT} SELECT slice, i, j, round(gradient, 6) AS gradient FROM grad")
def g4(v: Views):
    return ops.gradient(v.grid_cells, ["slice"], "value", H, W).select("slice", "i", "j", "gradient")


@query("g5_percentile_mask", f"WITH {FRONT}, {MASK} SELECT slice, i, j, round(gradient, 6) AS gradient FROM mask")
def g5(v: Views):
    steep = ops.gradient(v.grid_cells, ["slice"], "value", H, W).where("gradient IS NOT NULL")
    return ops.percentile_mask(steep, ["slice"], "gradient", ops.FRONT_PERCENTILE).select("slice", "i", "j", "gradient")


@query("g6_connected_components", f"WITH RECURSIVE {FRONT}, {MASK}, {LABELS} SELECT slice, i, j, CAST(label AS BIGINT) AS label FROM zones")
def g6(v: Views):
    return zones(v).select("slice", "i", "j", "label")


@query("g7_zone_statistics", f"""
WITH RECURSIVE {FRONT}, {MASK}, {LABELS}, {CHL_FRONT},
ccut AS (SELECT slice, quantile_cont(gradient, 0.85) AS thr FROM cgrad WHERE gradient IS NOT NULL GROUP BY 1),
st AS (SELECT z.slice, z.label, count(*) AS n_cells, sum(radians(0.07) * 6371008.8 * radians(0.05) * 6371008.8 * cos(radians(z.lat))) / 1000000 AS area_km2,
  avg(z.value) AS mean_sst, avg(z.gradient) AS mean_gradient, avg(z.lat) AS centroid_lat, avg(z.lon) AS centroid_lon, avg(z.chl) AS mean_chl,
  coalesce(round(max(c.gradient), 9) >= round(max(thr), 9), false) AS front_confirmed
  FROM zones z LEFT JOIN cgrad c ON c.slice = z.slice AND c.i = z.i AND c.j = z.j LEFT JOIN ccut ON ccut.slice = z.slice GROUP BY 1, 2)
SELECT slice, CAST(label AS BIGINT) AS label, n_cells, round(area_km2, 4) AS area_km2, {r6('mean_sst', 'mean_gradient', 'centroid_lat', 'centroid_lon', 'mean_chl')},
       front_confirmed, round({hav('9.2876', '79.3129', 'centroid_lat', 'centroid_lon')}, 6) AS distance_nm FROM st""")
def g7(v: Views):
    chl = ops.gradient(v.grid_cells, ["slice"], "chl", H, W, "chl_gradient")
    labelled = zones(v).join(v.grid_cells.select("slice", "i", "j", "chl"), ["slice", "i", "j"])
    stats = ops.zone_stats(labelled, v.grid_cells, ["slice"], 9.2876, 79.3129, chl_front=chl)
    return stats.select("slice", "label", "n_cells", F.round("area_km2", 4).alias("area_km2"), "mean_sst", "mean_gradient",
                        "centroid_lat", "centroid_lon", "mean_chl", "front_confirmed", "distance_nm")


TWO = """
    tcut AS (SELECT slice, quantile_cont(chl, 0.80) AS thr FROM {grid_cells} GROUP BY 1),
    mask AS (SELECT g.* FROM {grid_cells} g JOIN tcut USING (slice) WHERE round(chl, 9) >= round(thr, 9) AND value BETWEEN 26 AND 30.5)"""


@query("g8_two_signal_mask", f"WITH {TWO} SELECT slice, i, j FROM mask")
def g8(v: Views):
    return ops.two_signal_mask(v.grid_cells, ["slice"], "value", "chl").select("slice", "i", "j")


@query("g8_productive_zones", f"""
WITH RECURSIVE {TWO}, {LABELS}
SELECT slice, CAST(label AS BIGINT) AS label, count(*) AS n_cells, round(avg(lat), 6) AS centroid_lat, round(avg(lon), 6) AS centroid_lon FROM zones GROUP BY 1, 2""")
def g8z(v: Views):
    """Productive waters: two-signal mask labelled into zones."""
    mask = ops.two_signal_mask(v.grid_cells, ["slice"], "value", "chl").drop("threshold")
    return ops.label_zones(mask, ["slice"], W, TILE).groupBy("slice", "label").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"))


@query("g9_zone_outline", f"""
WITH RECURSIVE {FRONT}, {MASK}, {LABELS},
e AS (SELECT slice, label, 'h' AS side, i, j FROM zones UNION ALL SELECT slice, label, 'h', i + 1, j FROM zones
      UNION ALL SELECT slice, label, 'v', i, j FROM zones UNION ALL SELECT slice, label, 'v', i, j + 1 FROM zones)
SELECT slice, CAST(label AS BIGINT) AS label, side, i, j FROM e GROUP BY ALL HAVING count(*) = 1""")
def g9(v: Views):
    return ops.zone_outline(zones(v), ["slice"])


_LONG = "(SELECT slice, lat, lon, value FROM {grid_cells} WHERE slice <> 'N' OR i <> 7 OR j <> 11)"


@query("g10_complete_lattice", f"""
WITH r AS {_LONG}, s AS (SELECT slice, count(DISTINCT lat) AS n_lat, count(DISTINCT lon) AS n_lon, count(*) AS n_rows FROM r GROUP BY 1)
SELECT r.slice, CAST(dense_rank() OVER (PARTITION BY r.slice ORDER BY lat) - 1 AS INT) AS i, CAST(dense_rank() OVER (PARTITION BY r.slice ORDER BY lon) - 1 AS INT) AS j, round(value, 6) AS value
FROM r JOIN s USING (slice) WHERE n_lat * n_lon = n_rows""")
def g10(v: Views):
    cells, _ = ops.complete_lattice(v.sql(_LONG.strip()[1:-1]), ["slice"], "value")
    return cells.select("slice", "i", "j", "value")


@query("g11_cell_centres", """
WITH b AS (SELECT zone, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM {ports} GROUP BY 1),
n AS (SELECT *, greatest(2, CAST(round_even((b - a) / 0.1, 0) AS INT)) AS ny, greatest(2, CAST(round_even((d - c) / 0.1, 0) AS INT)) AS nx FROM b)
SELECT zone, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(a + (b - a) * (i + 0.5) / ny, 6) AS lat, round(c + (d - c) * (j + 0.5) / nx, 6) AS lon
FROM n, range(0, 400) r(i), range(0, 400) q(j) WHERE i < ny AND j < nx""")
def g11(v: Views):
    boxes = v.ports.groupBy("zone").agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
                                        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    return ops.bin_centres(boxes, 0.1).select("zone", "i", "j", "lat", "lon")


_STEPS = """(SELECT CAST(l_orderkey % 40 AS INT) AS i, CAST((l_partkey * 7 + l_suppkey) % 50 AS INT) AS j, l_linenumber * 10 AS depth,
             DAY_OF(date_trunc('year', l_shipdate)) AS valid_time, sum(l_quantity) / count(*) AS value FROM {lineitem} GROUP BY 1, 2, 3, 4)"""
_AT = """(SELECT port_id, lat, lon, greatest(0, least(39, CAST(ceil((lat - CAST(8 AS DOUBLE)) / (7 / 100) - 1 / 2) AS INT))) AS i,
          greatest(0, least(49, CAST(ceil((lon - CAST(78 AS DOUBLE)) / (5 / 100) - 1 / 2) AS INT))) AS j FROM {ports})"""


@query("g12_point_time_series", f"""
WITH s AS (SELECT i, j, valid_time, avg(value) AS value FROM {_STEPS} x GROUP BY 1, 2, 3), a AS {_AT}
SELECT port_id, valid_time, round(value, 6) AS cell_value, round({hav('lat', 'lon', '(8.0 + a.i * 0.07)', '(78.0 + a.j * 0.05)')}, 6) AS cell_nm
FROM a JOIN s USING (i, j) ORDER BY valid_time""")
def g12(v: Views):
    return ops.point_series(v.ports, v.sql(_STEPS.strip()[1:-1]), "port_id", "valid_time", LAT_AXIS, LON_AXIS)


@query("g13_vertical_profile", f"""
WITH s AS {_STEPS}, a AS {_AT}, x AS (SELECT a.port_id, s.* FROM a JOIN s USING (i, j)), l AS (SELECT port_id, max(valid_time) AS valid_time FROM x GROUP BY 1)
SELECT x.port_id, x.valid_time, x.depth, round(x.value, 6) AS value, CAST(greatest(lo, least(hi, x.port_id % 100)) AS INT) AS depth_used FROM x JOIN l USING (port_id, valid_time), (SELECT min(depth) AS lo, max(depth) AS hi FROM s)""")
def g13(v: Views):
    at = v.ports.withColumns({"i": joins.axis_index("lat", *LAT_AXIS), "j": joins.axis_index("lon", *LON_AXIS)}).select("port_id", "i", "j")
    steps = v.sql(_STEPS.strip()[1:-1])
    low, high = steps.agg(F.min("depth"), F.max("depth")).first()
    wanted = (F.col("port_id") % 100).cast("int")
    return ops.vertical_profile(at, steps, "port_id").select(
        "port_id", "valid_time", "depth", "value", ops.clamp_depth(wanted, F.lit(high), F.lit(low)).cast("int").alias("depth_used"))


@query("f19_cell_area", """
SELECT slice, i, j, round(radians(0.07) * 6371008.8 * radians(0.05) * 6371008.8 * cos(radians(lat)) / 1000000, 4) AS area_km2 FROM {grid_cells}""")
def f19(v: Views):
    return ops.with_areas(v.grid_cells, v.grid_cells, ["slice"]).select("slice", "i", "j", F.round(F.col("area_m2") / 1e6, 4).alias("area_km2"))
