"""Cost surface and routes over the derived lattice; one route per supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.operators import routing as ops
from pelagia.plans.overlay import PAIR, Routes
from pelagia.plans.raster import Lattice
from pelagia.session import cut_lineage
from pelagia.workload.queries_fences import brg, hav
from pelagia.workload.queries_joins import LAT_AXIS, LON_AXIS
from pelagia.workload.registry import query, r6
from pelagia.workload.views import Views

MIN_DEPTH, CRUISE = 1.2, 7.0

CELLS = f"""
    bl AS (SELECT * FROM {{fence_segments}} WHERE layer LIKE 'IMBL%'),
    bx AS (SELECT min(least(x1,x2)) - 0.1 AS a, max(greatest(x1,x2)) + 0.1 AS b, min(least(y1,y2)) - 0.1 AS c, max(greatest(y1,y2)) + 0.1 AS d FROM bl),
    bs AS (SELECT i, j, lat, lon, fkey, x1, y1, x2, y2, greatest(0, least(1, ((lon-x1)*(x2-x1)+(lat-y1)*(y2-y1)) / ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS t
           FROM {{cost_inputs}}, bl, bx WHERE lon BETWEEN a AND b AND lat BETWEEN c AND d),
    bd AS (SELECT i, j, min({hav('lat', 'lon', '(y1+t*(y2-y1))', '(x1+t*(x2-x1))')}) AS boundary_nm FROM bs GROUP BY 1, 2),
    ct AS (SELECT c.*, bd.boundary_nm, round_steep.s AS steep, 1.0::DOUBLE AS base, coalesce(4 * pow(hs / 4, 2), 0) AS hs_term, coalesce(2 * pow(wind / 40, 2), 0) AS wind_term,
             coalesce(5 * round_steep.s / 0.08, 0) AS steep_term, 3 * CASE WHEN depth IS NULL THEN 0 WHEN depth < 2.4 THEN 1 ELSE greatest(0, least(1, (7.4 - depth) / 5)) END AS shallow_term,
             6 * CASE WHEN boundary_nm IS NULL THEN 0 ELSE greatest(0, least(1, (3 - boundary_nm) / 2.7)) END AS imbl_term
           FROM {{cost_inputs}} c LEFT JOIN bd USING (i, j), LATERAL (SELECT CASE WHEN c.hs <> 0 AND c.period > 0 THEN c.hs / (1.56 * c.period * c.period) END AS s) round_steep),
    cc AS (SELECT *, base + hs_term + wind_term + steep_term + shallow_term + imbl_term AS cost,
             CASE WHEN land THEN 'land' WHEN exclusion THEN 'exclusion' WHEN boundary_nm <= 0.3 THEN 'imbl' WHEN depth < 1.2 THEN 'shallow' END AS blocked FROM ct)"""


def cost_cells(v: Views):
    lines = v.fence_segments.where("layer LIKE 'IMBL%'")
    measured = ops.boundary_distance(v.cost_inputs, lines)
    return cut_lineage(ops.cost_terms(measured, MIN_DEPTH).withColumn("blocked", ops.blocked_reason(MIN_DEPTH)))


@query("r1_cost_terms", f"WITH {CELLS} SELECT i, j, {r6('base', 'hs_term', 'wind_term', 'steep_term', 'shallow_term', 'imbl_term', 'cost')}, "
       "concat_ws(',', CASE WHEN hs IS NULL THEN 'hs' END, CASE WHEN wind IS NULL THEN 'wind' END, CASE WHEN steep IS NULL THEN 'steep' END, CASE WHEN depth IS NULL THEN 'depth' END) AS missing FROM cc")
def r1(v: Views):
    return cost_cells(v).select("i", "j", "base", "hs_term", "wind_term", "steep_term", "shallow_term", "imbl_term", "cost", "missing")


@query("r2_blocked_reason", f"WITH {CELLS} SELECT i, j, blocked FROM cc")
def r2(v: Views):
    return cost_cells(v).select("i", "j", "blocked")


@query("r3_boundary_distance", f"WITH {CELLS} SELECT i, j, {r6('boundary_nm')} FROM cc")
def r3(v: Views):
    return ops.boundary_distance(v.cost_inputs, v.fence_segments.where("layer LIKE 'IMBL%'")).select("i", "j", "boundary_nm")


#: A lattice of 0.01 degrees over the region: 75 400 cells.
FINE = Lattice(260, 290, 8.0, 78.0, 0.01, 0.01, lambda i: (F.lit(800) + i) / F.lit(100), lambda j: (F.lit(7800) + j) / F.lit(100))
FINE_SQL = "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, (800 + i) / 100 AS lat, (7800 + j) / 100 AS lon FROM range(260) a(i), range(290) b(j)"


def fine_cells(v: Views):
    cells = v.spark.range(FINE.rows * FINE.columns).select((F.col("id") / FINE.columns).cast("int").alias("i"), (F.col("id") % FINE.columns).cast("int").alias("j"))
    return cells.withColumns({"lat": FINE.lat(F.col("i")), "lon": FINE.lon(F.col("j"))})


@query("r1_polygon_masks", f"""
WITH c AS ({FINE_SQL}), s AS (SELECT * FROM {{fence_segments}} WHERE is_polygon AND layer IN ('MPA', 'ECO_SENSITIVE')),
h AS (SELECT i, j, layer, fkey FROM c, s WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT i, j, coalesce(bool_or(layer = 'MPA'), false) AS land, coalesce(bool_or(layer = 'ECO_SENSITIVE'), false) AS exclusion FROM c LEFT JOIN h USING (i, j) GROUP BY i, j""")
def r1_masks(v: Views):
    """Land and exclusion of every cell of the fine lattice, from polygons."""
    marked, absent = ops.masks(fine_cells(v), v.fence_segments, FINE, ["MPA"], ["ECO_SENSITIVE"])
    assert not absent
    return marked.select("i", "j", "land", "exclusion")


def _snap(name: str, lat: str, lon: str) -> str:
    return f"""
    {name}0 AS (SELECT route_id, {lat} AS la, {lon} AS lo, greatest(0, least(39, CAST(ceil(({lat} - 8.0::DOUBLE) / 0.07::DOUBLE - 0.5) AS INT))) AS ci,
             greatest(0, least(49, CAST(ceil(({lon} - 78.0::DOUBLE) / 0.05::DOUBLE - 0.5) AS INT))) AS cj FROM {{routes}}),
    {name} AS (SELECT route_id, c.i, c.j FROM {name}0 s JOIN cc c ON abs(c.i - ci) <= 4 AND abs(c.j - cj) <= 4 AND blocked IS NULL
             QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY greatest(abs(c.i - ci), abs(c.j - cj)), round({hav('la', 'lo', 'c.lat', 'c.lon')}, 9), c.i, c.j) = 1)"""


ENDS = CELLS + "," + _snap("so", "olat", "olon") + "," + _snap("sd", "dlat", "dlon")
SURFACE = ENDS + f""",
    og AS (SELECT DISTINCT CAST(i * 50 + j AS BIGINT) AS origin, i, j FROM so),
    ed AS (SELECT a.i, a.j, b.i AS ni, b.j AS nj, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} * b.cost AS w FROM cc a JOIN cc b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1
           AND (a.i <> b.i OR a.j <> b.j) WHERE a.blocked IS NULL AND b.blocked IS NULL),
    sf(origin, i, j, g) USING KEY (origin, i, j) AS (
        SELECT origin, i, j, 0.0::DOUBLE FROM og
        UNION
        SELECT t.origin, e.ni, e.nj, min(t.g + e.w) FROM sf t JOIN ed e ON e.i = t.i AND e.j = t.j
        LEFT JOIN recurring.sf r ON r.origin = t.origin AND r.i = e.ni AND r.j = e.nj WHERE r.g IS NULL OR t.g + e.w < r.g GROUP BY 1, 2, 3)"""
PATHS = SURFACE + """,
    pr AS (SELECT s.origin, s.i, s.j, arg_min(struct_pack(i := p.i, j := p.j), (round(p.g, 9), p.i, p.j)) AS p FROM sf s JOIN ed e ON e.ni = s.i AND e.nj = s.j
           JOIN sf p ON p.origin = s.origin AND p.i = e.i AND p.j = e.j WHERE s.g > 0 AND p.g + e.w <= s.g + 0.000000001 GROUP BY 1, 2, 3),
    wk AS (SELECT so.route_id, og.origin, 0::BIGINT AS back, sd.i, sd.j FROM so JOIN og ON og.i = so.i AND og.j = so.j JOIN sd USING (route_id) JOIN sf ON sf.origin = og.origin AND sf.i = sd.i AND sf.j = sd.j
           UNION ALL SELECT w.route_id, w.origin, w.back + 1, p.p.i, p.p.j FROM wk w JOIN pr p ON p.origin = w.origin AND p.i = w.i AND p.j = w.j),
    pt AS (SELECT route_id, origin, max(back) OVER (PARTITION BY route_id) - back AS hop, i, j FROM wk)"""
LEGS = PATHS + f""",
    lg AS (SELECT b.route_id, b.hop, b.i, b.j, {hav('ca.lat', 'ca.lon', 'cb.lat', 'cb.lon')} AS distance_nm, {brg('ca.lat', 'ca.lon', 'cb.lat', 'cb.lon')} AS bearing_deg, cb.*  EXCLUDE (i, j)
           FROM pt b JOIN pt a ON a.route_id = b.route_id AND a.hop = b.hop - 1 JOIN cc ca ON ca.i = a.i AND ca.j = a.j JOIN cc cb ON cb.i = b.i AND cb.j = b.j),
    lc AS (SELECT *, distance_nm / 7 * 3600 AS eta_s, CASE WHEN current_kn IS NULL THEN 0 ELSE 1.5 * greatest(0, -(current_kn * cos(radians(current_to - bearing_deg)))) / 3 END AS current_term FROM lg)"""


class Solved:
    """Everything a route query needs, built step by step."""

    def __init__(self, v: Views):
        self.cells = cost_cells(v)
        self.routes = v.routes
        self.starts = ops.snap(v.routes, self.cells, "route_id", LAT_AXIS, LON_AXIS, "olat", "olon")
        self.ends = ops.snap(v.routes, self.cells, "route_id", LAT_AXIS, LON_AXIS, "dlat", "dlon")
        code = (F.col("i") * 50 + F.col("j")).cast("bigint").alias("origin")
        start = self.starts.select("route_id", F.col("i").alias("oi"), F.col("j").alias("oj"))
        goal = self.ends.select("route_id", F.col("i").alias("gi"), F.col("j").alias("gj"))
        self.asked = cut_lineage(start.join(goal, "route_id").where("oi IS NOT NULL AND gi IS NOT NULL").withColumn(
            "origin", (F.col("oi") * 50 + F.col("oj")).cast("bigint")))
        self.found = Routes(self.cells, self.asked)
        self.costs = self.asked.join(self.found.best, PAIR)

    def paths(self):
        return self.asked.join(self.found.paths(), PAIR).select("route_id", "origin", "hop", "i", "j")

    def legs(self):
        return ops.legs(self.paths(), self.cells, CRUISE)


@query("r4_snap_to_passable", f"WITH {ENDS} SELECT route_id, 'start' AS side, CAST(so.i AS DOUBLE) AS i, CAST(so.j AS DOUBLE) AS j FROM {{routes}} LEFT JOIN so USING (route_id) "
       "UNION ALL SELECT route_id, 'end', CAST(sd.i AS DOUBLE), CAST(sd.j AS DOUBLE) FROM {routes} LEFT JOIN sd USING (route_id)")
def r4(v: Views):
    cells = cost_cells(v)
    side = lambda name, la, lo: ops.snap(v.routes, cells, "route_id", LAT_AXIS, LON_AXIS, la, lo).select(
        "route_id", F.lit(name).alias("side"), F.col("i").cast("double").alias("i"), F.col("j").cast("double").alias("j"))
    return side("start", "olat", "olon").unionByName(side("end", "dlat", "dlon"))


@query("r5_least_cost_surface", f"WITH RECURSIVE {SURFACE} SELECT origin, i, j, {r6('g')} FROM sf")
def r5(v: Views):
    cells = cost_cells(v)
    starts = ops.snap(v.routes, cells, "route_id", LAT_AXIS, LON_AXIS, "olat", "olon")
    code = (F.col("i") * 50 + F.col("j")).cast("bigint").alias("origin")
    return ops.least_cost_surface(cells, starts.where("i IS NOT NULL").select(code, "i", "j").distinct())


@query("r5_route_costs", f"WITH RECURSIVE {SURFACE} SELECT so.route_id, og.origin, sd.i, sd.j, {r6('g')} FROM so JOIN og ON og.i = so.i AND og.j = so.j JOIN sd USING (route_id) "
       "JOIN sf ON sf.origin = og.origin AND sf.i = sd.i AND sf.j = sd.j")
def r5_costs(v: Views):
    """Least cost of every asked route, searched on the tiles' border graph."""
    return Solved(v).costs.select("route_id", "origin", F.col("gi").alias("i"), F.col("gj").alias("j"), "g")


@query("r6_path_extraction", f"WITH RECURSIVE {PATHS} SELECT route_id, hop, i, j FROM pt")
def r6q(v: Views):
    return Solved(v).paths().select("route_id", "hop", "i", "j")


@query("r7_route_legs", f"WITH RECURSIVE {LEGS} SELECT route_id, hop, {r6('distance_nm', 'bearing_deg', 'eta_s', 'base', 'hs_term', 'wind_term', 'steep_term', 'shallow_term', 'imbl_term', 'current_term')} FROM lc")
def r7(v: Views):
    return Solved(v).legs().drop("i", "j", "cost")


@query("a15_route_totals", f"""
WITH RECURSIVE {LEGS}, s AS (SELECT route_id, sum(distance_nm) AS total_nm, sum(eta_s) AS total_s, count(*) AS n_legs, sum(hs_term) AS hs_term, sum(current_term) AS current_term FROM lc GROUP BY 1),
d AS (SELECT route_id, {hav('olat', 'olon', 'dlat', 'dlon')} AS direct_nm FROM {{routes}})
SELECT route_id, n_legs, {r6('total_nm', 'total_s', 'hs_term', 'current_term', 'direct_nm')}, round(CASE WHEN direct_nm > 0 THEN 100 * (total_nm - direct_nm) / direct_nm ELSE 0 END, 6) AS detour_pct FROM s JOIN d USING (route_id)""")
def a15(v: Views):
    solved = Solved(v)
    return ops.route_totals(solved.legs(), v.routes).select(
        "route_id", "n_legs", "total_nm", "total_s", "hs_term", "current_term", "direct_nm", "detour_pct")


@query("r8_failure_class", f"""
WITH RECURSIVE {SURFACE}, r AS (SELECT r.route_id, so.i AS si, sd.i AS ei, sf.g FROM {{routes}} r LEFT JOIN so USING (route_id) LEFT JOIN sd USING (route_id)
     LEFT JOIN sf ON sf.origin = so.i * 50 + so.j AND sf.i = sd.i AND sf.j = sd.j)
SELECT route_id, CASE WHEN si IS NULL THEN 'origin_blocked' WHEN ei IS NULL THEN 'destination_blocked' WHEN g IS NULL THEN 'no_path_found' ELSE 'feasible' END AS status, {r6('g')} FROM r""")
def r8(v: Views):
    solved = Solved(v)
    return ops.classify_routes(v.routes, solved.starts, solved.ends, solved.costs.select("route_id", "g"))


@query("r9_avoided_hazards", f"""
WITH RECURSIVE {PATHS}, ar AS (SELECT DISTINCT route_id, c.blocked FROM pt JOIN cc c ON abs(c.i - pt.i) <= 1 AND abs(c.j - pt.j) <= 1 AND c.blocked IS NOT NULL),
en AS (SELECT route_id, arg_min(i, hop) AS ai, arg_min(j, hop) AS aj, arg_max(i, hop) AS bi, arg_max(j, hop) AS bj FROM pt GROUP BY 1),
ln AS (SELECT route_id, unnest(range(0, greatest(abs(bi - ai), abs(bj - aj), 1) + 1)) AS k, greatest(abs(bi - ai), abs(bj - aj), 1) AS n, ai, aj, bi, bj FROM en),
st AS (SELECT DISTINCT route_id, c.blocked FROM ln JOIN cc c ON c.i = CAST(floor(ai + (bi - ai) * k / n + 0.5) AS INT) AND c.j = CAST(floor(aj + (bj - aj) * k / n + 0.5) AS INT) AND c.blocked IS NOT NULL),
al AS (SELECT * FROM ar UNION SELECT * FROM st)
SELECT p.route_id, coalesce(string_agg(blocked, ',' ORDER BY blocked), '') AS avoided FROM (SELECT DISTINCT route_id FROM pt) p LEFT JOIN al USING (route_id) GROUP BY 1""")
def r9(v: Views):
    solved = Solved(v)
    return ops.avoided_reasons(solved.paths(), solved.cells)
