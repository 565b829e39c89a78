"""Cost surface and least-cost routes over a cell lattice (8 neighbours).

The least-cost surface is relaxed tile by tile: a tile with improved border values is
settled on its own inside a task, and only improved border cells are sent on to the
neighbouring tiles. Rounds are as many as tiles a path crosses, not cells.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import asin, cos, inf, radians, sin, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pelagia import dims
from pelagia.functions import geo, marine
from pelagia.plans.raster import Lattice, polygon_cells
from pelagia.plans.spatial import nearest_features
from pelagia.session import cut_lineage

# Fixed values.
BLOCK_ORDER = ("shallow", "imbl", "exclusion", "land")
SNAP_RINGS = 4
NEIGHBOURS = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)
TILE = 32


# ---- cost terms -----------------------------------------------------------------------


def masks(cells: DataFrame, segments: DataFrame, lattice: Lattice, land: list[str], exclusion: list[str]) -> tuple[DataFrame, list[str]]:
    """``cells`` with ``land`` and ``exclusion``: whether a cell's centre lies in a polygon of these layers; and the kinds absent.

    Without any polygon of a kind its mask is false and its name (``coastline``, ``exclusion``) is told, to be given to ``cost_terms``.
    """
    kinds = F.when(F.col("layer").isin(*land), F.lit("land")).when(F.col("layer").isin(*exclusion), F.lit("exclusion"))
    wanted = segments.where(kinds.isNotNull()).withColumn("layer", kinds)
    have = {x[0] for x in wanted.where("is_polygon").select("layer").distinct().collect()}
    flags = [F.bool_or(F.col("layer") == k).alias(k) for k in ("land", "exclusion")]
    inside = polygon_cells(wanted, lattice).groupBy("i", "j").agg(*flags)
    given = cells.drop("land", "exclusion")
    marked = given.join(inside, ["i", "j"], "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("land", "exclusion")})
    return marked, [name for kind, name in (("land", "coastline"), ("exclusion", "exclusion")) if kind not in have]


def cost_terms(cells: DataFrame, min_depth_m: float, absent: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Weighted terms per cell; an unknown input gives a zero term and is named in ``missing``, as are whole layers that are ``absent``.

    Needs hs, wind, period, depth, boundary_nm; current_kn and current_to where there are any. The current is left out of ``cost`` because it
    depends on the direction of travel.
    """
    w, n = dims.ROUTE_WEIGHTS, dims.ROUTE_NORMALISERS
    square = lambda c, top: F.pow(F.col(c) / F.lit(top), F.lit(2.0))
    steep = marine.wave_steepness("hs", "period")
    zero = F.lit(0.0)
    terms = {
        "base": F.lit(w["base"]), "hs_term": F.coalesce(w["hs"] * square("hs", n["hs_max_m"]), zero),
        "wind_term": F.coalesce(w["wind"] * square("wind", n["wind_max_kn"]), zero),
        "steep_term": F.coalesce(w["steep"] * steep / n["steepness_max"], zero),
        "shallow_term": w["shallow"] * marine.shallow_penalty("depth", min_depth_m),
        "imbl_term": w["imbl"] * marine.boundary_penalty("boundary_nm")}
    flow = [F.col(c) for c in ("current_kn", "current_to") if c in cells.columns]
    current = [("current", F.when(flow[0].isNotNull() & flow[1].isNotNull(), F.lit(1)) if len(flow) == 2 else F.lit(None).cast("int"))]
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(name)) for name, c in (
        ("hs", F.col("hs")), ("wind", F.col("wind")), ("steep", steep), ("depth", F.col("depth")), *current)],
        *[F.lit(name) for name in absent]))
    staged = cells.select("*", *[c.alias(k) for k, c in terms.items()], F.array_join(missing, ",").alias("missing"))
    return staged.withColumn("cost", F.col("base") + F.col("hs_term") + F.col("wind_term") + F.col("steep_term")
                             + F.col("shallow_term") + F.col("imbl_term"))


def blocked_reason(min_depth_m: float) -> Column:
    """Why a cell is impassable; land over exclusion over boundary over shallow water. Needs land, exclusion."""
    return F.coalesce(F.when(F.col("land"), F.lit("land")), F.when(F.col("exclusion"), F.lit("exclusion")),
                      F.when(marine.too_close("boundary_nm"), F.lit("imbl")),
                      F.when(marine.too_shallow("depth", min_depth_m), F.lit("shallow")))


def boundary_distance(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds ``boundary_nm`` for cells near the lines' joint box; far cells stay null (no penalty)."""
    pad = max(dims.ROUTE_SOFT_NM / 60.0 * 2, 0.02)
    box = lines.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    if box[0] is None:
        return cells.withColumn("boundary_nm", F.lit(None).cast("double"))
    near = F.col("lon").between(box[0] - pad, box[1] + pad) & F.col("lat").between(box[2] - pad, box[3] + pad)
    joint = lines.withColumns({"layer": F.lit("boundary"), "is_polygon": F.lit(False)})
    measured = nearest_features(cells.where(near), joint).select("i", "j", F.col("distance_nm").alias("boundary_nm"))
    return cells.join(measured, ["i", "j"], "left")


# ---- snapping ---------------------------------------------------------------------------


def snap(points: DataFrame, cells: DataFrame, key: str, lat_axis, lon_axis, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Own cell if passable, else the nearest passable one in the first ring (1..4) that has any; else null."""
    from pelagia.operators.joins import axis_index

    here = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"),
        axis_index(F.col(lat), *lat_axis).alias("_i"), axis_index(F.col(lon), *lon_axis).alias("_j"))
    offsets = F.array(*[F.struct(F.lit(max(abs(a), abs(b))).alias("r"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                        for a in range(-SNAP_RINGS, SNAP_RINGS + 1) for b in range(-SNAP_RINGS, SNAP_RINGS + 1)])
    tried = here.select(key, "_lat", "_lon", F.inline(offsets), "_i", "_j").select(
        key, "_lat", "_lon", "r", (F.col("_i") + F.col("a")).alias("i"), (F.col("_j") + F.col("b")).alias("j"))
    open_cells = cells.where("blocked IS NULL").select("i", "j", "lat", "lon")
    found = tried.join(open_cells, ["i", "j"]).groupBy(key).agg(F.min_by(F.struct("i", "j"), F.struct(
        "r", F.round(geo.haversine_nm("_lat", "_lon", "lat", "lon"), 9), "i", "j")).alias("_s"))
    return points.select(key).join(found, key, "left").select(key, F.col("_s.i").alias("i"), F.col("_s.j").alias("j"))


# ---- least-cost surface -------------------------------------------------------------------


def _tiles(cells: DataFrame, tile: int) -> DataFrame:
    """(ti, tj, i, j, cost, lat, lon arrays) of passable cells; a tile holds at most tile * tile cells."""
    return cells.where("blocked IS NULL").groupBy(
        F.floor(F.col("i") / tile).cast("int").alias("ti"), F.floor(F.col("j") / tile).cast("int").alias("tj")).agg(
        F.collect_list(F.struct("i", "j", "cost", "lat", "lon")).alias("cells"))


def _distance_nm(a1: float, o1: float, a2: float, o2: float) -> float:
    p1, p2 = radians(a1), radians(a2)
    h = sin((p2 - p1) / 2) ** 2 + cos(p1) * cos(p2) * sin(radians(o2 - o1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * asin(min(1.0, sqrt(h))) / geo.METRES_PER_NM


def _tile_graph(cells, tile: int, ti: int, tj: int):
    """Cell index, entry rates, inner edges (target, weight) and cells outside that a cell touches."""
    at = {(c["i"], c["j"]): n for n, c in enumerate(cells)}
    edges, outside = [], []
    for c in cells:
        inner, outer = [], []
        for a, b in NEIGHBOURS:
            i, j = c["i"] + a, c["j"] + b
            n = at.get((i, j))
            if n is not None:
                to = cells[n]
                inner.append((n, _distance_nm(c["lat"], c["lon"], to["lat"], to["lon"]) * to["cost"]))
            elif i // tile != ti or j // tile != tj:
                outer.append((i, j))
        edges.append(inner)
        outside.append(outer)
    return at, [c["cost"] for c in cells], edges, outside


def _settle(tile: int):
    """Settle one tile: improve its values from the incoming border values, report the outgoing ones."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graphs: dict[tuple[int, int], tuple] = {}
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                where = (row.ti, row.tj)
                if where not in graphs:
                    graphs[where] = _tile_graph(row.cells, tile, *where)
                at, rate, edges, outside = graphs[where]
                best = [inf] * len(rate) if row.g is None else list(row.g)
                heap = []
                for m in row.incoming:
                    n = at.get((m["i"], m["j"]))
                    if n is not None and m["g"] + m["d"] * rate[n] < best[n]:
                        best[n] = m["g"] + m["d"] * rate[n]
                        heap.append((best[n], n))
                heapq.heapify(heap)
                changed = set()
                while heap:
                    g, n = heapq.heappop(heap)
                    if g > best[n]:
                        continue
                    if outside[n]:
                        changed.add(n)
                    for to, weight in edges[n]:
                        if g + weight < best[to]:
                            best[to] = g + weight
                            heapq.heappush(heap, (best[to], to))
                messages = [{"i": i, "j": j, "g": best[n], "lat": row.cells[n]["lat"], "lon": row.cells[n]["lon"]}
                            for n in changed for i, j in outside[n]]
                out.append((row.origin, row.ti, row.tj, best, messages))
            yield pd.DataFrame(out, columns=["origin", "ti", "tj", "g", "messages"])
    return run


def least_cost_surface(cells: DataFrame, origins: DataFrame, tile: int = TILE) -> DataFrame:
    """(origin, i, j, g): least cost from every origin cell; entering a cell costs its rate times the distance.

    ``origins`` has origin, i, j (distinct start cells, so equal starts are solved once).
    """
    schema = ("origin BIGINT, ti INT, tj INT, g ARRAY<DOUBLE>, "
              "messages ARRAY<STRUCT<i: INT, j: INT, g: DOUBLE, lat: DOUBLE, lon: DOUBLE>>")
    spark = cells.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = cells.where("blocked IS NULL").select("i", "j", "lat", "lon")
    tiles = cut_lineage(_tiles(cells, tile))
    tile_of = lambda c: F.floor(F.col(c) / tile).cast("int")
    arrivals = origins.join(grid, ["i", "j"]).select(
        F.col("origin").cast("bigint").alias("origin"), "i", "j", F.lit(0.0).alias("g"), F.lit(0.0).alias("d"))
    state = None
    while True:
        # Few rows but much work per row: the number of partitions is set, not left to their size.
        grouped = arrivals.withColumns({"ti": tile_of("i"), "tj": tile_of("j")}).repartition(parts, "origin", "ti", "tj") \
            .groupBy("origin", "ti", "tj").agg(F.collect_list(F.struct("i", "j", "g", "d")).alias("incoming"))
        active = grouped.join(tiles, ["ti", "tj"])
        if state is None:
            active = active.withColumn("g", F.lit(None).cast("ARRAY<DOUBLE>"))
        else:
            active = active.join(state, ["origin", "ti", "tj"], "left")
        done = cut_lineage(active.select("origin", "ti", "tj", "cells", "incoming", "g").mapInPandas(_settle(tile), schema))
        # One value per border cell and source neighbour; the entered cell's own rate is applied on arrival.
        sent = done.select("origin", F.inline("messages")).join(
            grid.select("i", "j", F.col("lat").alias("_la"), F.col("lon").alias("_lo")), ["i", "j"])
        arrivals = sent.select("origin", "i", "j", "g", geo.haversine_nm("lat", "lon", "_la", "_lo").alias("d"))
        fresh = done.select("origin", "ti", "tj", "g")
        state = fresh if state is None else cut_lineage(
            state.join(fresh.select("origin", "ti", "tj"), ["origin", "ti", "tj"], "left_anti").unionByName(fresh))
        if not done.where(F.size("messages") > 0).limit(1).count():
            values = state.join(tiles, ["ti", "tj"]).select("origin", F.inline(F.arrays_zip("cells", "g")))
            return values.where(F.col("g") < float("inf")).select("origin", "cells.i", "cells.j", "g")


def predecessors(surface: DataFrame, cells: DataFrame) -> DataFrame:
    """(origin, i, j, g, pi, pj): the neighbour each value came from; ties by (round(g, 9), i, j)."""
    grid = cells.where("blocked IS NULL").select("i", "j", "cost", "lat", "lon")
    placed = surface.join(grid, ["i", "j"])
    sent = placed.select(
        "origin", F.struct("g", "lat", "lon", F.col("i").alias("pi"), F.col("j").alias("pj")).alias("p"),
        F.inline(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in NEIGHBOURS])))
    offers = sent.join(placed.select("origin", "i", "j", F.col("g").alias("own"), "cost", "lat", "lon"), ["origin", "i", "j"])
    reach = F.col("p.g") + geo.haversine_nm("p.lat", "p.lon", "lat", "lon") * F.col("cost")
    fits = offers.where((reach <= F.col("own") + F.lit(1e-9)) & (F.col("own") > 0))
    best = fits.groupBy("origin", "i", "j").agg(F.min(F.struct(F.round("p.g", 9).alias("g9"), "p.pi", "p.pj")).alias("b"))
    return surface.join(best, ["origin", "i", "j"], "left").select(
        "origin", "i", "j", "g", F.col("b.pi").alias("pi"), F.col("b.pj").alias("pj"))


def extract_paths(links: DataFrame, goals: DataFrame) -> DataFrame:
    """(route_id, hop, i, j) from origin (hop 0) to goal by pointer doubling.

    ``goals`` has route_id, origin, i, j. Every round doubles the stretch a jump covers, so a
    path of n cells takes log2(n) rounds.
    """
    jump = cut_lineage(links.where("pi IS NOT NULL").select("origin", "i", "j", "pi", "pj"))
    path = cut_lineage(goals.join(links.select("origin", "i", "j"), ["origin", "i", "j"]).select(
        "route_id", "origin", F.lit(0).cast("bigint").alias("back"), "i", "j"))
    span = 1
    while True:
        step = path.join(jump, ["origin", "i", "j"]).select(
            "route_id", "origin", (F.col("back") + span).alias("back"), F.col("pi").alias("i"), F.col("pj").alias("j"))
        step = cut_lineage(step)
        if not step.limit(1).count():
            break
        path = cut_lineage(path.unionByName(step))
        onward = jump.select("origin", F.col("i").alias("pi"), F.col("j").alias("pj"), F.col("pi").alias("_i"), F.col("pj").alias("_j"))
        jump = cut_lineage(jump.join(onward, ["origin", "pi", "pj"]).select("origin", "i", "j", F.col("_i").alias("pi"), F.col("_j").alias("pj")))
        span *= 2
    length = path.groupBy("route_id").agg(F.max("back").alias("_n"))
    return path.join(length, "route_id").select("route_id", "origin", (F.col("_n") - F.col("back")).alias("hop"), "i", "j")


def legs(paths: DataFrame, cells: DataFrame, cruise_kn: float) -> DataFrame:
    """Per consecutive pair: distance, bearing, eta and the term rates of the entered cell.

    Pairs meet by joining hop to hop + 1, so a route's length does not matter.
    """
    terms = ["base", "hs_term", "wind_term", "steep_term", "shallow_term", "imbl_term", "cost", "current_kn", "current_to"]
    placed = paths.join(cells.select("i", "j", "lat", "lon", *terms), ["i", "j"])
    start = placed.select("route_id", (F.col("hop") + 1).alias("hop"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    pair = placed.join(start, ["route_id", "hop"])
    measured = pair.withColumns({"distance_nm": geo.haversine_nm("_la", "_lo", "lat", "lon"),
                                 "bearing_deg": geo.bearing_deg("_la", "_lo", "lat", "lon")})
    return measured.select(
        "route_id", "hop", "i", "j", "distance_nm", "bearing_deg", (F.col("distance_nm") / cruise_kn * 3600).alias("eta_s"),
        *terms[:6], "cost", marine.adverse_current("current_kn", "current_to", "bearing_deg").alias("current_term"))


def route_totals(route_legs: DataFrame, routes: DataFrame) -> DataFrame:
    """Sums per route, direct distance and detour percentage."""
    names = ["base", "hs_term", "wind_term", "steep_term", "shallow_term", "imbl_term", "current_term"]
    sums = route_legs.groupBy("route_id").agg(
        F.sum("distance_nm").alias("total_nm"), F.sum("eta_s").alias("total_s"), F.count(F.lit(1)).alias("n_legs"),
        *[F.sum(n).alias(n) for n in names])
    direct = geo.haversine_nm("olat", "olon", "dlat", "dlon")
    joined = sums.join(routes.select("route_id", direct.alias("direct_nm")), "route_id")
    return joined.withColumn("detour_pct", F.when(F.col("direct_nm") > 0, 100 * (F.col("total_nm") - F.col("direct_nm")) / F.col("direct_nm"))
                             .otherwise(F.lit(0.0)))


def classify_routes(routes: DataFrame, starts: DataFrame, ends: DataFrame, goals_reached: DataFrame) -> DataFrame:
    """feasible / origin_blocked / destination_blocked / no_path_found per route."""
    joined = (routes.select("route_id").join(starts.select("route_id", F.col("i").alias("si"), F.col("j").alias("sj")), "route_id", "left")
              .join(ends.select("route_id", F.col("i").alias("ei"), F.col("j").alias("ej")), "route_id", "left")
              .join(goals_reached.select("route_id", "g"), "route_id", "left"))
    status = (F.when(F.col("si").isNull(), "origin_blocked").when(F.col("ei").isNull(), "destination_blocked")
              .when(F.col("g").isNull(), "no_path_found").otherwise("feasible"))
    return joined.select("route_id", status.alias("status"), "g")


def avoided_reasons(paths: DataFrame, cells: DataFrame) -> DataFrame:
    """Distinct blocked reasons next to the path or on the straight line between its ends."""
    around = paths.select("route_id", F.inline(F.array(*[
        F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in NEIGHBOURS])))
    ends = paths.groupBy("route_id").agg(F.min_by(F.struct("i", "j"), "hop").alias("a"), F.max_by(F.struct("i", "j"), "hop").alias("b"))
    n = F.greatest(F.abs(F.col("b.i") - F.col("a.i")), F.abs(F.col("b.j") - F.col("a.j")), F.lit(1))
    along = lambda c, k: F.floor(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * k / n + F.lit(0.5)).cast("int")
    straight = ends.select("route_id", F.explode(F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(
        along("i", k).alias("i"), along("j", k).alias("j")))).alias("c")).select("route_id", "c.i", "c.j")
    touched = around.unionByName(straight).distinct().join(cells.where("blocked IS NOT NULL").select("i", "j", "blocked"), ["i", "j"])
    found = touched.groupBy("route_id").agg(F.array_join(F.array_sort(F.collect_set("blocked")), ",").alias("avoided"))
    return paths.select("route_id").distinct().join(found, "route_id", "left").select("route_id", F.coalesce("avoided", F.lit("")).alias("avoided"))
