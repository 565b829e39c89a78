"""Exact nearest-feature join without a cross join.

Points are summarised to the grid cells they occupy. The feature segments descend a
fixed world grid level by level: at every level a segment is handed to the occupied
child cells and kept only where it can still be among the ``k`` nearest of some point
of that cell (lower distance bound <= k-th smallest upper bound). What is left is a
candidate list per leaf cell, usually a handful of segments, and each point meets only
the list of its own cell by an equi-join on the cell id.

* Candidate list small (row count checked): it is sent to every task once, so the points are neither
  shuffled nor expanded and a hot cell costs nothing extra.
* Otherwise: points and candidates meet in groups of whole cells of bounded size; the points of a hot
  cell are dealt out to several groups, each with the cell's candidates.

Either way the measuring itself is :func:`_measure`, arithmetic on whole arrays of (point, segment) pairs.
"""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pelagia.functions import geo
from pelagia.session import BROADCAST_ROWS, at_most, cut_lineage, looked_up

#: Cell sizes in degrees, coarse to fine; each is 8 times finer than the one before.
LEVELS = (10.0, 1.25, 0.15625, 0.01953125, 0.00244140625)
#: A leaf level is fine enough once no cell holds more candidates than this.
LEAF_CANDIDATES = 64
#: Points and candidates of one group where these are too many to send to every task.
GROUP_POINTS, GROUP_CANDIDATES = 100_000, 200_000
#: (Point, segment) pairs measured at a time.
PAIRS = 500_000
#: Rows the first level may list (segments times cells of the occupied box).
START_ROWS = 5_000_000
SEGMENT_COLUMNS = ("layer", "fkey", "part", "ring", "seq", "x1", "y1", "x2", "y2", "is_polygon")


def point_segments(points: DataFrame, layer: str, key: str, lat: str, lon: str) -> DataFrame:
    """Point features as zero-length segments."""
    return points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.lit(layer).alias("layer"), F.col(key).alias("fkey"),
        F.lit(0).alias("part"), F.lit(0).alias("ring"), F.lit(0).alias("seq"),
        F.col(lon).alias("x1"), F.col(lat).alias("y1"), F.col(lon).alias("x2"), F.col(lat).alias("y2"),
        F.lit(False).alias("is_polygon"),
    )


def _cell(value, size: float) -> Column:
    return F.floor(geo._col(value) / F.lit(size)).cast("int")


def _with_bounds(cand: DataFrame, size: float, planar: bool) -> DataFrame:
    """Planar and great-circle bounds between each cell and its segment."""
    half, side = F.lit((2.0 ** 0.5) * size / 2 + 1e-9), F.lit(size / 2)
    cx, cy = F.col("_cx"), F.col("_cy")
    rows = cand.select("*", ((F.col("ix") + 0.5) * F.lit(size)).alias("_cx"),
                       ((F.col("iy") + 0.5) * F.lit(size)).alias("_cy"))
    rows = rows.select("*", geo.along_segment("_cx", "_cy", "x1", "y1", "x2", "y2").alias("_t"))
    dx = cx - F.col("x1") - F.col("_t") * (F.col("x2") - F.col("x1"))
    dy = cy - F.col("y1") - F.col("_t") * (F.col("y2") - F.col("y1"))
    rows = rows.select(
        "*", F.sqrt(dx * dx + dy * dy).alias("_centre"),
        F.greatest(F.abs(cy) + side, F.abs(F.col("y1")), F.abs(F.col("y2"))).alias("_top"),
        (F.col("is_polygon") & (F.col("bx1") <= cx + side) & (F.col("bx2") >= cx - side)
         & (F.col("by1") <= cy + side) & (F.col("by2") >= cy - side)).alias("_over"))
    rows = rows.select("*", F.greatest(F.lit(0.0), F.col("_centre") - half).alias("_low"),
                       (F.col("_centre") + half).alias("_high"))
    # A great circle is never longer than the straight path in degree space, and never
    # shorter than that path shrunk by cos(latitude) and by sin(x) >= 2x/pi.
    shrink = F.lit(1.0) if planar else (F.cos(F.radians(F.least(F.lit(90.0), F.col("_top"))))
                                        * F.when(F.col("_high") < 10, F.lit(0.998)).otherwise(F.lit(2 / pi)))
    return rows.select(
        *cand.columns, "_low", "_high", "_over", (F.col("_high") * F.lit(geo.NM_PER_DEGREE * 1.000001)).alias("_high_nm"),
        F.when(F.col("_over"), F.lit(0.0)).otherwise(
            F.col("_low") * shrink * F.lit(geo.NM_PER_DEGREE * 0.999999)).alias("_low_nm"),
        (F.col("_over") & (F.least("y1", "y2") <= cy + side) & (F.greatest("y1", "y2") >= cy - side)
         & (F.greatest("x1", "x2") >= cx - side)).alias("_ray"))


def _prune(cand: DataFrame, size: float, k: int, max_nm: float | None, planar: bool) -> DataFrame:
    """Keep per cell the segments that may matter to some point of the cell."""
    rows = _with_bounds(cand, size, planar)
    features = rows.groupBy("ix", "iy", "layer", "fkey").agg(
        F.min("_high").alias("_fhigh"), F.min("_high_nm").alias("_fhigh_nm"),
        F.min("_low_nm").alias("_flow_nm"),
    )
    if k == 1:
        cut = features.groupBy("ix", "iy", "layer").agg(F.min("_fhigh_nm").alias("_cut"))
    else:
        order = Window.partitionBy("ix", "iy", "layer").orderBy("_fhigh_nm")
        cut = (features.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k)
               .groupBy("ix", "iy", "layer")
               .agg(F.max("_fhigh_nm").alias("_cut"), F.count(F.lit(1)).alias("_n"))
               .select("ix", "iy", "layer",
                       F.when(F.col("_n") < k, F.lit(float("inf"))).otherwise(F.col("_cut")).alias("_cut")))
    limit = F.col("_cut") if max_nm is None else F.least(F.col("_cut"), F.lit(float(max_nm)))
    # The candidates are estimated by the small table they come from, before it is spread over the cells: left to itself
    # the planner would send them whole to every task.
    kept = (features.join(cut.hint("merge"), ["ix", "iy", "layer"]).where(F.col("_flow_nm") <= limit)
            .select("ix", "iy", "layer", "fkey", "_fhigh"))
    return (rows.join(kept.hint("merge"), ["ix", "iy", "layer", "fkey"])
            .where((F.col("_low") <= F.col("_fhigh")) | F.col("_ray"))
            # Only where a polygon's box meets the cell are all the edges of its ray test kept.
            .withColumn("is_polygon", F.col("_over"))
            .select("ix", "iy", *SEGMENT_COLUMNS, "bx1", "by1", "bx2", "by2"))


def candidate_index(points: DataFrame, segments: DataFrame, k: int = 1, max_nm: float | None = None,
                    lat: str = "lat", lon: str = "lon", planar: bool = False) -> tuple[DataFrame, float, int]:
    """(ix, iy, segment columns) candidates per occupied leaf cell, cell size, row count."""
    boxes = segments.where("is_polygon").groupBy("layer", "fkey").agg(
        F.min(F.least("x1", "x2")).alias("bx1"), F.min(F.least("y1", "y2")).alias("by1"),
        F.max(F.greatest("x1", "x2")).alias("bx2"), F.max(F.greatest("y1", "y2")).alias("by2"))
    cand = segments.select(*SEGMENT_COLUMNS).join(boxes, ["layer", "fkey"], "left") \
        .join(_crowded(segments, k), ["layer", "fkey"], "left_anti")
    here = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    # The points are read once; every cell of the finest level lies in one cell of each coarser one.
    finest = cut_lineage(here.select(_cell(lon, LEVELS[-1]).alias("ix"), _cell(lat, LEVELS[-1]).alias("iy")).distinct())

    def cells_at(depth: int) -> DataFrame:
        finer = 8 ** (len(LEVELS) - 1 - depth)
        cells = finest.select(*[F.floor(F.col(c) / finer).cast("int").alias(c) for c in ("ix", "iy")]).distinct()
        return F.broadcast(cells) if at_most(cells, BROADCAST_ROWS) else cells.hint("merge")

    (west, east, south, north) = finest.agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
    if west is None:
        return cand.limit(0).withColumns({"ix": F.lit(0), "iy": F.lit(0)}), LEVELS[2], 0
    west, east, south, north = (c // 64 for c in (west, east, south, north))
    start, ranges = _start_level(cand, (west, east, south, north))
    for depth, size in list(enumerate(LEVELS))[start:]:
        occupied = cells_at(depth)
        if depth == start:
            (w, e), (s, n) = ranges
            children = cand.withColumn("ix", F.explode(F.sequence(F.lit(w), F.lit(e)))) \
                           .withColumn("iy", F.explode(F.sequence(F.lit(s), F.lit(n))))
        else:
            step = F.sequence(F.lit(0), F.lit(7))
            children = cand.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)) \
                .withColumn("ix", F.col("ix") * 8 + F.col("_dx")).withColumn("iy", F.col("iy") * 8 + F.col("_dy")) \
                .drop("_dx", "_dy")
        cand = cut_lineage(_prune(children.join(occupied, ["ix", "iy"], "left_semi"), size, k, max_nm, planar))
        if depth >= 2:
            worst, rows = cand.groupBy("ix", "iy", "layer").count().agg(F.max("count"), F.sum("count")).first()
            if (worst or 0) <= LEAF_CANDIDATES:
                break
    return cand, size, rows or 0


def _crowded(segments: DataFrame, k: int) -> DataFrame:
    """Point features that ``k`` others of their layer at the same place come before: as far from everything, and later by key."""
    places = segments.groupBy("layer", "fkey").agg(
        F.min(F.least("x1", "x2")).alias("_x"), F.max(F.greatest("x1", "x2")).alias("_east"),
        F.min(F.least("y1", "y2")).alias("_y"), F.max(F.greatest("y1", "y2")).alias("_north"),
        F.bool_or(F.coalesce("is_polygon", F.lit(False))).alias("_area"))
    alone = places.where(~F.col("_area") & (F.col("_x") == F.col("_east")) & (F.col("_y") == F.col("_north")) & F.col("fkey").isNotNull())
    order = Window.partitionBy("layer", "_x", "_y").orderBy("fkey")
    return alone.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") > k).select("layer", "fkey")


def _start_level(segments: DataFrame, box: tuple[int, int, int, int]):
    """The finest level (up to the leaf) whose occupied box times the segments stays small."""
    for depth in (2, 1):
        coarser = 8 ** (2 - depth)
        w, e, s, n = (b // coarser for b in box)
        if at_most(segments, START_ROWS // ((e - w + 1) * (n - s + 1))):
            return depth, ((w, e), (s, n))
    w, e, s, n = (b // 64 for b in box)
    return 0, ((w, e), (s, n))


def nearest_features(points: DataFrame, segments: DataFrame, k: int = 1, max_nm: float | None = None,
                     lat: str = "lat", lon: str = "lon",
                     broadcast_rows: int = BROADCAST_ROWS, planar: bool = False) -> DataFrame:
    """The ``k`` nearest features of every layer for every point.

    Adds ``layer, fkey, rank, distance_nm, bearing_deg, inside, closest_lat, closest_lon``
    to the point columns. The closest point of a feature is found in degree space and the
    distance to it is great-circle; a point inside a polygon is at distance 0 with no
    bearing. Equal distances are ordered by feature key. ``max_nm`` drops farther features.
    With ``planar`` features rank by distance in degree space and ``distance_nm`` is that
    distance in degrees. Points need no key: repeated points each get their rows, whichever way the join runs.
    """
    index, size, rows = candidate_index(points, segments, k, max_nm, lat, lon, planar)
    here = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns({"ix": _cell(lon, size), "iy": _cell(lat, size)})
    index = index.select("ix", "iy", "layer", "fkey", F.coalesce("is_polygon", F.lit(False)).alias("is_polygon"), "x1", "y1", "x2", "y2") \
        .dropna(subset=["x1", "y1", "x2", "y2"])
    kinds = {f.name: f.dataType.simpleString() for f in index.schema.fields}
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in points.schema.fields) + (
        f"layer {kinds['layer']}, fkey {kinds['fkey']}, rank INT, distance_nm DOUBLE, inside BOOLEAN, closest_lat DOUBLE, closest_lon DOUBLE, bearing_deg DOUBLE")
    columns = list(points.columns)

    def told(batch: pa.Table, candidates: Candidates):
        return _measure(batch, columns, candidates, lat, lon, k, max_nm, planar)

    if rows <= broadcast_rows:
        sent = points.sparkSession.sparkContext.broadcast(index.toArrow())

        def each(batches):
            candidates = Candidates(sent.value)
            for batch in batches:
                for done in told(pa.Table.from_batches([batch]), candidates):
                    yield from done.to_batches()

        return here.mapInArrow(each, schema)

    def group(shown: pa.Table, held: pa.Table) -> pa.Table:
        done = list(told(shown, Candidates(held))) if shown.num_rows and held.num_rows else []
        return pa.concat_tables(done) if done else _told(shown.slice(0, 0), columns, Candidates(held.slice(0, 0)))

    return _grouped(here, index, rows, lambda left, right: left.cogroup(right).applyInArrow(group, schema))


def _grouped(here: DataFrame, index: DataFrame, rows: int, measured) -> DataFrame:
    """Points and candidates in groups of whole cells; a cell of many points is dealt out to several groups."""
    numbered = _numbered(here)
    held = index.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("_held"))
    cells = cut_lineage(numbered.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("_n")).join(held.hint("merge"), ["ix", "iy"], "left")
                        .select("ix", "iy", "_n", F.coalesce("_held", F.lit(0)).alias("_held"), F.ceil(F.col("_n") / GROUP_POINTS).cast("int").alias("_shares")))
    total = cells.agg(F.sum("_n")).first()[0] or 0
    # Shares are dealt by hash to lots, and a lot, of whatever size, is cut into groups where its points or candidates run full.
    groups = 1 + total // GROUP_POINTS + rows // GROUP_CANDIDATES
    shares = cells.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))) \
        .withColumn("_lot", F.pmod(F.xxhash64("ix", "iy", "_share"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("_lot").orderBy("ix", "iy", "_share").rowsBetween(Window.unboundedPreceding, -1)
    full = lambda c, most: F.floor(F.coalesce(F.sum(c).over(before), F.lit(0)) / most)
    group = F.concat_ws("/", "_lot", full(F.col("_n") / F.col("_shares"), GROUP_POINTS), full(F.col("_held"), GROUP_CANDIDATES))
    placed = looked_up(cut_lineage(shares.select("ix", "iy", group.alias("_group")).groupBy("ix", "iy").agg(F.collect_list("_group").alias("_groups"))))
    left = numbered.join(placed, ["ix", "iy"]).withColumn("_group", F.get("_groups", F.pmod(F.col(ROW), F.size("_groups")).cast("int")))
    # Two shares of a cell may meet in one group, which then has its candidates once.
    right = index.join(placed, ["ix", "iy"]).withColumn("_group", F.explode(F.array_distinct("_groups")))
    return measured(left.select("_group", *here.columns).repartition(groups, "_group").groupBy("_group"),
                    right.select("_group", *index.columns).repartition(groups, "_group").groupBy("_group"))


#: Number of a point row while its candidates are spread over several rows.
ROW = "_row"


def _numbered(points: DataFrame) -> DataFrame:
    """Points with a row number, written once so that the number stays the same if a task is run again."""
    return cut_lineage(points.withColumn(ROW, F.monotonically_increasing_id()))


class Candidates:
    """Candidate segments as arrays: sorted by cell, layer and feature, with the starts of each."""

    def __init__(self, table: pa.Table):
        column = lambda c: table[c].to_numpy()
        ranks, self.names = {}, {}
        for c in ("layer", "fkey"):
            names = table[c].combine_chunks().dictionary_encode() if table.num_rows else None
            if names is None:
                self.names[c], ranks[c] = table[c].combine_chunks(), np.zeros(0, dtype=np.int64)
                continue
            place = pc.sort_indices(names.dictionary).to_numpy()
            rank = np.empty(len(place), dtype=np.int64)
            rank[place] = np.arange(len(place))
            self.names[c], ranks[c] = names.dictionary.take(pa.array(place)), rank[names.indices.to_numpy()]
        cell = (column("ix").astype(np.int64) << 32) + column("iy")
        area = column("is_polygon").astype(bool)
        order = np.lexsort((area, ranks["fkey"], ranks["layer"], cell))
        cell, layer, fkey, area = cell[order], ranks["layer"][order], ranks["fkey"][order], area[order]
        self.x1, self.y1 = column("x1")[order], column("y1")[order]
        x2, self.y2 = column("x2")[order], column("y2")[order]
        self.dx, self.dy = x2 - self.x1, self.y2 - self.y1
        self.length2 = self.dx * self.dx + self.dy * self.dy
        change = lambda *of: np.flatnonzero(np.concatenate([np.ones(min(1, len(cell)), dtype=bool), np.any([np.diff(c) != 0 for c in of], axis=0)]))
        self.feature = change(cell, layer, fkey, area.astype(np.int8))
        self.layer, self.fkey, self.area = layer[self.feature], fkey[self.feature], area[self.feature]
        first = change(cell)
        self.cell = cell[first]
        self.segments = np.append(first, len(cell))
        self.features = np.append(np.searchsorted(self.feature, first), len(self.feature))


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _told(rows: pa.Table, columns: list[str], c: Candidates, layer=(), fkey=(), rank=(), distance=(), inside=(), qlat=(), qlon=(), bearing=None) -> pa.Table:
    """Output rows; ``layer`` and ``fkey`` are places in the candidates' names."""
    at = lambda names, places: names.take(pa.array(places, pa.int64()))
    new = {"layer": at(c.names["layer"], layer), "fkey": at(c.names["fkey"], fkey), "rank": pa.array(rank, pa.int32()), "distance_nm": pa.array(distance, pa.float64()),
           "inside": pa.array(inside, pa.bool_()), "closest_lat": pa.array(qlat, pa.float64()), "closest_lon": pa.array(qlon, pa.float64()),
           "bearing_deg": pa.array([], pa.float64()) if bearing is None else bearing}
    return pa.table([rows[n] for n in columns] + list(new.values()), names=columns + list(new))


def _measure(batch: pa.Table, columns: list[str], c: Candidates, lat: str, lon: str, k: int, max_nm: float | None, planar: bool):
    """Tables of the ``k`` nearest features of every layer for the points of ``batch``."""
    if not len(c.cell):
        return
    cell = (batch["ix"].to_numpy().astype(np.int64) << 32) + batch["iy"].to_numpy()
    place = np.minimum(np.searchsorted(c.cell, cell), len(c.cell) - 1)
    points = np.flatnonzero(c.cell[place] == cell)
    place = place[points]
    y, x = (batch[n].to_numpy().astype(np.float64)[points] for n in (lat, lon))
    upto = np.cumsum(c.segments[place + 1] - c.segments[place])
    start = 0
    while start < len(points):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, side="right")))
        at = slice(start, end)
        row, best = _nearest_of(y[at], x[at], place[at], c, k, max_nm, planar)
        if len(row):
            yield _told(batch.take(pa.array(points[at][row])), columns, c, **best)
        start = end


def _nearest_of(lat: np.ndarray, lon: np.ndarray, place: np.ndarray, c: Candidates, k: int, max_nm: float | None, planar: bool) -> tuple[np.ndarray, dict]:
    """Rows of the points and their ``k`` nearest features of every layer; ``place`` is a point's cell in ``c``."""
    first, size = c.segments[place], c.segments[place + 1] - c.segments[place]
    s, p = _runs(first, size), np.repeat(np.arange(len(lat)), size)
    n_features = c.features[place + 1] - c.features[place]
    f, owner = _runs(c.features[place], n_features), np.repeat(np.arange(len(lat)), n_features)
    # place of each feature's first segment among the pairs
    head = c.feature[f] + np.repeat(np.cumsum(size) - size - first, n_features)
    length = np.diff(np.append(head, len(s)))
    px, py = lon[p], lat[p]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(c.length2[s] == 0, 0.0, np.clip(((px - c.x1[s]) * c.dx[s] + (py - c.y1[s]) * c.dy[s]) / c.length2[s], 0.0, 1.0))
        qx, qy = c.x1[s] + t * c.dx[s], c.y1[s] + t * c.dy[s]
        d2 = (px - qx) * (px - qx) + (py - qy) * (py - qy)
        # the least (d2, x, y), so that a corner two segments share counts once
        least = np.minimum.reduceat(d2, head)
        qx = np.where(d2 == np.repeat(least, length), qx, np.inf)
        east = np.minimum.reduceat(qx, head)
        qy = np.minimum.reduceat(np.where(qx == np.repeat(east, length), qy, np.inf), head)
        inside = c.area[f]
        if inside.any():
            crossed = ((c.y1[s] > py) != (c.y2[s] > py)) & (px < c.dx[s] * (py - c.y1[s]) / c.dy[s] + c.x1[s])
            inside = inside & (np.add.reduceat(crossed.astype(np.int64), head) % 2 == 1)
    y, x = lat[owner], lon[owner]
    distance = np.where(inside, 0.0, np.sqrt(least) if planar else geo.haversine_nm_array(y, x, qy, east))
    # Equal distances to nine places are ordered by feature key, as the candidates are.
    shown = np.round(distance, 9)
    layer = c.layer[f]
    begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (layer[1:] != layer[:-1])]))
    count = np.diff(np.append(begin, len(f)))
    group = np.repeat(np.arange(len(begin)), count)
    if k == 1:
        hit = np.flatnonzero(shown == np.minimum.reduceat(shown, begin)[group])
        best = hit[np.concatenate([[True], np.diff(group[hit]) != 0])]
        rank = np.ones(len(best), dtype=np.int32)
    else:
        best = np.lexsort((shown, group))
        rank = (np.arange(len(best)) - np.repeat(begin, count) + 1).astype(np.int32)
        best, rank = best[rank <= k], rank[rank <= k]
    if max_nm is not None:
        near = distance[best] <= max_nm
        best, rank = best[near], rank[near]
    y, x, inside, distance = y[best], x[best], inside[best], distance[best]
    qlat, qlon = np.where(inside, y, qy[best]), np.where(inside, x, east[best])
    # Within a millionth of a mile the direction is numerical noise.
    bearing = pa.array(geo.bearing_deg_array(y, x, qlat, qlon), pa.float64(), mask=~(distance > 1e-6))
    return owner[best], {"layer": layer[best], "fkey": c.fkey[f[best]], "rank": rank, "distance": distance, "inside": inside, "qlat": qlat, "qlon": qlon, "bearing": bearing}


def polygons_containing(points: DataFrame, segments: DataFrame, lat: str = "lat", lon: str = "lon",
                        size: float = 0.15625, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every (point, polygon) pair with the point inside (even-odd over all rings).

    Each edge is handed to the cells of its own latitude band between the polygon's west
    side and the edge, so a point meets, by one equi-join on its cell, exactly the edges
    an eastward ray could cross. Few edges: the packed cells are broadcast.
    """
    edges = segments.where("is_polygon")
    boxes = edges.groupBy("layer", "fkey").agg(F.min(F.least("x1", "x2")).alias("bx1"))
    occupied = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()) \
        .select(_cell(lon, size).alias("ix"), _cell(lat, size).alias("iy")).distinct()
    cells = (
        edges.join(boxes, ["layer", "fkey"])
        .withColumn("iy", F.explode(F.sequence(_cell(F.least("y1", "y2"), size), _cell(F.greatest("y1", "y2"), size))))
        .withColumn("ix", F.explode(F.sequence(_cell("bx1", size), _cell(F.greatest("x1", "x2"), size))))
        .join(occupied, ["ix", "iy"], "left_semi")
        .select("ix", "iy", "layer", "fkey", "x1", "y1", "x2", "y2")
    )
    place = {"ix": _cell(lon, size), "iy": _cell(lat, size)}
    if at_most(cells, broadcast_rows):
        packed = cells.groupBy("ix", "iy", "layer", "fkey") \
            .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
        hits = points.withColumns(place).join(F.broadcast(packed), ["ix", "iy"]) \
            .where(geo.odd_crossings(F.col(lon), F.col(lat), F.col("_edges")))
        return hits.select(*points.columns, "layer", "fkey")
    pairs = _numbered(points).withColumns(place).join(cells, ["ix", "iy"]).where(geo.crosses_ray(lon, lat, "x1", "y1", "x2", "y2"))
    return pairs.groupBy(ROW, "layer", "fkey").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in points.columns]) \
        .where(F.col("_n") % 2 == 1).select(*points.columns, "layer", "fkey")
