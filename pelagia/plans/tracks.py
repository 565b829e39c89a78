"""Sampled tracks against large features: nearest boundary point and inside test at every step.

A feature's rings are cut into pieces of consecutive segments. Of a piece a header is kept: its box and the height of its two
ends. A track meets only the pieces near it; what a piece further off adds to the inside test follows from its header,
because an eastward ray crosses a connected piece that lies wholly to the east an odd number of times exactly if the piece's ends lie on
different sides of the ray. Inside a piece, leaves of a few segments with a box each are discarded by their distance.

Nearest means least planar distance in degrees, as everywhere in the fence checks. The closest point at the start lies on
the feature, so at any step nothing further off than that point can win.

Are the segments few (rows are counted), they are sent to every task once and each row is walked where it is (:func:`walked_values`): no row
per piece, no list of distances leaves the task. Otherwise rows and pieces meet by :func:`track_distances`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pelagia.functions import geo
from pelagia.session import BROADCAST_ROWS, at_most, cut_lineage

#: Segments of a piece and of a leaf at most.
PIECE, LEAF = 4096, 16
#: Track rows of a piece in one task, and points compared with its leaves at a time.
PER_TASK, POINTS = 20_000, 8_192
#: Headers up to which they are broadcast (about 100 B each).
HEADERS_BROADCAST = 100_000
#: Features of up to so many segments are measured together, in so many (step, segment) pairs and rows at a time: what fits a core's cache.
SMALL, PAIRS, ROWS = 256, 16_000, 400

STEPS_TYPE = "ARRAY<STRUCT<d2: DOUBLE, nm: DOUBLE, n: INT>>"


def pieces_of(segments: DataFrame, size: int) -> DataFrame:
    """Pieces of ``segments`` (layer, fkey, is_polygon, part, ring, seq, x1, y1, x2, y2): ``segs`` in order and the header's columns."""
    held = (segments.withColumn("no", F.floor(F.col("seq") / size)).groupBy("layer", "fkey", "is_polygon", "part", "ring", "no")
            .agg(F.array_sort(F.collect_list(F.struct("seq", "x1", "y1", "x2", "y2"))).alias("segs"),
                 F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"),
                 F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("y1", "y2")).alias("north")))
    first, last = F.get("segs", F.lit(0)), F.get("segs", F.size("segs") - 1)
    joined = F.forall(F.sequence(F.lit(0), F.size("segs") - 1), lambda k: (k == 0) | (
        (F.get("segs", k)["x1"] == F.get("segs", k - 1)["x2"]) & (F.get("segs", k)["y1"] == F.get("segs", k - 1)["y2"])))
    return held.select("*", first["y1"].alias("from_y"), last["y2"].alias("to_y"), joined.alias("joined"),
                       F.xxhash64("layer", "fkey", "part", "ring", "no").alias("piece"))


def sampled(lat, lon, heading, speed, horizon_s: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes of the steps (rows by steps) of dead reckoning."""
    seconds = horizon_s * np.arange(1, steps + 1) / steps
    reach = np.asarray(speed)[:, None] * geo.METRES_PER_NM * seconds / 3600.0 / geo.EARTH_RADIUS_M
    p, course = np.radians(np.asarray(lat))[:, None], np.radians(np.asarray(heading))[:, None]
    to = np.arcsin(np.sin(p) * np.cos(reach) + np.cos(p) * np.sin(reach) * np.cos(course))
    turn = np.radians(np.asarray(lon))[:, None] + np.arctan2(np.sin(course) * np.sin(reach) * np.cos(p), np.cos(reach) - np.sin(p) * np.sin(to))
    return np.degrees(to), np.mod(np.degrees(turn) + 540.0, 360.0) - 180.0


class Piece:
    """Segments of a piece under a row of leaves."""

    def __init__(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray):
        self.x1, self.y1, self.x2, self.y2 = x1, y1, x2, y2
        self.start = np.arange(0, len(self.x1), LEAF)
        low, high = lambda a, b: np.minimum.reduceat(np.minimum(a, b), self.start), lambda a, b: np.maximum.reduceat(np.maximum(a, b), self.start)
        self.west, self.east, self.south, self.north = low(self.x1, self.x2), high(self.x1, self.x2), low(self.y1, self.y2), high(self.y1, self.y2)

    def _pairs(self, point: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.minimum(LEAF, len(self.x1) - self.start[leaf])
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(point, size), np.repeat(self.start[leaf], size) + at

    def nearest(self, lat: np.ndarray, lon: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least squared planar distance, and the great-circle distance to that point; infinite where it is more than ``most``."""
        d2, nm = np.full(len(lat), np.inf), np.full(len(lat), np.inf)
        dx = np.maximum(np.maximum(self.west - lon[:, None], lon[:, None] - self.east), 0)
        dy = np.maximum(np.maximum(self.south - lat[:, None], lat[:, None] - self.north), 0)
        p, k = self._pairs(*np.nonzero(dx * dx + dy * dy <= most[:, None]))
        if not len(p):
            return d2, nm
        x1, y1 = self.x1[k], self.y1[k]
        vx, vy = self.x2[k] - x1, self.y2[k] - y1
        size = vx * vx + vy * vy
        t = np.where(size == 0, 0.0, np.clip(((lon[p] - x1) * vx + (lat[p] - y1) * vy) / np.where(size == 0, 1.0, size), 0.0, 1.0))
        qx, qy = x1 + t * vx, y1 + t * vy
        far = (lon[p] - qx) ** 2 + (lat[p] - qy) ** 2
        order = np.lexsort((far, p))
        first = order[np.concatenate([[True], np.diff(p[order]) > 0])]
        d2[p[first]] = far[first]
        nm[p[first]] = geo.haversine_nm_array(lat[p[first]], lon[p[first]], qy[first], qx[first])
        return d2, nm

    def crossings(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """How many segments an eastward ray from each point crosses."""
        height = (lat[:, None] >= self.south) & (lat[:, None] <= self.north)
        p, k = self._pairs(*np.nonzero(height & (lon[:, None] <= self.east)))
        up, down = self.y1[k] > lat[p], self.y2[k] > lat[p]
        across = up != down
        p, k = p[across], k[across]
        hit = lon[p] < (self.x2[k] - self.x1[k]) * (lat[p] - self.y1[k]) / (self.y2[k] - self.y1[k]) + self.x1[k]
        return np.bincount(p[hit], minlength=len(lat))


def track_distances(rows: DataFrame, segments: DataFrame, key: list[str], horizon_s: float, steps: int, piece: int = PIECE) -> DataFrame:
    """``key``, ``layer``, ``fkey``, ``nm`` (distance at each step, 0 inside) for each of ``rows``.

    ``rows`` has the key, layer, fkey, lat, lon, heading_deg, speed_kn and the closest point of the feature at the start,
    closest_lat and closest_lon (or the row's own place, for one inside, whose distances outside are then not told: infinite);
    where these are null or absent every piece is met.
    A feature without segments gives no row.
    """
    pieces = cut_lineage(pieces_of(segments, piece))
    box = ["west", "east", "south", "north"]
    heads = pieces.groupBy("layer", "fkey", "is_polygon").agg(F.collect_list(F.struct("piece", *box, "from_y", "to_y", "joined")).alias("heads"))
    if at_most(pieces, HEADERS_BROADCAST):
        heads = F.broadcast(heads)
    given = key + ["layer", "fkey", "lat", "lon", "heading_deg", "speed_kn", "closest_lat", "closest_lon"]
    for c in ("closest_lat", "closest_lon"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("double"))
    # the track's box with some room, all longitudes where it may pass a pole or the date line
    high = F.col("speed_kn") * F.lit(horizon_s / 3600.0 / geo.NM_PER_DEGREE * 1.01) + 1e-6
    top = F.abs("lat") + high
    wide = F.when(top < 89, high / F.cos(F.radians(top))).otherwise(F.lit(360.0))
    whole = (F.col("lon") - wide < -180) | (F.col("lon") + wide > 180)
    walls = rows.select(*given).withColumns({
        "_w": F.when(whole, F.lit(-180.0)).otherwise(F.col("lon") - wide), "_e": F.when(whole, F.lit(180.0)).otherwise(F.col("lon") + wide),
        "_s": F.col("lat") - high, "_n": F.col("lat") + high})
    off = F.greatest(F.abs(F.col("_w") - F.col("closest_lon")), F.abs(F.col("_e") - F.col("closest_lon"))), F.greatest(
        F.abs(F.col("_s") - F.col("closest_lat")), F.abs(F.col("_n") - F.col("closest_lat")))
    room = F.sqrt(off[0] * off[0] + off[1] * off[1]) + 1e-9
    met = walls.withColumn("_room", F.coalesce(room, F.lit(1e6))).join(heads, ["layer", "fkey"])
    close = lambda h: ((h["west"] <= F.col("_e") + F.col("_room")) & (h["east"] >= F.col("_w") - F.col("_room"))
                       & (h["south"] <= F.col("_n") + F.col("_room")) & (h["north"] >= F.col("_s") - F.col("_room")) | ~h["joined"])
    near = F.filter("heads", close)
    met = met.withColumn("_near", F.when(F.size(near) > 0, near).otherwise(F.slice("heads", 1, 1)))
    beyond = F.filter("heads", lambda h: ~F.exists("_near", lambda o: o["piece"] == h["piece"]) & (h["east"] > F.col("_w")) & (h["south"] <= F.col("_n")) & (h["north"] >= F.col("_s")))
    beyond = F.transform(F.when(F.col("is_polygon"), beyond), lambda h: F.struct(h["west"].alias("west"), h["from_y"].alias("from_y"), h["to_y"].alias("to_y")))
    walks = met.withColumn("_beyond", beyond).select(*given, "is_polygon", F.posexplode(F.transform("_near", lambda h: h["piece"])).alias("_k", "piece"), "_beyond")
    walks = cut_lineage(walks.withColumn("_beyond", F.when(F.col("_k") == 0, F.col("_beyond"))).drop("_k"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = [*key, "layer", "fkey"]

    def step(group: tuple, frame: pd.DataFrame, shown: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(shown):
            return pd.DataFrame({c: [] for c in [*out, "is_polygon", "steps"]})
        part, told = Piece(*(np.array([s[c] for s in shown["segs"].iloc[0]], dtype=np.float64) for c in ("x1", "y1", "x2", "y2"))), []
        for at in range(0, len(frame), POINTS // steps + 1):
            some = frame.iloc[at:at + POINTS // steps + 1]
            lat, lon = sampled(some["lat"], some["lon"], some["heading_deg"], some["speed_kn"], horizon_s, steps)
            most = (lon - some["closest_lon"].to_numpy()[:, None]) ** 2 + (lat - some["closest_lat"].to_numpy()[:, None]) ** 2
            d2, nm = part.nearest(lat.ravel(), lon.ravel(), np.where(np.isnan(most), np.inf, most * (1 + 1e-9) + 1e-18).ravel())
            n = (part.crossings(lat.ravel(), lon.ravel()) if bool(some["is_polygon"].iloc[0]) else np.zeros(lat.size, dtype=np.int64)).reshape(lat.shape)
            for i, others in enumerate(some["_beyond"]):
                for h in () if others is None else others:
                    n[i] += ((h["from_y"] > lat[i]) != (h["to_y"] > lat[i])) & (h["west"] > lon[i])
            for x, y, z in zip(d2.reshape(lat.shape).tolist(), nm.reshape(lat.shape).tolist(), n.tolist()):
                told.append([{"d2": a, "nm": b, "n": c} for a, b, c in zip(x, y, z)])
        return frame[[*out, "is_polygon"]].assign(steps=told)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = walks.groupBy("piece").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).cast("int").alias("_parts"))
    left = walks.join(sizes, "piece").withColumn("_part", F.pmod(F.xxhash64(*key), F.col("_parts")).cast("int")).drop("_parts")
    right = pieces.select("piece", "segs").join(sizes, "piece").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    done = left.repartition(parts, "piece", "_part").groupBy("piece", "_part").cogroup(right.repartition(parts, "piece", "_part").groupBy("piece", "_part")).applyInPandas(
        step, ", ".join(f"`{c}` {types[c]}" for c in out) + f", is_polygon BOOLEAN, steps {STEPS_TYPE}")
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(
        F.least(F.struct(x["d2"], x["nm"]), F.struct(y["d2"], y["nm"]))["d2"].alias("d2"),
        F.least(F.struct(x["d2"], x["nm"]), F.struct(y["d2"], y["nm"]))["nm"].alias("nm"), (x["n"] + y["n"]).alias("n")))
    whole_row = done.groupBy(*out, "is_polygon").agg(F.collect_list("steps").alias("_all")).withColumn(
        "_steps", F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))), F.get("_all", F.lit(0)), both))
    inside = lambda s: F.col("is_polygon") & (s["n"] % 2 == 1)
    return whole_row.select(*out, F.transform("_steps", lambda s: F.when(inside(s), F.lit(0.0)).otherwise(s["nm"])).alias("nm"))


def segments_held(segments: DataFrame, most: int = BROADCAST_ROWS) -> pa.Table | None:
    """The segments as a table to be sent to every task; None where they are more than ``most``, have gaps, or a feature is of two kinds."""
    told = segments.where(F.col("layer").isNotNull() & F.col("fkey").isNotNull()).select("layer", "fkey", "is_polygon", "part", "ring", "seq", "x1", "y1", "x2", "y2")
    if not at_most(told, most):
        return None
    table = told.toArrow()
    kinds = table.group_by(["layer", "fkey"]).aggregate([("is_polygon", "count_distinct")])["is_polygon_count_distinct"]
    return None if any(table[c].null_count for c in table.column_names) or (pc.max(kinds).as_py() or 0) > 1 else table


class Features:
    """Segments of whole features as arrays, sorted by feature and piece."""

    def __init__(self, table: pa.Table, piece: int):
        column = lambda c: table[c].to_numpy()
        self.names = {c: pc.unique(table[c]) for c in ("layer", "fkey")}
        code, seq = self._codes(table), column("seq")
        rings = [code, column("part"), column("ring"), seq // piece]
        ends = [column(c).astype(np.float64) for c in ("x1", "y1", "x2", "y2")]
        order = np.lexsort([*reversed(ends), seq, *reversed(rings)])
        rings = [c[order] for c in rings]
        self.x1, self.y1, self.x2, self.y2 = (c[order] for c in ends)
        self.dx, self.dy = self.x2 - self.x1, self.y2 - self.y1
        self.length2 = self.dx * self.dx + self.dy * self.dy
        change = lambda of: np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), dtype=bool), np.any([c[1:] != c[:-1] for c in of], axis=0)]))
        self.first, self.piece = change(rings[:1]), change(rings)
        self.code, self.area = rings[0][self.first], column("is_polygon").astype(bool)[order][self.first]
        self.size = np.diff(np.append(self.first, len(order)))
        self.first_piece = np.searchsorted(self.piece, self.first)
        self.pieces = np.diff(np.append(self.first_piece, len(self.piece)))
        self._large: dict[int, list[Piece]] = {}

    def _codes(self, table: pa.Table) -> np.ndarray:
        layer, fkey = (pc.fill_null(pc.index_in(table[c], value_set=self.names[c]), -1).to_numpy().astype(np.int64) for c in ("layer", "fkey"))
        return np.where((layer < 0) | (fkey < 0), -1, layer * len(self.names["fkey"]) + fkey)

    def find(self, table: pa.Table) -> np.ndarray:
        """Place of each row's feature; -1 where it has no segments."""
        if not len(self.code):
            return np.full(table.num_rows, -1)
        code = self._codes(table)
        place = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[place] == code, place, -1)

    def distances(self, feature: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Distance of each step (rows by steps) to the row's feature, 0 inside."""
        nm = np.empty(lat.shape)
        small = np.flatnonzero(self.size[feature] <= SMALL)
        upto = np.cumsum(self.size[feature[small]] * lat.shape[1])
        start = 0
        while start < len(small):
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, side="right")))
            at = small[start:end]
            nm[at] = self._together(np.repeat(feature[at], lat.shape[1]), lat[at].ravel(), lon[at].ravel()).reshape(-1, lat.shape[1])
            start = end
        for f in np.unique(feature[self.size[feature] > SMALL]):
            rows = np.flatnonzero(feature == f)
            for start in range(0, len(rows), POINTS // lat.shape[1] + 1):
                at = rows[start:start + POINTS // lat.shape[1] + 1]
                nm[at] = self._by_leaves(f, lat[at].ravel(), lon[at].ravel()).reshape(-1, lat.shape[1])
        return nm

    def _together(self, feature: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        first, size, pieces = self.first[feature], self.size[feature], self.pieces[feature]
        runs = lambda begin, n: np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
        begin = np.cumsum(size) - size
        s = runs(first, size)
        px, py = np.repeat(lon, size), np.repeat(lat, size)
        x1, y1, dx, dy, length2 = self.x1[s], self.y1[s], self.dx[s], self.dy[s], self.length2[s]
        t = np.where(length2 == 0, 0.0, np.clip(((px - x1) * dx + (py - y1) * dy) / np.where(length2 == 0, 1.0, length2), 0.0, 1.0))
        qx, qy = x1 + t * dx, y1 + t * dy
        d2 = (px - qx) ** 2 + (py - qy) ** 2
        d2 = np.where(np.isnan(d2), np.inf, d2)
        # of a piece the first of its nearest segments, of the pieces the least distance
        head = self.piece[runs(self.first_piece[feature], pieces)] + np.repeat(begin - first, pieces)
        length = np.diff(np.append(head, len(s)))
        least = np.minimum.reduceat(d2, head)
        hit = np.flatnonzero(d2 == np.repeat(least, length))
        of = np.repeat(np.arange(len(head)), length)[hit]
        hit = hit[np.concatenate([[True], of[1:] != of[:-1]])]
        nm = np.where(np.isinf(least), np.inf, geo.haversine_nm_array(py[hit], px[hit], qy[hit], qx[hit]))
        if len(head) > len(feature):
            row = np.cumsum(pieces) - pieces
            best = np.minimum.reduceat(least, row)
            nm = np.minimum.reduceat(np.where(least == np.repeat(best, pieces), nm, np.inf), row)
        area = self.area[feature]
        if area.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                crossed = ((y1 > py) != (self.y2[s] > py)) & (px < dx * (py - y1) / dy + x1)
            nm[area & (np.add.reduceat(crossed.astype(np.int64), begin) % 2 == 1)] = 0.0
        return nm

    def _by_leaves(self, f: int, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        if f not in self._large:
            starts = np.append(self.piece[self.first_piece[f]:self.first_piece[f] + self.pieces[f]], self.first[f] + self.size[f])
            self._large[f] = [Piece(self.x1[a:b], self.y1[a:b], self.x2[a:b], self.y2[a:b]) for a, b in zip(starts[:-1], starts[1:])]
        d2, nm, n = np.full(len(lat), np.inf), np.full(len(lat), np.inf), np.zeros(len(lat), dtype=np.int64)
        # a corner of the feature is a first bound of how far its nearest point may be
        most = (lon - self.x1[self.first[f]]) ** 2 + (lat - self.y1[self.first[f]]) ** 2
        for part in self._large[f]:
            a, b = part.nearest(lat, lon, np.where(np.isnan(most), np.inf, most * (1 + 1e-9) + 1e-18))
            closer = (a < d2) | ((a == d2) & (b < nm))
            d2, nm, most = np.where(closer, a, d2), np.where(closer, b, nm), np.fmin(most, a)
            if self.area[f]:
                n += part.crossings(lat, lon)
        return np.where(n % 2 == 1, 0.0, nm)


def walked_values(rows: DataFrame, walks: Column, held: pa.Table, horizon_s: float, steps: int, name: str, fold: Callable[[np.ndarray, np.ndarray], np.ndarray],
                  start: str, piece: int = PIECE) -> DataFrame:
    """``rows`` with a column ``name``: what ``fold`` makes of the distances (rows by steps, 0 inside) and the column ``start``.

    Null (as where ``fold`` gives NaN) in rows that do not meet ``walks`` or whose feature is not in ``held``, see :func:`segments_held`.
    """
    columns, sent = list(rows.columns), rows.sparkSession.sparkContext.broadcast(held)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields) + f"`{name}` DOUBLE"

    def each(batches):
        features = Features(sent.value, piece)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            told, feature = np.full(table.num_rows, np.nan), features.find(table)
            walking = np.flatnonzero(table["_walks"].to_numpy() & (feature >= 0))
            place = [table[c].cast(pa.float64()).to_numpy() for c in ("lat", "lon", "heading_deg", "speed_kn", start)]
            for at in np.split(walking, range(ROWS, len(walking), ROWS)):
                *begun, value = (c[at] for c in place)
                told[at] = fold(features.distances(feature[at], *sampled(*begun, horizon_s, steps)), value)
            done = table.select(columns).append_column(name, pa.array(told, pa.float64(), mask=np.isnan(told)))
            yield from done.to_batches()

    return rows.withColumn("_walks", walks).mapInArrow(each, schema)
