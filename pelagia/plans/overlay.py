"""Least-cost routes for asked pairs over a tiled lattice.

A tile of the lattice tells once what it costs to cross it: from each of its border cells to each cell just outside. These
tables form a graph over border cells only, and searches run on it: a round carries the values that have improved
one tile further, and drops what costs more than the dearest asked goal of its origin does already. Inner cells are only looked at in the
tiles where a route starts, ends or, once its cost is known, passes; there a route is unpacked tile by tile from its goal.

Values are kept for border cells that were reached, one row for each improvement. No task holds more than a tile and a
bounded number of origins; a tile's table is sent once for that many origins, not once for each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pelagia.functions import geo
from pelagia.session import cut_lineage

TILE = 32
#: Rows (origins, goals or border values) of a tile in one task.
PER_TASK = 20_000
#: Origins settled at a time in a task.
TOGETHER = 64
#: Rounds whose improvements are kept apart before they are merged.
MERGE = 8
#: Values this close are ties.
TIE = 1e-9
MOVES = tuple((a, b) for a in (1, 0, -1) for b in (1, 0, -1) if a or b)  # the cell a move comes from in ascending order

PAIR = ["oi", "oj", "gi", "gj"]
CELL = "i INT, j INT"
VALUE = "oi INT, oj INT, i INT, j INT, g DOUBLE, pg DOUBLE, pi INT, pj INT"


class Tile:
    """Costs of all moves inside a tile and across its border, on a grid with one ring of cells around."""

    def __init__(self, cells, tile: int, ti: int, tj: int):
        side = tile + 2
        self.tile, self.i0, self.j0 = tile, ti * tile - 1, tj * tile - 1
        at = np.array([(c["i"] - self.i0, c["j"] - self.j0) for c in cells], dtype=np.int64).reshape(-1, 2)
        lat, lon, rate = (np.full((side, side), np.nan) for _ in range(3))
        for grid, name in ((lat, "lat"), (lon, "lon"), (rate, "cost")):
            grid[at[:, 0], at[:, 1]] = [c[name] for c in cells]
        open_ = ~np.isnan(rate)
        self.own = np.zeros((side, side), dtype=bool)
        self.own[1:-1, 1:-1] = open_[1:-1, 1:-1]
        self.ring = open_ & ~self.own
        self.step = {}  # cost of the move from a cell, infinite where either end is closed
        for a, b in MOVES:
            to = lambda g: np.roll(g, (-a, -b), (0, 1))  # noqa: B023, E731
            cost = geo.haversine_nm_array(lat, lon, to(lat), to(lon)) * to(rate)
            inside = np.zeros((side, side), dtype=bool)
            inside[max(0, -a):side - max(0, a), max(0, -b):side - max(0, b)] = True
            self.step[a, b] = np.where(inside & open_ & to(open_), cost, np.inf)
        self.ring_at = np.argwhere(self.ring)
        touching = np.zeros((side, side), dtype=bool)
        for a, b in MOVES:
            x, y = self.ring_at[:, 0] + a, self.ring_at[:, 1] + b
            good = (x >= 0) & (x < side) & (y >= 0) & (y < side)
            touching[x[good], y[good]] = True
        self.border_at = np.argwhere(self.own & touching)

    def place(self, i, j) -> tuple:
        return np.asarray(i, dtype=np.int64) - self.i0, np.asarray(j, dtype=np.int64) - self.j0

    def settle(self, values: np.ndarray, back: bool = False) -> np.ndarray:
        """Least costs over moves inside the tile, from (or, with ``back``, to) the cells given, for each layer of ``values``."""
        n = self.tile
        values[:, ~self.own] = np.inf
        while True:
            before = values.copy()
            for a, b in MOVES:
                here = (slice(None), slice(1, n + 1), slice(1, n + 1))
                s = -1 if back else 1
                there = (slice(None), slice(1 - s * a, n + 1 - s * a), slice(1 - s * b, n + 1 - s * b))
                move = self.step[a, b][(here if back else there)[1:]]
                np.minimum(values[here], np.where(self.own[here[1:]], values[there] + move, np.inf), out=values[here])
            if np.array_equal(values, before):
                return values

    def leave(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per layer and ring cell: least cost to enter it from this tile, the value of the cell before it and that cell's
        number in the grid. Of ties the one with the least value, then the least place."""
        x, y = self.ring_at[:, 0], self.ring_at[:, 1]
        side = self.tile + 2
        reach, came = [], []
        for a, b in MOVES:
            px, py = x - a, y - b
            good = (px >= 0) & (px < side) & (py >= 0) & (py < side)
            px, py = np.where(good, px, 0), np.where(good, py, 0)
            v = np.where(good & self.own[px, py], values[:, px, py], np.inf)
            came.append(v)
            reach.append(v + np.where(good, self.step[a, b][px, py], np.inf))
        best = np.min(reach, axis=0)
        before, which = np.full(best.shape, np.inf), np.zeros(best.shape, dtype=np.int64)
        for k, (a, b) in enumerate(MOVES):
            take = (reach[k] <= best + TIE) & np.isfinite(reach[k]) & (np.round(came[k], 9) < np.round(before, 9))
            before = np.where(take, came[k], before)
            which = np.where(take, (x - a) * side + y - b, which)
        return best, before, which

    def fragment(self, values: np.ndarray, entered: dict[tuple[int, int], tuple], at: tuple[int, int], origin: tuple[int, int]):
        """Cells from ``at`` back to the origin or to the last one inside, and the cell outside it came from (or None).

        ``entered`` has per border cell its value on entering from outside, the value of the cell before and that cell.
        """
        path, x, y = [], int(at[0] - self.i0), int(at[1] - self.j0)
        while True:
            here = (x + self.i0, y + self.j0)
            path.append(here)
            if here == origin:
                return path, None
            own = values[x, y]
            fits = []
            for a, b in MOVES:
                p = (x - a, y - b)
                if self.own[p] and values[p] + self.step[a, b][p] <= own + TIE:
                    fits.append((round(values[p], 9), p[0] + self.i0, p[1] + self.j0, False))
            outside = entered.get(here)
            if outside is not None and outside[0] <= own + TIE:
                fits.append((round(outside[1], 9), outside[2], outside[3], True))
            _, i, j, left = min(fits)
            if left:
                return path, (i, j)
            x, y = i - self.i0, j - self.j0


def tiles_of(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """``ti``, ``tj``, ``cells``: the passable cells of each tile and of the ring around it, at most (tile + 2) squared."""
    near = F.array_distinct(F.flatten(F.array(*[F.array(*[F.struct(
        F.floor((F.col("i") + a) / tile).cast("int").alias("ti"), F.floor((F.col("j") + b) / tile).cast("int").alias("tj")) for b in (-1, 0, 1)]) for a in (-1, 0, 1)])))
    return cells.where("blocked IS NULL").select(F.col("i").cast("int"), F.col("j").cast("int"), "cost", "lat", "lon", F.explode(near).alias("_t")).groupBy("_t.ti", "_t.tj").agg(
        F.collect_list(F.struct("i", "j", "cost", "lat", "lon")).alias("cells"))


def _tile_columns(df: DataFrame, i: str, j: str, tile: int) -> DataFrame:
    return df.withColumns({"ti": F.floor(F.col(i) / tile).cast("int"), "tj": F.floor(F.col(j) / tile).cast("int")})


def _at_tiles(rows: DataFrame, tiles: DataFrame, spread: list[str], step: Callable, schema: str) -> DataFrame:
    """``step(key, rows of a tile, the tile's row)`` for each tile that has rows; a tile with many is dealt out by ``spread``.

    Few bytes but much work: the number of partitions is set, not left to their size.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("ti", "tj").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).cast("int").alias("_parts"))
    left = rows.join(sizes, ["ti", "tj"]).withColumn("part", F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int")).drop("_parts")
    right = tiles.join(sizes, ["ti", "tj"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    key = ["ti", "tj", "part"]
    return left.repartition(parts, *key).groupBy(*key).cogroup(right.repartition(parts, *key).groupBy(*key)).applyInPandas(step, schema)


def _values(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def overlay(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """Per tile: border cells ``enter``, cells outside ``leave``, and for each pair the least cost ``cost`` from the one into
    the other, the cost ``upto`` the cell before it and that cell ``via`` (flat, border cell by border cell)."""
    pairs = "ARRAY<STRUCT<i: INT, j: INT>>"

    def build(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                t = Tile(row.cells, tile, row.ti, row.tj)
                n = len(t.border_at)
                if not n or not len(t.ring_at):
                    continue
                cost, upto, via = [], [], []
                for at in range(0, n, TOGETHER):
                    some = t.border_at[at:at + TOGETHER]
                    values = np.full((len(some), tile + 2, tile + 2), np.inf)
                    values[np.arange(len(some)), some[:, 0], some[:, 1]] = 0.0
                    for held, got in zip((cost, upto, via), t.leave(t.settle(values))):
                        held.append(got.ravel())
                named = lambda cells: [{"i": int(x) + t.i0, "j": int(y) + t.j0} for x, y in cells]  # noqa: B023, E731
                out.append((row.ti, row.tj, named(t.border_at), named(t.ring_at), *(np.concatenate(x).tolist() for x in (cost, upto, via))))
            yield pd.DataFrame(out, columns=["ti", "tj", "enter", "leave", "cost", "upto", "via"])

    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(parts, "ti", "tj").mapInPandas(
        build, f"ti INT, tj INT, enter {pairs}, leave {pairs}, cost ARRAY<DOUBLE>, upto ARRAY<DOUBLE>, via ARRAY<INT>")


class Routes:
    """Least costs and paths for asked pairs of passable cells.

    ``cells`` has i, j, cost, lat, lon and blocked (null: passable); entering a cell costs its rate times the distance. ``pairs``
    has oi, oj (origin) and gi, gj (goal), repeats allowed; pairs with a null or a closed cell have no route.
    """

    def __init__(self, cells: DataFrame, pairs: DataFrame, tile: int = TILE):
        self.tile = tile
        self.tiles = cut_lineage(tiles_of(cells, tile))
        self.crossing = cut_lineage(overlay(self.tiles, tile))
        free = cells.where("blocked IS NULL").select(F.col("i").cast("int"), F.col("j").cast("int"))
        end = lambda a, b: free.select(F.col("i").alias(a), F.col("j").alias(b))
        asked = pairs.select(*[F.col(c).cast("int") for c in PAIR]).distinct()
        self.pairs = cut_lineage(asked.join(end("oi", "oj"), ["oi", "oj"]).join(end("gi", "gj"), ["gi", "gj"]).select(*PAIR))
        self.best, self.reached = self._search()

    # ---- steps inside tiles ----

    def _leave_origins(self) -> DataFrame:
        tile = self.tile

        def step(key, frame: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(frame) and len(tiles):
                t = Tile(tiles["cells"].iloc[0], tile, key[0], key[1])
                for at in range(0, len(frame), TOGETHER):
                    some = frame.iloc[at:at + TOGETHER]
                    values = np.full((len(some), tile + 2, tile + 2), np.inf)
                    x, y = t.place(some["oi"], some["oj"])
                    values[np.arange(len(some)), x, y] = 0.0
                    out += _leaving(t.leave(t.settle(values)), some["oi"].tolist(), some["oj"].tolist(), [(int(a) + t.i0, int(b) + t.j0) for a, b in t.ring_at], t)
            return _values(out, VALUE)

        origins = _tile_columns(self.pairs.select("oi", "oj").distinct(), "oi", "oj", tile)
        return _at_tiles(origins, self.tiles, ["oi", "oj"], step, VALUE)

    def _into_goals(self) -> DataFrame:
        """``gi``, ``gj``, ``i``, ``j``, ``c``: cost inside the goal's tile from its border cells and from origins there."""
        tile, schema = self.tile, "gi INT, gj INT, i INT, j INT, c DOUBLE, inner BOOLEAN"

        def step(key, frame: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(frame) and len(tiles):
                t = Tile(tiles["cells"].iloc[0], tile, key[0], key[1])
                for at in range(0, len(frame), TOGETHER):
                    some = frame.iloc[at:at + TOGETHER]
                    values = np.full((len(some), tile + 2, tile + 2), np.inf)
                    x, y = t.place(some["gi"], some["gj"])
                    values[np.arange(len(some)), x, y] = 0.0
                    t.settle(values, back=True)
                    for k, (gi, gj, starts) in enumerate(zip(some["gi"], some["gj"], some["starts"])):
                        out += [(gi, gj, int(a) + t.i0, int(b) + t.j0, float(values[k, a, b]), False) for a, b in t.border_at if np.isfinite(values[k, a, b])]
                        for s in starts:
                            v = values[k, s["i"] - t.i0, s["j"] - t.j0]
                            if np.isfinite(v):
                                out.append((gi, gj, s["i"], s["j"], float(v), True))
            return _values(out, schema)

        here = lambda a, b: F.floor(F.col(a) / tile) == F.floor(F.col(b) / tile)
        start = F.when(here("oi", "gi") & here("oj", "gj"), F.struct(F.col("oi").alias("i"), F.col("oj").alias("j")))
        goals = self.pairs.groupBy("gi", "gj").agg(F.collect_set(start).alias("starts"))
        return cut_lineage(_at_tiles(_tile_columns(goals, "gi", "gj", tile), self.tiles, ["gi", "gj"], step, schema))

    def _cross(self, improved: DataFrame) -> DataFrame:
        """Values that reach the next tiles from improved border values."""
        tile = self.tile

        def step(key, frame: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(frame) and len(tiles):
                row = tiles.iloc[0]
                number = {(c["i"], c["j"]): k for k, c in enumerate(row["enter"])}
                leave = [(c["i"], c["j"]) for c in row["leave"]]
                cost, upto, via = (np.asarray(row[c]).reshape(len(number), len(leave)) for c in ("cost", "upto", "via"))
                i0, j0, side = key[0] * tile - 1, key[1] * tile - 1, tile + 2
                for (oi, oj), some in frame.groupby(["oi", "oj"], sort=False):
                    at = np.array([number[i, j] for i, j in zip(some["i"], some["j"])])
                    g = some["g"].to_numpy()
                    through = g[:, None] + cost[at]
                    best = through.min(axis=0)
                    before = np.where(through <= best + TIE, g[:, None] + upto[at], np.inf)
                    which = np.round(before, 9).argmin(axis=0)
                    for k in np.flatnonzero(np.isfinite(best)).tolist():
                        p = int(via[at[which[k]], k])
                        out.append((oi, oj, *leave[k], float(best[k]), float(before[which[k], k]), p // side + i0, p % side + j0))
            return _values(out, VALUE)

        return _at_tiles(_tile_columns(improved, "i", "j", tile), self.crossing, ["oi", "oj"], step, VALUE)

    # ---- search ----

    def _search(self) -> tuple[DataFrame, DataFrame]:
        """Cost ``g`` of each pair that has a route, and the values of all border cells reached."""
        into = self._into_goals()
        inner = self.pairs.join(into.where("inner").select("gi", "gj", F.col("i").alias("oi"), F.col("j").alias("oj"), F.col("c").alias("g")), PAIR, "left")
        best = cut_lineage(inner.select(*PAIR, F.coalesce("g", F.lit(float("inf"))).alias("g")))
        ends = cut_lineage(self.pairs.join(into.where("NOT inner").drop("inner"), ["gi", "gj"]))
        value = F.struct("g", "pg", "pi", "pj")
        key = ["oi", "oj", "i", "j"]
        least = lambda df: df.groupBy(*key).agg(F.min_by(value, F.struct(F.round("g", 9), F.round("pg", 9), "pi", "pj")).alias("v")).select(*key, "v.*")
        kept: list[DataFrame] = []
        arrivals = self._leave_origins()
        while True:
            new = least(arrivals)
            if kept:
                known = kept[0] if len(kept) == 1 else _all(kept)
                known = known.groupBy(*key).agg(F.min("g").alias("known"))
                new = new.join(known, key, "left").where(f"known IS NULL OR g < known - {TIE / 10}").drop("known")
            bound = best.groupBy("oi", "oj").agg(F.max("g").alias("bound"))
            improved = cut_lineage(new.join(bound, ["oi", "oj"]).where(f"g <= bound + {TIE}").drop("bound"))
            if not improved.limit(1).count():
                break
            kept.append(improved)
            if len(kept) > MERGE:
                kept = [cut_lineage(least(_all(kept)))]
            told = improved.join(ends, key).select(*PAIR, (F.col("g") + F.col("c")).alias("g"))
            best = cut_lineage(best.unionByName(told).groupBy(*PAIR).agg(F.min("g").alias("g")))
            arrivals = self._cross(improved)
        reached = cut_lineage(least(_all(kept))) if kept else arrivals.limit(0)
        return best.where("g < double('infinity')"), reached

    # ---- unpacking ----

    def paths(self) -> DataFrame:
        """``oi``, ``oj``, ``gi``, ``gj``, ``hop``, ``i``, ``j`` from the origin (hop 0) to the goal.

        Of equally good cells before a cell the one with the least value, then the least place. A round unpacks one tile of
        every route; routes of an origin that pass a cell share what lies before it.
        """
        tile, at = self.tile, ["oi", "oj", "i", "j"]
        cell = "STRUCT<i: INT, j: INT>"
        schema = f"oi INT, oj INT, i INT, j INT, cells ARRAY<{cell}>, before {cell}"

        def step(key, frame: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(frame) and len(tiles):
                t = Tile(tiles["cells"].iloc[0], tile, key[0], key[1])
                for row in frame.itertuples(index=False):
                    values = np.full((1, tile + 2, tile + 2), np.inf)
                    entered = {(v["i"], v["j"]): (v["g"], v["pg"], v["pi"], v["pj"]) for v in row.entered}
                    for (i, j), v in entered.items():
                        values[0, i - t.i0, j - t.j0] = v[0]
                    if (row.oi // tile, row.oj // tile) == (key[0], key[1]):
                        values[0, row.oi - t.i0, row.oj - t.j0] = 0.0
                    t.settle(values)
                    for c in row.wanted:
                        path, before = t.fragment(values[0], entered, (c["i"], c["j"]), (row.oi, row.oj))
                        out.append((row.oi, row.oj, c["i"], c["j"], [{"i": i, "j": j} for i, j in path], None if before is None else {"i": before[0], "j": before[1]}))
            return pd.DataFrame(out, columns=["oi", "oj", "i", "j", "cells", "before"])

        reached = _tile_columns(self.reached, "i", "j", tile).select("oi", "oj", "ti", "tj", F.struct("i", "j", "g", "pg", "pi", "pj").alias("v"))
        front = self.best.select(*PAIR, F.col("gi").alias("i"), F.col("gj").alias("j"), F.lit(0).cast("bigint").alias("back"))
        found: list[DataFrame] = []
        while True:
            front = cut_lineage(front)
            if found and not front.limit(1).count():
                break
            wanted = _tile_columns(front.select(*at).distinct(), "i", "j", tile).groupBy("oi", "oj", "ti", "tj").agg(F.collect_list(F.struct("i", "j")).alias("wanted"))
            entered = reached.join(wanted.select("oi", "oj", "ti", "tj"), ["oi", "oj", "ti", "tj"]).groupBy("oi", "oj", "ti", "tj").agg(F.collect_list("v").alias("entered"))
            asked = cut_lineage(wanted.join(entered, ["oi", "oj", "ti", "tj"], "left").withColumn("entered", F.coalesce("entered", F.array().cast("ARRAY<STRUCT<i: INT, j: INT, g: DOUBLE, pg: DOUBLE, pi: INT, pj: INT>>"))))
            parts = cut_lineage(_at_tiles(asked, self.tiles, ["oi", "oj"], step, schema))
            on = cut_lineage(front.join(parts, at))
            found.append(on.select(*PAIR, F.posexplode("cells").alias("k", "c"), "back").select(*PAIR, (F.col("back") + F.col("k")).alias("back"), "c.i", "c.j"))
            front = on.where("before IS NOT NULL").select(*PAIR, "before.i", "before.j", (F.col("back") + F.size("cells")).alias("back"))
        cells = _all(found)
        last = cells.groupBy(*PAIR).agg(F.max("back").alias("_n"))
        return cells.join(last, PAIR).select(*PAIR, (F.col("_n") - F.col("back")).alias("hop"), "i", "j")


def _leaving(left: tuple, oi: list, oj: list, ring: list[tuple[int, int]], t: Tile) -> list[tuple]:
    best, before, which = left
    side = t.tile + 2
    return [(oi[k], oj[k], *ring[r], float(best[k, r]), float(before[k, r]), int(which[k, r]) // side + t.i0, int(which[k, r]) % side + t.j0)
            for k, r in np.argwhere(np.isfinite(best)).tolist()]


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
