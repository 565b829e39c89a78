"""Polygon masks against the even-odd rule at every cell centre."""

import math
import random

from pyspark.sql import functions as F

from pelagia.operators import routing
from pelagia.plans.raster import Lattice, polygon_cells

SEG = "layer string, fkey int, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double, is_polygon boolean"
GRID = Lattice(37, 53, 8.0, 78.0, 0.05, 0.04, lambda i: F.lit(8.0) + i * F.lit(0.05), lambda j: F.lit(78.0) + j * F.lit(0.04))


def rings(seed):
    r, out = random.Random(seed), []
    for fkey in range(6):
        for ring in range(1 + fkey % 3):  # holes and second parts
            n, cx, cy, size = r.randint(3, 60), 78 + 2.1 * r.random(), 8 + 1.8 * r.random(), r.choice([0.02, 0.3, 1.5])
            pts = [(cx + size * (0.4 + r.random()) * math.cos(2 * math.pi * k / n), cy + size * (0.4 + r.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]
            if fkey == 2:  # corners on cell centres, edges along rows and columns
                pts = [(78.0 + 0.04 * 5, 8.25), (78.0 + 0.04 * 20, 8.25), (78.0 + 0.04 * 20, 8.5), (78.0 + 0.04 * 5, 8.5)]
            out += [("A", fkey, 0, ring, k, *a, *b, True) for k, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1]))]
    big = [(70.0, 0.0), (90.0, 0.0), (90.0, 20.0), (70.0, 20.0)]
    out += [("B", 50, 0, 0, k, *a, *b, True) for k, (a, b) in enumerate(zip(big, big[1:] + big[:1]))]
    far = [(x + 60, y) for x, y in big]
    out += [("B", 51, 0, 0, k, *a, *b, True) for k, (a, b) in enumerate(zip(far, far[1:] + far[:1]))]
    return out + [("A", 52, 0, 0, 0, 78.0, 8.0, 79.0, 9.0, False)]


def test_every_cell_centre(spark):
    for seed in (1, 2):
        segs = rings(seed)
        got = {(r.fkey, r.i, r.j) for r in polygon_cells(spark.createDataFrame(segs, SEG), GRID).collect()}
        want = set()
        for i in range(GRID.rows):
            for j in range(GRID.columns):
                lat, lon, odd = 8.0 + i * 0.05, 78.0 + j * 0.04, {}
                for _, fkey, _, _, _, x1, y1, x2, y2, polygon in segs:
                    if polygon and (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                        odd[fkey] = not odd.get(fkey, False)
                want |= {(f, i, j) for f, x in odd.items() if x}
        assert got == want and any(f == 50 for f, _, _ in got) and not any(f == 51 for f, _, _ in got)


def test_absent_layers_are_named(spark):
    cells = spark.range(GRID.rows * GRID.columns).select((F.col("id") / GRID.columns).cast("int").alias("i"), (F.col("id") % GRID.columns).cast("int").alias("j"),
                                                        F.lit(1.0).alias("hs"), F.lit(None).cast("double").alias("wind"), F.lit(8.0).alias("period"), F.lit(20.0).alias("depth"), F.lit(None).cast("double").alias("boundary_nm"))
    marked, absent = routing.masks(cells, spark.createDataFrame(rings(1), SEG), GRID, ["COAST"], ["B"])
    assert absent == ["coastline"] and marked.where("land").count() == 0 and marked.where("exclusion").count() == GRID.rows * GRID.columns
    named = routing.cost_terms(marked, 1.2, [*absent, "bathymetry"]).select("missing").distinct().collect()
    assert [r.missing for r in named] == ["wind,current,coastline,bathymetry"]
