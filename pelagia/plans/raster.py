"""Polygons to the cells of a regular lattice by scan lines.

Every edge gives one crossing for each lattice row it straddles: the column up to which an eastward ray would meet it. A
polygon's crossings of a row, sorted, bound the stretches of cells inside it, so a cell costs nothing until it is known to be
inside. A cell is inside by its centre and by the even-odd rule over all rings, exactly as in the point-in-polygon join.

Crossings of one row and polygon that fall on the same column cancel in pairs before they are gathered; what is left is at most
one for each column of the lattice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Lattice:
    """Rows and columns with evenly spaced centres; ``lat`` and ``lon`` give the centre of a row or column as the cells have it."""

    rows: int
    columns: int
    first_lat: float
    first_lon: float
    lat_step: float
    lon_step: float
    lat: Callable[[Column], Column]
    lon: Callable[[Column], Column]


def polygon_cells(segments: DataFrame, lattice: Lattice) -> DataFrame:
    """``layer``, ``fkey``, ``i``, ``j``: the lattice cells whose centre lies inside each polygon of ``segments``.

    ``segments`` has layer, fkey, is_polygon, x1, y1, x2, y2; lines are left out, as are edges with a null end.
    """
    place = lambda c, first, step: (c - F.lit(first)) / F.lit(step)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    # one row to spare on either side, then the rule itself decides
    start = F.greatest(F.floor(place(low, lattice.first_lat, lattice.lat_step)) - 1, F.lit(0))
    stop = F.least(F.ceil(place(high, lattice.first_lat, lattice.lat_step)) + 1, F.lit(lattice.rows - 1))
    edges = segments.where("is_polygon AND y1 <> y2 AND x1 IS NOT NULL AND x2 IS NOT NULL").select("layer", "fkey", "x1", "y1", "x2", "y2", start.alias("_a"), stop.alias("_b")).where("_a <= _b")
    lined = edges.withColumn("i", F.explode(F.sequence(F.col("_a").cast("int"), F.col("_b").cast("int"))))
    lat = lattice.lat(F.col("i"))
    crossed = lined.where((F.col("y1") > lat) != (F.col("y2") > lat)).select(
        "layer", "fkey", "i", ((F.col("x2") - F.col("x1")) * (lat - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("x"))
    # how many columns have their centre west of the crossing: the guess is off by one at most
    guess = F.ceil(place(F.col("x"), lattice.first_lon, lattice.lon_step)).cast("int")
    west = lambda k: (lattice.lon(k) < F.col("x")).cast("int")
    until = guess - 1 + west(guess - 1) + west(guess)
    events = crossed.select("layer", "fkey", "i", F.greatest(F.lit(0), F.least(F.lit(lattice.columns), until)).alias("c")) \
        .groupBy("layer", "fkey", "i", "c").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    rows = events.groupBy("layer", "fkey", "i").agg(F.array_sort(F.collect_list("c")).alias("c"))
    # the last two crossings bound a stretch, the two before them the next one west of it; a first one left over starts at the edge
    whole = F.when(F.size("c") % 2 == 1, F.concat(F.array(F.lit(0)), "c")).otherwise(F.col("c"))
    stretches = F.transform(F.sequence(F.lit(0), F.size("c") - 1, F.lit(2)), lambda k: F.struct(F.get("c", k).alias("a"), (F.get("c", k + 1) - 1).alias("b")))
    filled = rows.select("layer", "fkey", "i", whole.alias("c")).select("layer", "fkey", "i", F.inline(stretches)).where("a <= b")
    return filled.select("layer", "fkey", "i", F.explode(F.sequence("a", "b")).alias("j"))
