"""Grid cells in long form: lattice, gradient, masks, zones, sampling.

A cell row is (keys..., i, j, lat, lon, value). Neighbour access is a stencil: every cell
is sent to the cells that need it and one aggregation puts them together, so no grid line
is ordered inside a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pelagia.functions import geo
from pelagia.operators.joins import nearest_cell
from pelagia.plans.components import TILE, connected_components
from pelagia.plans.percentile import exact_percentile
from pelagia.session import cut_lineage

# Fixed values.
FRONT_PERCENTILE = 0.85
MIN_ZONE_CELLS = 4
CHL_PERCENTILE = 0.80
SST_BAND = (26.0, 30.5)


def field_summary(cells: DataFrame, keys: list[str], total_cells: int, value: str = "value") -> DataFrame:
    """Mean, minimum, maximum (4 decimals) and the share of cells with a value."""
    return cells.groupBy(*keys).agg(
        F.round(F.avg(value), 4).alias("mean_value"), F.round(F.min(value), 4).alias("min_value"),
        F.round(F.max(value), 4).alias("max_value"), (F.count(value) / F.lit(float(total_cells))).alias("coverage"))


def axis(cells: DataFrame, keys: list[str], index: str, coordinate: str) -> DataFrame:
    """(keys, index, coordinate, low edge, high edge); a table as long as the axis.

    Edges lie midway between centres; the outer ones mirror the neighbouring gap.
    """
    centres = cells.select(*keys, index, coordinate).distinct()
    w = Window.partitionBy(*keys).orderBy(index)
    below, above = F.lag(coordinate).over(w), F.lead(coordinate).over(w)
    c = F.col(coordinate)
    gap_low, gap_high = (c - below) / 2, (above - c) / 2
    return centres.select(
        *keys, index, coordinate,
        (c - F.coalesce(gap_low, gap_high, F.lit(0.5))).alias(coordinate + "_low"),
        (c + F.coalesce(gap_high, gap_low, F.lit(0.5))).alias(coordinate + "_high"))


def with_areas(cells: DataFrame, lattice: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``area_m2`` using the edges of the lattice axes."""
    rows = axis(lattice, keys, "i", "lat").select(*keys, "i", "lat_low", "lat_high")
    cols = axis(lattice, keys, "j", "lon").select(*keys, "j", "lon_low", "lon_high")
    return cells.join(rows, [*keys, "i"]).join(cols, [*keys, "j"]).withColumn(
        "area_m2", geo.cell_area_m2("lat_low", "lat_high", "lon_low", "lon_high", F.col("lat")))


def gradient(cells: DataFrame, keys: list[str], value: str, height: int, width: int, name: str = "gradient") -> DataFrame:
    """Gradient magnitude per kilometre.

    Central differences inside (second order for uneven spacing), one-sided at the grid
    edge; a missing neighbour gives no gradient.
    """
    me = F.struct(F.col("lat"), F.col("lon"), F.col(value).alias("v"))
    moves = F.array(*[F.struct(F.lit(s).alias("side"), (F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"))
                      for s, di, dj in (("here", 0, 0), ("north", -1, 0), ("south", 1, 0), ("east", 0, -1), ("west", 0, 1))])
    sent = cells.where(F.col(value).isNotNull()).select(*keys, me.alias("_me"), F.explode(moves).alias("_to")) \
        .select(*keys, "_to.i", "_to.j", F.col("_to.side").alias("_side"), "_me")
    at = lambda s: F.max(F.when(F.col("_side") == s, F.col("_me"))).alias("_" + s)
    near = sent.groupBy(*keys, "i", "j").agg(*[at(s) for s in ("here", "north", "south", "east", "west")]) \
        .where(F.col("_here").isNotNull())

    def slope(low: str, high: str, c: str, first: Column, last: Column) -> Column:
        f0, f1, f2 = F.col(f"{low}.v"), F.col("_here.v"), F.col(f"{high}.v")
        hs, hd = F.col(f"_here.{c}") - F.col(f"{low}.{c}"), F.col(f"{high}.{c}") - F.col(f"_here.{c}")
        inner = (hs * hs * f2 + (hd * hd - hs * hs) * f1 - hd * hd * f0) / (hs * hd * (hd + hs))
        return F.when(first, (f2 - f1) / hd).when(last, (f1 - f0) / hs).otherwise(inner)

    d_lat = slope("_south", "_north", "lat", F.col("i") == 0, F.col("i") == height - 1)
    d_lon = slope("_west", "_east", "lon", F.col("j") == 0, F.col("j") == width - 1)
    dy = d_lat / F.lit(geo.METRES_PER_DEGREE)
    dx = d_lon / (F.lit(geo.METRES_PER_DEGREE) * F.cos(F.radians(F.col("_here.lat"))))
    return near.select(*keys, "i", "j", F.col("_here.lat").alias("lat"), F.col("_here.lon").alias("lon"),
                       F.col("_here.v").alias(value), (F.sqrt(dx * dx + dy * dy) * 1000).alias(name))


def percentile_mask(cells: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """Cells at or above their own percentile; thresholds and values compare at 9 decimals."""
    cut = exact_percentile(cells, keys, value, p)
    return cells.join(cut, keys).where(F.round(value, 9) >= F.round("threshold", 9))


def front_zones(cells: DataFrame, keys: list[str], height: int, width: int, tile: int = TILE,
                value: str = "value") -> DataFrame:
    """Labelled cells of strong-gradient zones (at least four cells)."""
    # Read several times below (percentile passes, mask, join), so it is written once.
    steep = cut_lineage(gradient(cells, keys, value, height, width))
    mask = percentile_mask(steep.where(F.col("gradient").isNotNull()), keys, "gradient", FRONT_PERCENTILE)
    return label_zones(mask, keys, width, tile)


def label_zones(mask: DataFrame, keys: list[str], width: int, tile: int = TILE) -> DataFrame:
    mask = cut_lineage(mask)
    labels = connected_components(mask, keys, width, tile)
    big = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= MIN_ZONE_CELLS)
    return mask.join(labels, [*keys, "i", "j"]).join(big.select(*keys, "label"), [*keys, "label"], "left_semi")


def two_signal_mask(cells: DataFrame, keys: list[str], sst: str, chl: str, band: tuple[float, float] = SST_BAND) -> DataFrame:
    """High chlorophyll (top fifth of the overlap) within the favourable temperature band."""
    if not band[0] < band[1]:
        band = SST_BAND
    both = cells.where(F.col(sst).isNotNull() & F.col(chl).isNotNull())
    return percentile_mask(both, keys, chl, CHL_PERCENTILE).where(F.col(sst).between(*band))


def zone_stats(zones: DataFrame, lattice: DataFrame, keys: list[str], ref_lat: float, ref_lon: float,
               chl: str = "chl", chl_front: DataFrame | None = None) -> DataFrame:
    """Size, area, means, centroid, distance and bearing of every zone.

    ``chl_front`` (keys, i, j, chl_gradient) adds whether the chlorophyll gradient reaches
    its own percentile somewhere in the zone.
    """
    cells = with_areas(zones, lattice, keys)
    if chl_front is not None:
        cut = exact_percentile(chl_front, keys, "chl_gradient", FRONT_PERCENTILE, "chl_cut")
        cells = cells.join(chl_front.select(*keys, "i", "j", "chl_gradient"), [*keys, "i", "j"], "left").join(cut, keys, "left")
        confirmed = F.coalesce(F.round(F.max("chl_gradient"), 9) >= F.round(F.max("chl_cut"), 9), F.lit(False))
    else:
        confirmed = F.lit(None).cast("boolean")
    stats = cells.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n_cells"), (F.sum("area_m2") / 1e6).alias("area_km2"), F.avg("value").alias("mean_sst"),
        F.avg("gradient").alias("mean_gradient"), F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"),
        F.avg(chl).alias("mean_chl"), confirmed.alias("front_confirmed"))
    return stats.withColumns({
        "area_nm2": F.col("area_km2") * 1e6 / (geo.METRES_PER_NM * geo.METRES_PER_NM),
        "distance_nm": geo.haversine_nm(F.lit(ref_lat), F.lit(ref_lon), "centroid_lat", "centroid_lon"),
        "bearing_deg": geo.bearing_deg(F.lit(ref_lat), F.lit(ref_lon), "centroid_lat", "centroid_lon")})


def zone_outline(zones: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that bound a zone: cell sides that occur once within it.

    Side ``h`` at (i, j) is the lower side of cell (i, j), side ``v`` its left side.
    """
    i, j = F.col("i"), F.col("j")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), a.alias("i"), b.alias("j")) for s, a, b in (
        ("h", i, j), ("h", i + 1, j), ("v", i, j), ("v", i, j + 1))])
    return (zones.select(*keys, "label", F.explode(sides).alias("_s")).groupBy(*keys, "label", "_s")
            .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).select(*keys, "label", "_s.side", "_s.i", "_s.j"))


def complete_lattice(rows: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(cells with ascending i / j, verdict per key); not a full rectangle is rejected."""
    lats, lons = rows.select(*keys, "lat").distinct(), rows.select(*keys, "lon").distinct()
    i = lats.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("lat")) - 1)
    j = lons.withColumn("j", F.row_number().over(Window.partitionBy(*keys).orderBy("lon")) - 1)
    size = i.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lat")).join(j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lon")), keys)
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    verdict = size.join(total, keys).withColumn("complete", F.col("n_lat") * F.col("n_lon") == F.col("n_rows"))
    cells = rows.join(i, [*keys, "lat"]).join(j, [*keys, "lon"]) \
        .join(verdict.where("complete").select(*keys), keys, "left_semi")
    return cells.select(*keys, "i", "j", "lat", "lon", value), verdict


def bin_centres(boxes: DataFrame, step: float) -> DataFrame:
    """Centres of ``n = max(2, round(extent / step))`` equal bins per axis, for each box row."""
    def centres(low: str, high: str) -> Column:
        n = F.greatest(F.lit(2), F.bround((F.col(high) - F.col(low)) / step).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(
            k.alias("k"), (F.col(low) + (F.col(high) - F.col(low)) * (k + F.lit(0.5)) / n).alias("c")))
    return (boxes.withColumn("_a", F.explode(centres("min_lat", "max_lat"))).withColumn("_b", F.explode(centres("min_lon", "max_lon")))
            .select(*boxes.columns, F.col("_a.k").alias("i"), F.col("_b.k").alias("j"), F.col("_a.c").alias("lat"),
                    F.col("_b.c").alias("lon")))


def nearest_axis_index(targets: DataFrame, source_axis: DataFrame, keys: list[str], coordinate: str, index: str,
                       name: str) -> DataFrame:
    """Target axis values -> nearest source index (tie to the lower coordinate); both are axis-length tables."""
    src = source_axis.select(*keys, F.col(coordinate).alias("_c"), F.struct(F.col(coordinate).alias("c"), F.col(index).alias("k")).alias("_s"),
                             F.lit(None).cast("int").alias(name))
    tgt = targets.select(*keys, F.col(coordinate).alias("_c"), F.lit(None).cast(src.schema["_s"].dataType).alias("_s"), F.col(name))
    w = Window.partitionBy(*keys).orderBy("_c", F.col("_s").isNull())
    both = src.unionByName(tgt).select(
        "*", F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_b"),
        F.first("_s", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_a"))
    below, above = F.col("_c") - F.col("_b.c"), F.col("_a.c") - F.col("_c")
    pick = F.when(F.col("_b").isNull(), F.col("_a.k")).when(F.col("_a").isNull(), F.col("_b.k")) \
        .when(F.round(below, 9) <= F.round(above, 9), F.col("_b.k")).otherwise(F.col("_a.k"))
    return both.where(F.col(name).isNotNull()).select(*keys, name, pick.alias(index))


def regrid(cells: DataFrame, target: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Nearest-neighbour regrid: rows and columns map independently; missing values are copied."""
    rows = nearest_axis_index(target.select(*keys, "ti", "lat").distinct(), cells.select(*keys, "i", "lat").distinct(), keys, "lat", "i", "ti")
    cols = nearest_axis_index(target.select(*keys, "tj", "lon").distinct(), cells.select(*keys, "j", "lon").distinct(), keys, "lon", "j", "tj")
    return (target.join(rows, [*keys, "ti"]).join(cols, [*keys, "tj"])
            .join(cells.select(*keys, "i", "j", value), [*keys, "i", "j"], "left")
            .select(*keys, "ti", "tj", "lat", "lon", value))


def bilinear(points: DataFrame, cells: DataFrame, point_key: str, lat_axis: tuple[float, float, int],
             lon_axis: tuple[float, float, int], value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Bilinear sample on a regular grid; the nearest value when any corner is missing.

    ``keys`` are the columns that points and cells have in common, such as the grid's slice.
    """
    def place(coord: str, ax: tuple[float, float, int]) -> tuple[Column, Column]:
        raw = F.greatest(F.lit(0.0), F.least(F.lit(float(ax[2] - 1)), (F.col(coord) - F.lit(ax[0])) / F.lit(ax[1])))
        low = F.least(F.lit(ax[2] - 2), F.floor(raw).cast("int"))
        return low, raw - low

    i0, ty = place("lat", lat_axis)
    j0, tx = place("lon", lon_axis)
    at = points.withColumns({"_i": i0, "_j": j0, "_ty": ty, "_tx": tx})
    # rank 0 is the corner nearest to the point (ties to the lower coordinate)
    corners = F.array(*[F.struct(
        (F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j"),
        ((F.col("_ty") if a else 1 - F.col("_ty")) * (F.col("_tx") if b else 1 - F.col("_tx"))).alias("w"),
        (((F.col("_ty") > 0.5) == F.lit(bool(a))) & ((F.col("_tx") > 0.5) == F.lit(bool(b)))).alias("near"))
        for a in (0, 1) for b in (0, 1)])
    spread = at.select(point_key, *keys, F.explode(corners).alias("_c")).select(point_key, *keys, "_c.*")
    got = spread.join(cells.select(*keys, "i", "j", F.col(value).alias("_v")), [*keys, "i", "j"], "left")
    return got.groupBy(point_key, *keys).agg(
        F.count("_v").alias("_n"), F.sum(F.col("w") * F.col("_v")).alias("_s"),
        F.max(F.when(F.col("near"), F.col("_v"))).alias("_near")).select(
        point_key, *keys, F.when(F.col("_n") == 4, F.col("_s")).otherwise(F.col("_near")).alias("sample"))


def point_series(points: DataFrame, cells: DataFrame, point_key: str, time: str, lat_axis: tuple[float, float, int],
                 lon_axis: tuple[float, float, int], value: str = "value") -> DataFrame:
    """The series of the cell nearest to each point: the mean over what a cell has at one time, and how far off its centre lies.

    A cell without any value gives no row.
    """
    steps = cells.groupBy("i", "j", time).agg(F.avg(value).alias("_v")).where("_v IS NOT NULL").select("i", "j", F.struct(time, "_v").alias("_s"))
    got = nearest_cell(points, steps, [], lat_axis, lon_axis, "_s").where("cell_value IS NOT NULL")
    return got.select(point_key, F.col(f"cell_value.{time}").alias(time), F.col("cell_value._v").alias("cell_value"), "cell_nm")


def vertical_profile(points: DataFrame, cells: DataFrame, point_key: str) -> DataFrame:
    """All depths at the point's cell for the latest time that cell has."""
    at = points.join(cells, ["i", "j"])
    latest = at.groupBy(point_key).agg(F.max("valid_time").alias("valid_time"))
    return at.join(latest, [point_key, "valid_time"])


def clamp_depth(wanted, low, high) -> Column:
    """Wanted depth pulled into the available range, which may be given reversed."""
    a, b = geo._col(low), geo._col(high)
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), geo._col(wanted)))
