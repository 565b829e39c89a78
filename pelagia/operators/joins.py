"""Nearest ports, directory lookup, grid and time lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pelagia import dims
from pelagia.functions import geo
from pelagia.plans.asof import asof
from pelagia.plans.spatial import nearest_features, point_segments
from pelagia.session import BROADCAST_ROWS, at_most, cut_lineage, looked_up


def nearest_ports(points: DataFrame, ports: DataFrame, point_key: str, k: int = 3,
                  broadcast_rows: int | None = None) -> DataFrame:
    """The ``k`` nearest ports by great circle, with port columns prefixed ``port_``."""
    segments = point_segments(ports, "ports", "port_id", "lat", "lon")
    options = {} if broadcast_rows is None else {"broadcast_rows": broadcast_rows}
    near = nearest_features(points, segments, k=k, **options)
    info = ports.select(F.col("port_id").alias("fkey"), F.col("name").alias("port_name"),
                        F.col("district").alias("port_district"))
    return near.join(looked_up(info), "fkey").drop("layer", "inside").withColumnRenamed("fkey", "port_id")


def directory_lookup(centres: DataFrame, centre_contacts: DataFrame, district_contacts: DataFrame) -> DataFrame:
    """Contact by centre name, else by district; only verified numbers are shown."""
    by_name = centre_contacts.select("name", F.col("contact").alias("_c1"), F.col("verified").alias("_v1"))
    by_district = district_contacts.select("district", F.col("contact").alias("_c2"), F.col("verified").alias("_v2"))
    joined = centres.join(by_name, "name", "left").join(by_district, "district", "left")
    matched = F.when(F.col("_c1").isNotNull(), F.lit("centre")).when(F.col("_c2").isNotNull(), F.lit("district"))
    verified = F.when(F.col("_c1").isNotNull(), F.col("_v1")).otherwise(F.col("_v2"))
    return joined.select(*centres.columns, matched.alias("matched_by"), F.coalesce(verified, F.lit(False)).alias("verified"),
                         F.when(verified, F.coalesce("_c1", "_c2")).alias("contact"))


def latest_file(targets: DataFrame, files: DataFrame, keys: list[str], target_time: str, file_time: str) -> DataFrame:
    """Latest file at or before the target, else the newest file of all."""
    newest = files.groupBy(*keys).agg(F.max(file_time).alias("_newest"))
    found = asof(targets, files, keys, target_time, file_time, [], True)
    return found.join(newest, keys, "left").select(
        *targets.columns, F.coalesce(F.col("match.match_time"), F.col("_newest")).alias("file_time"),
        F.col("match").isNull().alias("fell_back"))


def axis_index(value, first: float, step: float, count: int) -> Column:
    """Nearest index on a regular ascending axis; a tie goes to the lower coordinate."""
    raw = F.ceil((geo._col(value) - F.lit(first)) / F.lit(step) - F.lit(0.5)).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(count - 1), raw))


def nearest_cell(points: DataFrame, cells: DataFrame, keys: list[str], lat_axis: tuple[float, float, int],
                 lon_axis: tuple[float, float, int], value: str = "value") -> DataFrame:
    """Value and centre distance of the nearest cell; a missing cell gives a null value."""
    at = points.withColumns({"i": axis_index("lat", *lat_axis), "j": axis_index("lon", *lon_axis)})
    got = at.join(cells.select(*keys, "i", "j", F.col(value).alias("cell_value")), [*keys, "i", "j"], "left")
    centre_lat = F.lit(lat_axis[0]) + F.col("i") * F.lit(lat_axis[1])
    centre_lon = F.lit(lon_axis[0]) + F.col("j") * F.lit(lon_axis[1])
    return got.withColumn("cell_nm", geo.haversine_nm("lat", "lon", centre_lat, centre_lon))


def bulletin_for(requests: DataFrame, bulletins: DataFrame, key: str) -> DataFrame:
    """First sea condition, port signal and surge text of the block; validity follows the sea condition."""
    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("bulletin_id"))).alias(c)

    governing = F.when(F.col("sea_condition").isNotNull(), F.col("bulletin_id"))
    blocks = bulletins.groupBy(key).agg(
        first("sea_condition"), first("port_signal"), first("storm_surge_warning"),
        F.min_by("valid_from", governing).alias("valid_from"), F.min_by("valid_to", governing).alias("valid_to"))
    return requests.join(blocks, key, "left")


def contour_depth(points: DataFrame, contours: DataFrame, depths: DataFrame, point_key: str) -> DataFrame:
    """Depth attribute of the nearest contour line in degree space; non-numeric depths are skipped."""
    from pelagia.operators.filters import numeric_or_null

    usable = depths.select("fkey", F.coalesce(numeric_or_null("depth_1"), numeric_or_null("depth_2")).alias("depth_m")) \
        .where(F.col("depth_m").isNotNull())
    lines = contours.join(usable.select("fkey"), "fkey", "left_semi").withColumns(
        {"layer": F.lit("bathymetry"), "is_polygon": F.lit(False)})
    near = nearest_features(points, lines, planar=True)
    return near.join(looked_up(usable), "fkey").select(*points.columns, "fkey", "depth_m")


def handoff(points: DataFrame, ports: DataFrame, point_key: str) -> DataFrame:
    """Nearest centre as handoff, the next two as alternates."""
    near = nearest_ports(points, ports, point_key, k=3)
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return near.groupBy(point_key).agg(
        at(1, "port_id").alias("handoff_id"), at(1, "distance_nm").alias("handoff_nm"),
        at(1, "bearing_deg").alias("handoff_bearing"), at(1, "port_district").alias("handoff_district"),
        at(2, "port_id").alias("alternate_1"), at(3, "port_id").alias("alternate_2"))


def nearest_line_vertex(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Nearest vertex of any line for every point: line, distance (3 decimals), bearing (1 decimal) and the vertex.

    ``lines`` are segments (fkey, x1, y1, x2, y2). Zone lines are published by their vertices, so it is these that are measured and
    not the stretches between them. A vertex of several lines counts for the one with the least key.
    """
    ends = lines.select("fkey", F.inline(F.array(*[F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for x, y in (("x1", "y1"), ("x2", "y2"))])))
    places = ends.groupBy("lat", "lon").agg(F.min("fkey").alias("line_id")).withColumn("vertex", F.xxhash64("lat", "lon"))
    near = nearest_features(points, point_segments(places, "vertices", "vertex", "lat", "lon"))
    return near.join(looked_up(places.select(F.col("vertex").alias("fkey"), "line_id")), "fkey").select(
        *points.columns, "line_id", F.round("distance_nm", 3).alias("distance_nm"), F.round("bearing_deg", 1).alias("bearing_deg"), "closest_lat", "closest_lon")


def nearest_stations(points: DataFrame, stations: DataFrame, readings: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest stations of every point with the newest reading of each variable they have.

    ``stations`` has station_id, lat, lon; ``readings`` station_id, variable, valid_time, value. A station without readings keeps its place
    with nulls. Newest means the latest time, then the greatest value.
    """
    near = nearest_features(points, point_segments(stations, "stations", "station_id", "lat", "lon"), k=k).withColumnRenamed("fkey", "station_id")
    newest = readings.where("value IS NOT NULL").groupBy("station_id", "variable").agg(F.max(F.struct("valid_time", "value")).alias("_r")).select(
        "station_id", "variable", "_r.valid_time", "_r.value")
    return near.drop("layer", "inside", "closest_lat", "closest_lon").join(looked_up(cut_lineage(newest)), "station_id", "left")


def nearest_in_region(points: DataFrame, places: DataFrame, region: str, place_id: str, k: int = 3) -> DataFrame:
    """The ``k`` nearest ``places`` of a point's own ``region``; of all places where that region has none, and never an empty answer."""
    regions = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col(region).alias("_has")).distinct()
    regions = F.broadcast(regions) if at_most(regions, BROADCAST_ROWS) else regions.hint("merge")
    asked = points.join(regions, F.col(region) == F.col("_has"), "left")
    everywhere = point_segments(places, "", place_id, "lat", "lon")
    named = places.select(F.col(place_id).alias("fkey"), F.col(region).cast("string").alias("layer"))
    local = everywhere.drop("layer").join(named, "fkey").select(*everywhere.columns)
    inside = nearest_features(asked.where("_has IS NOT NULL").drop("_has"), local, k=k).where(F.col("layer") == F.col(region).cast("string"))
    beyond = nearest_features(asked.where("_has IS NULL").drop("_has"), everywhere, k=k)
    told = lambda df, widened: df.withColumn("widened", F.lit(widened)).withColumnRenamed("fkey", place_id).drop("layer", "inside")
    return told(inside, False).unionByName(told(beyond, True))
