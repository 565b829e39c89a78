"""Great-circle and planar geometry as Column expressions (degrees in, nm out)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# Fixed values.
EARTH_RADIUS_M = 6_371_008.8
METRES_PER_NM = 1852.0
METRES_PER_DEGREE = EARTH_RADIUS_M * 3.141592653589793 / 180.0
NM_PER_DEGREE = METRES_PER_DEGREE / METRES_PER_NM
COMPASS_POINTS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
                  "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def _col(value) -> Column:
    return value if isinstance(value, Column) else (F.col(value) if isinstance(value, str) else F.lit(value))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(a2 - a1) / 2)
    half_lon = F.sin(F.radians(o2 - o1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def haversine_nm(lat1, lon1, lat2, lon2) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / F.lit(METRES_PER_NM)


def haversine_nm_array(lat1, lon1, lat2, lon2) -> np.ndarray:
    """``haversine_nm`` for arrays inside a task."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    chord = np.sin(np.radians(np.subtract(lat2, lat1)) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2.0 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(chord))) / METRES_PER_NM


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    a1, o1, a2, o2 = map(_col, (lat1, lon1, lat2, lon2))
    delta = F.radians(o2 - o1)
    p1, p2 = F.radians(a1), F.radians(a2)
    east = F.sin(delta) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(delta)
    return F.pmod(F.degrees(F.atan2(east, north)) + F.lit(360.0), F.lit(360.0))


def bearing_deg_array(lat1, lon1, lat2, lon2) -> np.ndarray:
    """``bearing_deg`` for arrays inside a task."""
    p1, p2, delta = np.radians(lat1), np.radians(lat2), np.radians(np.subtract(lon2, lon1))
    east = np.sin(delta) * np.cos(p2)
    north = np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(delta)
    return np.mod(np.degrees(np.arctan2(east, north)) + 360.0, 360.0)


def project_position(lat, lon, heading_deg, speed_kn, seconds) -> Column:
    """Dead reckoning: struct(lat, lon) after ``seconds`` on a fixed heading."""
    a, o, h, v, s = map(_col, (lat, lon, heading_deg, speed_kn, seconds))
    reach = v * F.lit(METRES_PER_NM) * s / F.lit(3600.0) / F.lit(EARTH_RADIUS_M)
    p, course = F.radians(a), F.radians(h)
    new_lat = F.asin(F.sin(p) * F.cos(reach) + F.cos(p) * F.sin(reach) * F.cos(course))
    new_lon = F.radians(o) + F.atan2(
        F.sin(course) * F.sin(reach) * F.cos(p), F.cos(reach) - F.sin(p) * F.sin(new_lat)
    )
    wrapped = F.pmod(F.degrees(new_lon) + F.lit(540.0), F.lit(360.0)) - F.lit(180.0)
    return F.struct(F.degrees(new_lat).alias("lat"), wrapped.alias("lon"))


def advance_position(lat, lon, heading_deg, speed_kn, seconds) -> Column:
    """Like :func:`project_position`, but a stopped vessel keeps its exact position."""
    stay = F.struct(_col(lat).alias("lat"), _col(lon).alias("lon"))
    return F.when(_col(speed_kn) == 0, stay).otherwise(
        project_position(lat, lon, heading_deg, speed_kn, seconds)
    )


def compass_point(bearing) -> Column:
    slot = F.floor(F.pmod(F.pmod(_col(bearing), F.lit(360.0)) + F.lit(11.25), F.lit(360.0)) / F.lit(22.5))
    return F.when(_col(bearing).isNotNull(), F.get(F.array(*[F.lit(p) for p in COMPASS_POINTS]), slot.cast("int")))


def current_toward(u, v) -> Column:
    """Direction a current flows toward, from eastward ``u`` and northward ``v``."""
    return F.pmod(F.degrees(F.atan2(_col(u), _col(v))) + F.lit(360.0), F.lit(360.0))


def wind_from(u, v) -> Column:
    """Direction a wind blows from: the reverse of :func:`current_toward`."""
    return F.pmod(current_toward(u, v) + F.lit(180.0), F.lit(360.0))


def closest_on_segment(px, py, x1, y1, x2, y2) -> Column:
    """struct(d2, qx, qy): planar closest point of a segment, in degree space."""
    along = along_segment(px, py, x1, y1, x2, y2)
    qx, qy = _col(x1) + along * (_col(x2) - _col(x1)), _col(y1) + along * (_col(y2) - _col(y1))
    return _with_distance(px, py, F.struct(qx.alias("qx"), qy.alias("qy")))


def closest_of_segments(px: Column, py: Column, segments: Column) -> Column:
    """:func:`closest_on_segment` over an array of structs; each step is evaluated once."""
    along = F.transform(segments, lambda s: F.struct(
        s.alias("s"), along_segment(px, py, s["x1"], s["y1"], s["x2"], s["y2"]).alias("t")))
    foot = F.transform(along, lambda a: F.struct(
        (a["s"]["x1"] + a["t"] * (a["s"]["x2"] - a["s"]["x1"])).alias("qx"),
        (a["s"]["y1"] + a["t"] * (a["s"]["y2"] - a["s"]["y1"])).alias("qy")))
    return F.array_min(F.transform(foot, lambda q: _with_distance(px, py, q)))


def along_segment(px, py, x1, y1, x2, y2) -> Column:
    """Share (0..1) of the way along a segment at which it is closest to the point."""
    px, py, x1, y1, x2, y2 = map(_col, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    share = ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)
    return F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def _with_distance(px, py, q: Column) -> Column:
    px, py = _col(px), _col(py)
    d2 = (px - q["qx"]) * (px - q["qx"]) + (py - q["qy"]) * (py - q["qy"])
    return F.struct(d2.alias("d2"), q["qx"].alias("qx"), q["qy"].alias("qy"))


def odd_crossings(px: Column, py: Column, segments: Column) -> Column:
    """True when an eastward ray crosses an odd number of the edges."""
    return F.size(F.filter(segments, lambda s: crosses_ray(px, py, s["x1"], s["y1"], s["x2"], s["y2"]))) % 2 == 1


def crosses_ray(px, py, x1, y1, x2, y2) -> Column:
    """True when an eastward ray from the point crosses the edge (even-odd rule)."""
    px, py, x1, y1, x2, y2 = map(_col, (px, py, x1, y1, x2, y2))
    straddles = (y1 > py) != (y2 > py)
    return F.when(straddles, px < (x2 - x1) * (py - y1) / (y2 - y1) + x1).otherwise(F.lit(False))


def cell_area_m2(south, north, west, east, centre_lat) -> Column:
    """Area of a lat/lon cell: metres of latitude times metres of longitude at centre."""
    height = F.radians(_col(north) - _col(south)) * F.lit(EARTH_RADIUS_M)
    width = F.radians(_col(east) - _col(west)) * F.lit(EARTH_RADIUS_M) * F.cos(F.radians(_col(centre_lat)))
    return F.abs(height * width)
