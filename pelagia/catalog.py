"""Operator catalogue, and the scalar functions for SQL users."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pelagia import dims
from pelagia.functions import geo
from pelagia.operators import fences, filters, grid, joins, observe, reports, routing, text, verdict
from pelagia.sources import ingest

_MODULES = (fences, filters, grid, joins, observe, reports, routing, text, verdict, ingest)

#: operator name -> function over DataFrames
OPERATORS: dict[str, Callable[..., Any]] = {
    f"{module.__name__.rsplit('.', 1)[-1]}.{name}": fn
    for module in _MODULES for name, fn in inspect.getmembers(module, inspect.isfunction)
    if fn.__module__ == module.__name__ and not name.startswith("_")
}


def listing(spark: SparkSession) -> DataFrame:
    """Name, parameters and first line of the description of every operator."""
    rows = [(name, ", ".join(inspect.signature(fn).parameters), (inspect.getdoc(fn) or "").split("\n")[0].replace("'", "`"))
            for name, fn in sorted(OPERATORS.items())]
    return dims.table(spark, [(a, b, c or "-") for a, b, c in rows], "operator, parameters, summary")


def call(name: str, *frames: DataFrame, **arguments: Any) -> tuple[Any, list[str], str | None]:
    """(result, dropped argument names, error): unknown arguments are dropped and reported, nothing is raised."""
    fn = OPERATORS.get(name)
    if fn is None:
        return None, [], f"unknown operator {name}"
    accepted = inspect.signature(fn).parameters
    dropped = sorted(a for a in arguments if a not in accepted)
    try:
        return fn(*frames, **{a: v for a, v in arguments.items() if a in accepted}), dropped, None
    except Exception as error:  # the caller gets a message instead of a failure
        return None, dropped, f"{type(error).__name__}: {error}"


SQL_FUNCTIONS = {
    "haversine_nm": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
                     f"2 * {geo.EARTH_RADIUS_M}D / {geo.METRES_PER_NM}D * asin(least(1.0D, sqrt(power(sin(radians(lat2 - lat1) / 2), 2) "
                     "+ cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))"),
    "bearing_deg": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
                    "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) "
                    "- sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360.0D, 360.0D)"),
    "wave_steepness": ("height DOUBLE, period DOUBLE", "DOUBLE",
                       "CASE WHEN height <> 0 AND period > 0 THEN height / (1.56D * period * period) END"),
    "douglas_band": ("height DOUBLE", "INT", "CASE WHEN height IS NULL OR height < 0 THEN NULL "
                     + " ".join(f"WHEN height < {high}D THEN {band}" for band, _, _, high in dims.DOUGLAS[1:9]) + " ELSE 9 END"),
    "alert_rank": ("inside BOOLEAN, distance DOUBLE, warn DOUBLE, critical DOUBLE", "INT",
                   "CASE WHEN inside THEN 3 WHEN distance <= critical THEN 2 WHEN distance <= warn THEN 1 ELSE 0 END"),
    "current_toward": ("u DOUBLE, v DOUBLE", "DOUBLE", "pmod(degrees(atan2(u, v)) + 360.0D, 360.0D)"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions for the scalars; the optimizer inlines them, no Python runs."""
    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(SQL_FUNCTIONS)


def register_fence_check(segments: DataFrame) -> str:
    """Table function ``fence_check(lat, lon)`` for one position: distance to every fence.

    Meant for single look-ups from SQL; tables of positions go through ``fences.fence_proximities``.
    """
    spark = segments.sparkSession
    register_sql_functions(spark)
    segments.createOrReplaceTempView("pelagia_fence_segments")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION fence_check(lat DOUBLE, lon DOUBLE)
        RETURNS TABLE (layer STRING, fkey INT, distance_nm DOUBLE)
        RETURN SELECT layer, fkey, CASE WHEN first(is_polygon) AND sum(crossing) % 2 = 1 THEN 0.0D
                      ELSE haversine_nm(fence_check.lat, fence_check.lon, min_by(qy, d2), min_by(qx, d2)) END
        FROM (SELECT layer, fkey, is_polygon, crossing, qx, qy, power(fence_check.lon - qx, 2) + power(fence_check.lat - qy, 2) AS d2
              FROM (SELECT layer, fkey, is_polygon, x1 + t * (x2 - x1) AS qx, y1 + t * (y2 - y1) AS qy,
                           CASE WHEN (y1 > fence_check.lat) <> (y2 > fence_check.lat)
                                     AND fence_check.lon < (x2 - x1) * (fence_check.lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END AS crossing
                    FROM (SELECT *, CASE WHEN x1 = x2 AND y1 = y2 THEN 0.0D ELSE greatest(0.0D, least(1.0D,
                                 ((fence_check.lon - x1) * (x2 - x1) + (fence_check.lat - y1) * (y2 - y1))
                                 / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) END AS t
                          FROM pelagia_fence_segments)))
        GROUP BY layer, fkey""")
    return "fence_check"
