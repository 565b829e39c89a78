"""Questions answered as one job over a whole table of requests, composed of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pelagia import dims
from pelagia.functions import marine
from pelagia.operators import fences as fence_ops

#: Classes whose fences are fixed layers; user-defined and hazard fences come and go.
FIXED_CLASSES = tuple(r[0] for r in dims.FENCE_CLASSES if r[0] not in ("USER_DEFINED", fence_ops.HAZARD))


def check_geofences(requests: DataFrame, segments: DataFrame, fences: DataFrame, key: str, wanted: str = "wanted") -> DataFrame:
    """What every request is warned of, and what could not be checked for it; one row per request.

    ``requests`` has the key, lat, lon, heading_deg, speed_kn and ``wanted``, an array of fence classes (null: all). Columns: ``status``
    (``abstain``: no fixed layer of the wanted classes is there; ``partial``: some; ``checked``), ``n_found``, ``worst_level`` (INFO: nothing
    in warning range; null: abstained), ``classes_present``, ``nearest_nm``, ``eta_s`` (the soonest), ``unchecked`` and ``hard_gap``, true where a
    legal boundary is among these. "Nothing near" and "cannot check" never look alike. A request without a position is
    warned of nothing.
    """
    asked = lambda c: F.col(wanted).isNull() | F.array_contains(wanted, c)
    held = {r[0] for r in segments.select("layer").distinct().collect()}  # at most as many as there are classes
    array = lambda names: F.array(*map(F.lit, sorted(names))).cast("array<string>")
    required = F.when(F.col(wanted).isNull(), array(FIXED_CLASSES)).otherwise(F.array_intersect(array(FIXED_CLASSES), F.col(wanted)))
    unchecked = F.array_except(required, array(held))
    checkable = F.size(F.array_intersect(required, array(held))) > 0
    legal = array(r[0] for r in dims.FENCE_CLASSES if r[2] == "legal_hard")
    near = fence_ops.alerting_proximities(requests.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()), segments, fences).where(asked(F.col("layer"))).select(
        key, "layer", "fkey", "level_rank", "distance_nm", "lat", "lon", "heading_deg", "speed_kn", "closest_lat", "closest_lon")
    timed = fence_ops.closing_eta(near, segments, [key])
    found = timed.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.max("level_rank").alias("_worst"), F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("_classes"),
        F.min("distance_nm").alias("_nm"), F.min("eta_s").alias("_eta"))
    rows = requests.select(key, unchecked.alias("_unchecked"), checkable.alias("_checkable")).join(found.hint("merge"), key, "left")
    told = lambda c: F.when(F.col("_checkable"), c)
    return rows.select(
        key, F.when(~F.col("_checkable"), "abstain").when(F.size("_unchecked") > 0, "partial").otherwise("checked").alias("status"),
        F.when(F.col("_checkable"), F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_found"),
        told(marine.level_name(F.coalesce("_worst", F.lit(0)))).alias("worst_level"), told(F.coalesce("_classes", F.lit(""))).alias("classes_present"),
        told(F.col("_nm")).alias("nearest_nm"), told(F.col("_eta")).alias("eta_s"),
        F.array_join(F.array_sort("_unchecked"), ",").alias("unchecked"), F.arrays_overlap("_unchecked", legal).alias("hard_gap"))
