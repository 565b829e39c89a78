"""Fence checks: proximity, level, closing time, ordering, coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pelagia import dims
from pelagia.functions import geo, marine
from pelagia.plans.ordered import top_per_group
from pelagia.plans.spatial import nearest_features
from pelagia.plans.tracks import PIECE, segments_held, track_distances, walked_values
from pelagia.session import BROADCAST_ROWS, cut_lineage, looked_up

# Fixed values.
HORIZON_S = 3600.0
STEPS = 40
MIN_SPEED_KN = 0.5
MIN_CLOSING_KN = 0.25
HAZARD = "HAZARD_EXCLUSION"
ETA_HORIZONS = 4.0
#: Between class and key of a hazard zone while it is a layer of its own.
ZONE = "\x1f"


def latest_per_tick(positions: DataFrame, seconds: int) -> DataFrame:
    """One position per vessel and tick: the latest one (event id breaks ties)."""
    from pelagia.plans.ordered import EPOCH, time_bucket

    tick = time_bucket("ts", seconds)
    rest = [c for c in positions.columns if c != "vessel_id"]
    return (positions.groupBy("vessel_id", tick.alias("tick"))
            .agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("_p"))
            .select("vessel_id", "tick",
                    F.timestamp_add("SECOND", F.col("tick") * seconds, F.expr(EPOCH)).alias("tick_start"),
                    *[F.col(f"_p.{c}").alias(c) for c in rest]))


def with_levels(near: DataFrame, fences: DataFrame) -> DataFrame:
    """Alert rank and level; a fence's own lead distances win over its class's."""
    classes = dims.fence_classes(near.sparkSession).select(
        F.col("fence_class").alias("layer"), "warn_nm", "critical_nm", "severity", "severity_rank", "class_order")
    own = fences.select("layer", "fkey", "name", "own_warn_nm", "own_critical_nm")
    joined = near.join(classes, "layer").join(looked_up(own), ["layer", "fkey"])
    rank = marine.alert_rank("inside", "distance_nm", F.coalesce("own_warn_nm", "warn_nm"),
                             F.coalesce("own_critical_nm", "critical_nm"))
    return joined.withColumn("level_rank", rank).withColumn("level", marine.level_name(F.col("level_rank"))) \
        .drop("warn_nm", "critical_nm", "own_warn_nm", "own_critical_nm")


def fence_proximities(positions: DataFrame, segments: DataFrame, fences: DataFrame, include_info: bool = True,
                      max_nm: float | None = None) -> DataFrame:
    """Nearest fence of every class for every position, with its alert level."""
    out = with_levels(nearest_features(positions, segments, max_nm=max_nm), fences)
    return out if include_info else out.where(F.col("level_rank") > 0)


def each_zone(segments: DataFrame) -> DataFrame:
    """Every feature a layer of its own, so that all of them are checked and not only the nearest of the class."""
    return segments.withColumn("layer", F.concat_ws(ZONE, "layer", F.col("fkey").cast("string")))


def hazard_proximities(positions: DataFrame, segments: DataFrame, fences: DataFrame, max_nm: float | None = None) -> DataFrame:
    """Every hazard zone of ``segments`` for every position, not only the nearest, with its alert level; none beyond ``max_nm``."""
    near = nearest_features(positions, each_zone(segments), max_nm=max_nm).withColumn("layer", F.substring_index("layer", ZONE, 1))
    return with_levels(near, fences)


def alerting_proximities(positions: DataFrame, segments: DataFrame, fences: DataFrame, hazard: str = HAZARD) -> DataFrame:
    """What a position is warned of: the nearest fence of every class and every hazard zone, where the level is WARN or more."""
    own = fences.where(F.col("layer") == hazard).agg(F.max(F.greatest("own_warn_nm", "own_critical_nm"))).first()[0]
    lead = max(own or 0.0, *[x for r in dims.FENCE_CLASSES if r[0] == hazard for x in r if isinstance(x, float)])
    fixed = with_levels(nearest_features(positions, segments.where(F.col("layer") != hazard)), fences)
    zones = hazard_proximities(positions, segments.where(F.col("layer") == hazard), fences, max_nm=lead)
    return fixed.unionByName(zones).where("level_rank > 0")


def proximity_order() -> list[Column]:
    return [F.col("level_rank").desc(), F.col("severity_rank").desc(), F.round("distance_nm", 9).asc(), F.col("fkey")]


def nearest_fence_per_vessel(proximities: DataFrame, keys: list[str]) -> DataFrame:
    """Closest fence over the given classes; informational rows count."""
    rest = [c for c in proximities.columns if c not in keys]
    picked = proximities.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(F.round("distance_nm", 9), "layer", "fkey")).alias("_n"))
    return picked.select(*keys, *[F.col(f"_n.{c}").alias(c) for c in rest])


def resolve_classes(requested: DataFrame) -> DataFrame:
    """Requested class words -> fence classes; unknown words keep a null class."""
    aliases = dims.table(requested.sparkSession, dims.CLASS_ALIASES, "alias, fence_class")
    return requested.join(aliases, F.upper(F.trim("wanted")) == F.col("alias"), "left").drop("alias")


def closing_eta(proximities: DataFrame, segments: DataFrame, key: list[str], piece: int = PIECE, held_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds ``eta_s``: time until the vessel reaches the fence it is closing on.

    The projected track is sampled; rows that cannot qualify (too slow, or farther than
    four horizons of sailing) are set aside before. ``key`` names the columns that, with layer and fkey, tell rows apart.
    Up to ``held_rows`` segments are sent to every task; more meet the rows piece by piece.
    """
    slow = F.col("heading_deg").isNull() | F.col("speed_kn").isNull() | (F.col("speed_kn") < MIN_SPEED_KN)
    reach = F.col("speed_kn") * F.lit(HORIZON_S / 3600.0)
    # Closing speed never exceeds the vessel's own speed, so beyond this no ETA survives.
    too_far = F.col("distance_nm") > reach * F.lit(ETA_HORIZONS * 1.001)
    names = [*key, "layer", "fkey"]
    proximities = cut_lineage(proximities)
    walks = F.coalesce(~slow & ~too_far, F.lit(False))
    for c in names:
        walks = walks & F.col(c).isNotNull()
    told = [*proximities.columns, "eta_s"]

    def by_pieces(rows: DataFrame) -> DataFrame:
        walked = track_distances(rows.where(walks), segments, key, HORIZON_S, STEPS, piece).withColumnRenamed("nm", "_nm")
        fold = F.pandas_udf(_folded, "double")
        return rows.join(walked, names, "left").withColumn("eta_s", fold("_nm", "distance_nm")).select(*told)

    held = segments_held(segments, held_rows)
    if held is None:
        return by_pieces(proximities)
    # Rows that ``key`` does not tell apart are one track to the walk by pieces, and stay so.
    number = F.xxhash64(*names)
    alike = cut_lineage(proximities.groupBy(number.alias("_number")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_number"))
    alone = lambda rows: walked_values(rows, walks, held, HORIZON_S, STEPS, "eta_s", fold_eta, "distance_nm", piece)
    if alike.isEmpty():
        return alone(proximities)
    numbered, alike = proximities.withColumn("_number", number), looked_up(alike)
    return alone(numbered.join(alike, "_number", "left_anti").drop("_number")).select(*told).unionByName(
        by_pieces(cut_lineage(numbered.join(alike, "_number", "left_semi").drop("_number"))))


def fold_eta(distances: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Walk the sampled distances (rows by steps): stop on entry or once past the closest approach. Seconds, NaN where there is no ETA."""
    best, best_t, hit, done = start.copy(), np.full(len(start), np.nan), np.full(len(start), np.nan), np.zeros(len(start), dtype=bool)
    for i in range(distances.shape[1]):
        d, t = distances[:, i], (i + 1) * (HORIZON_S / STEPS)
        entered = ~done & (d <= 0)
        better = ~done & (d > 0) & (d < best)
        past = ~done & (d > 0) & ~np.isnan(best_t) & (d > best)
        best, best_t, hit = np.where(better, d, best), np.where(better, t, best_t), np.where(entered, t, hit)
        done |= entered | past
    closed = start - best
    with np.errstate(divide="ignore", invalid="ignore"):
        closing = closed / (best_t / 3600.0)
        eta = start / closing * 3600.0
        usable = ~np.isnan(best_t) & (closed > 1e-6) & (closing >= MIN_CLOSING_KN) & (eta <= HORIZON_S * ETA_HORIZONS)
    return np.where(np.isnan(hit), np.where(usable, eta, np.nan), hit)


def _folded(distances: pd.Series, start: pd.Series) -> pd.Series:
    told, walked = np.full(len(start), np.nan), distances.notna().to_numpy()
    if walked.any():
        told[walked] = fold_eta(np.stack(distances[walked].to_list()).astype(np.float64), start[walked].to_numpy(dtype=np.float64))
    return pd.Series(told).astype("Float64").mask(np.isnan(told))


def simple_eta_list(proximities: DataFrame) -> DataFrame:
    """Offline list: informational rows dropped, distance to 2 decimals, ETA = distance / speed."""
    return proximities.where(F.col("level_rank") > 0).select(
        "*", F.round("distance_nm", 2).alias("shown_nm"),
        F.when(F.col("speed_kn") > 0, F.col("distance_nm") / F.col("speed_kn") * F.lit(3600.0)).alias("simple_eta_s"))


def class_coverage(present: DataFrame, requested_by: str, requests: DataFrame | None = None) -> DataFrame:
    """Per request, fence classes that could not be checked.

    ``present`` lists the classes a request could check, a null or unknown class for none; ``requests`` may name
    further requests that have no such row at all. A missing legal class is a hard gap, a missing other class a note; with nothing
    checkable the status is ``abstain``, which is not the same as ``clear``.
    """
    classes = dims.fence_classes(present.sparkSession).where(F.col("fence_class") != "USER_DEFINED")
    total = len(dims.FENCE_CLASSES) - 1
    have = present.select(requested_by, F.col("layer").alias("fence_class")).distinct() \
        .join(classes, "fence_class", "left_semi")
    asked = present.select(requested_by) if requests is None else present.select(requested_by).union(requests.select(requested_by))
    found = have.groupBy(requested_by).agg(F.collect_set("fence_class").alias("_found"))
    seen = asked.distinct().join(found, requested_by, "left").withColumn("_have", F.coalesce("_found", F.array().cast("array<string>")))
    every = F.array(*[F.lit(r[0]) for r in dims.FENCE_CLASSES if r[0] != "USER_DEFINED"])
    legal = F.array(*[F.lit(r[0]) for r in dims.FENCE_CLASSES if r[2] == "legal_hard"])
    missing = F.array_except(every, F.col("_have"))
    return seen.select(
        requested_by, F.array_join(F.array_sort(missing), ",").alias("unchecked"),
        F.arrays_overlap(missing, legal).alias("hard_gap"),
        F.when(F.size("_have") == 0, F.lit("abstain")).when(F.size("_have") < total, F.lit("partial"))
        .otherwise(F.lit("checked")).alias("status"))


def top_three(proximities: DataFrame, keys: list[str]) -> DataFrame:
    """Boat view: level first, then distance, three rows per vessel."""
    return top_per_group(proximities, keys, [F.col("level_rank").desc(), F.round("distance_nm", 9), F.col("layer"),
                                             F.col("fkey")], 3)


def fence_legend(spark) -> DataFrame:
    """One row per class in canonical order, with the routing flag."""
    return dims.fence_classes(spark).select(
        "fence_class", "class_order", "severity", "warn_nm", "critical_nm", "colour", "title",
        F.col("severity").isin("legal_hard", "hazard").alias("blocks_routing"))
