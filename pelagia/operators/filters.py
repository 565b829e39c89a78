"""Predicates and window clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pelagia import dims
from pelagia.functions.geo import _col

# Fixed values.
BUFFER_DEG = 5.0
MAX_ADVISORY_AGE_DAYS = 7.0
MAX_SPAN_DAYS = 3300


def in_bbox(lat, lon, bbox=dims.REGION_BBOX, pad: float = 0.0) -> Column:
    """Closed box test; a missing coordinate is outside."""
    west, south, east, north = bbox
    inside = _col(lat).between(south - pad, north + pad) & _col(lon).between(west - pad, east + pad)
    return F.coalesce(inside, F.lit(False))


def current_events(events: DataFrame, bbox=dims.REGION_BBOX) -> DataFrame:
    """Current events centred within five degrees of the region box."""
    return events.where(F.col("is_current") & in_bbox("lat", "lon", bbox, BUFFER_DEG))


def envelope_overlaps(minx, miny, maxx, maxy, bbox=dims.REGION_BBOX) -> Column:
    west, south, east, north = bbox
    return (_col(minx) <= east) & (_col(maxx) >= west) & (_col(miny) <= north) & (_col(maxy) >= south)


def feature_in_bbox(features: DataFrame, mode: str, bbox=dims.REGION_BBOX) -> DataFrame:
    """``envelope_keep_unknown`` keeps features without a box, ``envelope_drop_unknown`` drops them."""
    hit = envelope_overlaps("minx", "miny", "maxx", "maxy", bbox)
    if mode == "envelope_keep_unknown":
        return features.where(F.coalesce(hit, F.lit(True)))
    if mode == "envelope_drop_unknown":
        return features.where(F.coalesce(hit, F.lit(False)))
    raise ValueError(mode)


def segments_in_bbox(segments: DataFrame, mode: str, bbox=dims.REGION_BBOX) -> DataFrame:
    """Features (layer, fkey) meeting the box: ``vertex_or_envelope`` or ``exact``.

    Exact: an edge meets the box, or a polygon contains the box's lower-left corner.
    """
    west, south, east, north = bbox
    if mode == "vertex_or_envelope":
        boxes = segments.groupBy("layer", "fkey").agg(
            F.min(F.least("x1", "x2")).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"),
            F.max(F.greatest("x1", "x2")).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy"))
        return boxes.where(envelope_overlaps("minx", "miny", "maxx", "maxy", bbox)).select("layer", "fkey")
    if mode != "exact":
        raise ValueError(mode)
    from pelagia.functions.geo import crosses_ray

    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def clip(delta: Column, start: Column, low: float, high: float) -> tuple[Column, Column]:
        a, b = (F.lit(low) - start) / delta, (F.lit(high) - start) / delta
        outside = (start < low) | (start > high)
        enter = F.when(delta == 0, F.when(outside, F.lit(2.0)).otherwise(F.lit(0.0))).otherwise(F.least(a, b))
        leave = F.when(delta == 0, F.when(outside, F.lit(-1.0)).otherwise(F.lit(1.0))).otherwise(F.greatest(a, b))
        return enter, leave

    ex, lx = clip(dx, F.col("x1"), west, east)
    ey, ly = clip(dy, F.col("y1"), south, north)
    meets = F.greatest(ex, ey, F.lit(0.0)) <= F.least(lx, ly, F.lit(1.0))
    corner = crosses_ray(F.lit(west), F.lit(south), "x1", "y1", "x2", "y2") & F.col("is_polygon")
    return (segments.groupBy("layer", "fkey").agg(F.bool_or(meets).alias("_m"), F.sum(corner.cast("int")).alias("_c"))
            .where(F.col("_m") | (F.col("_c") % 2 == 1)).select("layer", "fkey"))


def same_name(left, right) -> Column:
    """Trimmed, case-insensitive equality."""
    return F.lower(F.trim(_col(left))) == F.lower(F.trim(_col(right)))


def advisory_age_days(advisory_date, as_of) -> Column:
    """Age in days, never negative; null for an unknown date."""
    age = F.timestamp_diff("SECOND", _col(advisory_date), _col(as_of)).cast("double") / F.lit(86400.0)
    return F.when(age.isNotNull(), F.greatest(F.lit(0.0), age))


def advisory_is_current(age_days) -> Column:
    return F.coalesce(_col(age_days) <= F.lit(MAX_ADVISORY_AGE_DAYS), F.lit(False))


def pick_block(blocks: DataFrame, keys: list[str], preferred: DataFrame) -> DataFrame:
    """Configured coast block, else the first fallback present; ``preferred`` has (block, pref)."""
    ranked = blocks.join(preferred.withColumn("_b", F.lower("block")).drop("block"),
                         F.lower(F.trim("block")) == F.col("_b")).drop("_b")
    rest = [c for c in ranked.columns if c not in keys]
    return (ranked.groupBy(*keys).agg(F.min_by(F.struct(*rest), "pref").alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
            .withColumn("matched_exactly", F.col("pref") == 0))


def clamp_window(start, end, first, last) -> dict[str, Column]:
    """Both ends pulled into coverage; ``empty`` when nothing is left, ``clamped`` when moved."""
    s, e, lo, hi = map(_col, (start, end, first, last))
    new_s, new_e = F.greatest(s, lo), F.least(e, hi)
    return {"win_start": new_s, "win_end": new_e, "clamped": (new_s != s) | (new_e != e), "empty": new_s > new_e}


def collapse_window(start, end, first, last) -> dict[str, Column]:
    """A window wholly outside coverage collapses to the nearer bound."""
    s, e, lo, hi = map(_col, (start, end, first, last))
    new_s = F.when(e < lo, lo).when(s > hi, hi).otherwise(F.greatest(s, lo))
    new_e = F.when(e < lo, lo).when(s > hi, hi).otherwise(F.least(e, hi))
    return {"win_start": new_s, "win_end": new_e, "clamped": (new_s != s) | (new_e != e)}


def cap_span(start, end, keep: str = "oldest", days: int | None = None) -> dict[str, Column]:
    """Longest allowed span; ``oldest`` keeps the start, ``newest`` keeps the end. Without ``days`` nothing is cut."""
    s, e = _col(start), _col(end)
    if days is None:
        return {"win_start": s, "win_end": e, "capped": F.lit(False)}
    long = F.timestamp_diff("SECOND", s, e) > days * 86400
    if keep == "oldest":
        return {"win_start": s, "win_end": F.when(long, F.timestamp_add("SECOND", F.lit(days * 86400), s)).otherwise(e),
                "capped": long}
    return {"win_start": F.when(long, F.timestamp_add("SECOND", F.lit(-days * 86400), e)).otherwise(s), "win_end": e,
            "capped": long}


def numeric_or_null(text) -> Column:
    """Blank, ``nan``, ``NULL`` and garbage are missing."""
    value = F.trim(_col(text)).try_cast("double")
    return F.when(F.upper(F.trim(_col(text))).isin("", "NULL", "NAN"), F.lit(None).cast("double")) \
        .when(F.isnan(value), F.lit(None).cast("double")).otherwise(value)


def threshold_mask(value, op: str, limit) -> Column:
    """Comparison on cells; a missing value is false for every operator."""
    v, t = _col(value), _col(limit)
    test = {">": v > t, ">=": v >= t, "<": v < t, "<=": v <= t}[op]
    return F.coalesce(test, F.lit(False))


def alerts_for(alerts: DataFrame, vessel=None, since=None, active_only: bool = False) -> DataFrame:
    """Alert history filter; an absent argument keeps everything."""
    out = alerts
    if vessel is not None:
        out = out.where(F.col("vessel_id") == F.lit(vessel))
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since))
    return out.where(F.col("active")) if active_only else out


def still_valid(valid_to, as_of) -> Column:
    return F.coalesce(_col(valid_to) > _col(as_of), F.lit(False))
