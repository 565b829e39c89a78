"""Sea-state, freshness, alert and routing scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pelagia import dims
from pelagia.functions.geo import _col


def douglas_band(height_m) -> Column:
    """Douglas band of a significant wave height; null for missing or negative heights."""
    h = _col(height_m)
    ladder = F.when(h.isNull() | (h < 0), F.lit(None).cast("int"))
    for band, _, low, high in dims.DOUGLAS[1:]:
        ladder = ladder.when((h >= low) & (h < high), F.lit(band))
    return ladder.when(h >= 14.0, F.lit(9))


def douglas_descriptor(band) -> Column:
    return F.when(_col(band).isNotNull(), F.get(F.array(*[F.lit(r[1]) for r in dims.DOUGLAS]), _col(band)))


def wave_steepness(height_m, period_s) -> Column:
    """Height over deep-water wavelength 1.56 T^2; null when either is missing or zero."""
    h, t = _col(height_m), _col(period_s)
    return F.when((h != 0) & (t > 0), h / (F.lit(1.56) * t * t))


def age_in_words(days) -> Column:
    """today / yesterday / N days / weeks / months / years ago (half-even rounding)."""
    d = _col(days)

    def about(size: float, unit: str) -> Column:
        n = F.bround(d / F.lit(size)).cast("int").cast("string")
        return F.concat(F.lit("about "), n, F.lit(f" {unit} ago"))

    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(d < 1, F.lit("today")).when(d < 2, F.lit("yesterday"))
            .when(d < 14, F.concat(F.bround(d).cast("int").cast("string"), F.lit(" days ago")))
            .when(d < 60, about(7.0, "weeks")).when(d < 730, about(30.44, "months")).otherwise(about(365.25, "years")))


def fixed(value, digits: int) -> Column:
    """``value`` with one or two decimals, rounded half-even on the exact double.

    The product with a power of ten is taken with its rounding error (the factor is small, so halves of the number
    times the factor are exact), so a number just beside a decimal half goes to the side where it lies.
    """
    x, scale = F.abs(_col(value)), float(10 ** digits)
    split = x * F.lit(134217729.0)
    high = split - (split - x)
    product = x * F.lit(scale)
    error = (high * F.lit(scale) - product) + (x - high) * F.lit(scale)
    whole = F.floor(product)
    over = (product - whole.cast("double") - F.lit(0.5)) + error
    n = F.when(over > 0, whole + 1).when(over < 0, whole).otherwise(whole + whole % 2)
    text = F.concat(F.floor(n / F.lit(scale)).cast("string"), F.lit("."), F.lpad((n % int(scale)).cast("string"), digits, "0"))
    return F.when(_col(value).isNotNull(), F.concat(F.when(_col(value) < 0, F.lit("-")).otherwise(F.lit("")), text))


def eta_in_words(seconds) -> Column:
    s = _col(seconds)
    minutes = F.bround(s / F.lit(60.0)).cast("int")
    return (F.when(s.isNull() | (s <= 0), F.lit("shortly"))
            .when(minutes < 1, F.lit("under a minute"))
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
            .otherwise(F.concat(fixed(minutes / F.lit(60.0), 1), F.lit(" h"))))


def freshness_grade(as_of, acquired_at, issued_at, valid_from, valid_to, override=None) -> Column:
    """live / recent / stale / expired relative to the stated validity window."""
    now, got, issued, start, end = map(_col, (as_of, acquired_at, issued_at, valid_from, valid_to))
    since = F.coalesce(issued, got)
    age = F.timestamp_diff("SECOND", since, now).cast("double")
    span = F.when(start.isNotNull() & end.isNotNull(),
                  F.timestamp_diff("SECOND", start, end).cast("double")).otherwise(F.lit(43200.0))
    share = age / F.greatest(span, F.lit(60.0))
    graded = (F.when(end.isNotNull() & (now > end), F.lit("expired"))
              .when(share <= 0.25, F.lit("live")).when(share <= 0.75, F.lit("recent")).otherwise(F.lit("stale")))
    return graded if override is None else F.coalesce(_col(override), graded)


def provenance_id(source_id, issued_at, acquired_at) -> Column:
    """``source@time`` in ISO form; microseconds are written when there are any."""
    at = F.coalesce(_col(issued_at), _col(acquired_at))
    micros = F.date_format(at, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.concat(_col(source_id), F.lit("@"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def display_value(value_num, value_text, unit) -> Column:
    v = _col(value_num)
    return F.when(v.isNotNull(), F.trim(F.concat(fixed(v, 2), F.lit(" "), _col(unit)))) \
        .otherwise(_col(value_text))


def alert_rank(inside, distance_nm, warn_nm, critical_nm) -> Column:
    """0 INFO, 1 WARN, 2 CRITICAL, 3 BREACH."""
    d = _col(distance_nm)
    return (F.when(_col(inside), F.lit(3)).when(d <= _col(critical_nm), F.lit(2))
            .when(d <= _col(warn_nm), F.lit(1)).otherwise(F.lit(0)))


def level_name(rank, levels=dims.ALERT_LEVELS) -> Column:
    return F.when(_col(rank).isNotNull(), F.get(F.array(*[F.lit(name) for name, _ in levels]), _col(rank)))


def shallow_penalty(depth_m, min_depth_m) -> Column:
    """0..1; unknown depth is no penalty."""
    depth, need = _col(depth_m), _col(min_depth_m) * F.lit(dims.ROUTE_SAFETY_FACTOR)
    ramp = (need + F.lit(dims.ROUTE_RAMP_M) - depth) / F.lit(dims.ROUTE_RAMP_M)
    return (F.when(depth.isNull(), F.lit(0.0)).when(depth < need, F.lit(1.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ramp))))


def too_shallow(depth_m, min_depth_m) -> Column:
    return F.coalesce(_col(depth_m) < _col(min_depth_m), F.lit(False))


def boundary_penalty(distance_nm, soft_nm=dims.ROUTE_SOFT_NM, hard_nm=dims.ROUTE_HARD_NM) -> Column:
    """0..1 rising toward the line; null distance (far away) is no penalty."""
    ramp = (F.lit(soft_nm) - _col(distance_nm)) / F.lit(soft_nm - hard_nm)
    return F.when(ramp.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ramp)))


def too_close(distance_nm, hard_nm=dims.ROUTE_HARD_NM) -> Column:
    return F.coalesce(_col(distance_nm) <= F.lit(hard_nm), F.lit(False))


def adverse_current(speed_kn, toward_deg, bearing) -> Column:
    """Penalty rate of a current set against the course; null current is no penalty."""
    along = _col(speed_kn) * F.cos(F.radians(_col(toward_deg) - _col(bearing)))
    rate = F.lit(dims.ROUTE_WEIGHTS["current"]) * F.greatest(F.lit(0.0), -along) \
        / F.lit(dims.ROUTE_NORMALISERS["current_max_kn"])
    return F.when(along.isNull(), F.lit(0.0)).otherwise(rate)


def fill_message(copy, name, distance_nm, eta, title=None) -> Column:
    """A class's copy with its placeholders filled; an empty name is the class title."""
    distance = F.coalesce(fixed(distance_nm, 1), F.lit("?"))
    shown = F.coalesce(F.when(_col(name) != "", _col(name)), F.lit("") if title is None else _col(title), F.lit(""))
    text = F.replace(_col(copy), F.lit("{name}"), shown)
    text = F.replace(text, F.lit("{distance}"), distance)
    return F.replace(text, F.lit("{eta}"), _col(eta))


def local_clock(ts, zone: str = dims.REGION_ZONE, label: str = dims.REGION_ZONE_LABEL) -> Column:
    """``HH:MM on Day D Mon ZONE`` in the region's zone, from a zone-less UTC timestamp."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(ts))
    return F.concat(F.date_format(local, "HH:mm 'on' EEE d MMM"), F.lit(" " + label))
