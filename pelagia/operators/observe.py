"""Readings of several sources: governing value, panel, dedupe, coverage, series statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pelagia import dims
from pelagia.functions import marine
from pelagia.plans.ordered import micros_of, previous_non_null, running_number, time_bucket

# Fixed values.
TREND_EPSILON = 0.05
DAYS_PER_DECADE = 3652.5
LONG_SPAN_DAYS = 730
STRIDE_DAYS = 8


def source_rank(observations: DataFrame) -> DataFrame:
    """Adds ``src_rank``: first matching prefix in the variable's order.

    An unknown source ranks after the listed ones; a variable without an order ties.
    """
    rank = F.lit(0)
    for variable in dict.fromkeys(v for v, _, _ in dims.GOVERNING_ORDER):
        order = [(p, n) for v, p, n in dims.GOVERNING_ORDER if v == variable]
        ladder = F.when(F.lit(False), F.lit(0))
        for prefix, n in order:
            ladder = ladder.when(F.col("source_id").startswith(prefix), F.lit(n))
        rank = F.when(F.col("variable") == variable, ladder.otherwise(F.lit(len(order)))).otherwise(rank)
    return observations.withColumn("src_rank", rank)


def governing_reading(observations: DataFrame, keys: list[str], as_of: Column, seq: str = "obs_id") -> DataFrame:
    """One reading per key and variable; never averaged. Rank, then time gap, then input order."""
    ranked = source_rank(observations.where(F.col("value_num").isNotNull()))
    rest = [c for c in observations.columns if c not in [*keys, "variable"]]
    order = F.struct("src_rank", F.abs(micros_of(as_of) - micros_of("valid_time")), seq)
    return (ranked.groupBy(*keys, "variable").agg(F.min_by(F.struct(*rest), order).alias("_g"))
            .select(*keys, "variable", *[F.col(f"_g.{c}").alias(c) for c in rest]))


def nearest_hour(observations: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """The hour nearest to ``as_of`` chosen over all variables together, with its readings."""
    hours = observations.withColumn("hour", F.date_trunc("HOUR", "valid_time").cast("timestamp_ntz"))
    gap = F.struct(F.abs(micros_of(as_of) - micros_of("hour")), F.col("hour"))
    best = hours.groupBy(*keys).agg(F.min_by("hour", gap).alias("hour"))
    return hours.join(best, [*keys, "hour"])


def readings_in_order(observations: DataFrame, keys: list[str]) -> DataFrame:
    """All readings side by side with their position, oldest input first."""
    return running_number(observations, [*keys, "variable"], [F.col("valid_time"), F.col("obs_id")],
                          time_bucket("valid_time", 3600), "position")


def disagreement_panel(observations: DataFrame, keys: list[str], as_of: Column, bulletin_band: Column) -> DataFrame:
    """Per variable: readings, sources, spread, the governing source and the band mismatch."""
    spread = observations.where(F.col("value_num").isNotNull()).groupBy(*keys, "variable").agg(
        F.count(F.lit(1)).alias("n_readings"), F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"),
        (F.max("value_num") - F.min("value_num")).alias("_spread"))
    ruling = governing_reading(observations, keys, as_of).select(
        *keys, "variable", F.col("source_id").alias("governing_source"), F.col("value_num").alias("governing_value"))
    joined = spread.join(ruling, [*keys, "variable"])
    model_band = marine.douglas_band("governing_value")
    return joined.select(
        *keys, "variable", "n_readings", "sources", "governing_source", "governing_value",
        F.when(F.col("n_readings") >= 2, F.round("_spread", 3)).alias("spread"),
        F.when(F.col("variable") == "significant_wave_height",
               F.coalesce(model_band != bulletin_band, F.lit(False))).otherwise(F.lit(False)).alias("band_mismatch"))


def evidence_groups(observations: DataFrame, keys: list[str], governing: DataFrame) -> DataFrame:
    """Variables grouped for the panel: category, who governs, whether sources disagree, order."""
    ids = governing.select(*keys, "obs_id", F.lit(True).alias("_g"))
    flagged = observations.join(ids, [*keys, "obs_id"], "left")
    categories = dims.table(observations.sparkSession, dims.EVIDENCE_CATEGORIES, "variable, category")
    groups = flagged.groupBy(*keys, "variable").agg(
        F.count(F.lit(1)).alias("n_readings"), F.bool_or(F.coalesce("_g", F.lit(False))).alias("governs"),
        (F.min("source_id") != F.max("source_id")).alias("disagreement"))
    return groups.join(categories, "variable", "left").select(
        *keys, "variable", F.coalesce("category", F.lit("other")).alias("category"), "n_readings", "governs", "disagreement",
        F.when(F.col("governs"), F.lit(0)).when(F.col("disagreement"), F.lit(1)).otherwise(F.lit(2)).alias("panel_rank"))


def wide_record(observations: DataFrame, keys: list[str], variables: list[str], as_of: Column) -> DataFrame:
    """One row per key with a column per variable (reading nearest in time) and the missing list."""
    gap = F.struct(F.abs(micros_of(as_of) - micros_of("valid_time")), F.col("obs_id"))
    known = observations.where(F.col("value_num").isNotNull())
    agg = [F.min_by("value_num", F.when(F.col("variable") == v, gap)).alias(v) for v in variables]
    wide = known.groupBy(*keys).agg(*agg)
    missing = F.array_compact(F.array(*[F.when(F.col(v).isNull(), F.lit(v)) for v in variables]))
    return wide.select(*keys, *variables, F.array_join(missing, ",").alias("missing"))


def first_evidence(observations: DataFrame, governing_ids: DataFrame) -> DataFrame:
    """First row per (variable, provenance id) in input order, with the governing flag."""
    rows = observations.withColumn("provenance_id", marine.provenance_id("source_id", "issued_at", "acquired_at"))
    first = rows.groupBy("variable", "provenance_id").agg(F.min("obs_id").alias("obs_id"))
    flags = governing_ids.select("obs_id").distinct().withColumn("_g", F.lit(True))
    return first.join(flags, "obs_id", "left").select(
        "variable", "provenance_id", "obs_id", F.coalesce("_g", F.lit(False)).alias("governs"))


def provenance_list(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct provenance ids per key in first-seen order, one row each."""
    rows = observations.withColumn("provenance_id", marine.provenance_id("source_id", "issued_at", "acquired_at"))
    first = rows.groupBy(*keys, "provenance_id").agg(F.min("obs_id").alias("first_seen"))
    return running_number(first, keys, [F.col("first_seen")], F.floor(F.col("first_seen") / 100_000), "position")


# ---- series -----------------------------------------------------------------------


def local_extrema(series: DataFrame, keys: list[str], time: str, value: str, bucket_s: int = 3600) -> DataFrame:
    """Highs and lows of a series; plateaus and missing values are skipped.

    When the direction differs from the last non-zero direction, the previous row is the
    extremum. Works bucket by bucket, so one long series is spread over many tasks.
    """
    known = series.where(F.col(value).isNotNull()).withColumn("_t", micros_of(time))
    slot = F.floor(F.col("_t") / F.lit(bucket_s * 1_000_000)).cast("long")
    stepped = previous_non_null(known, keys, ["_t"], slot,
                                {"prev_time": F.col(time), "prev_value": F.col(value)})
    signed = stepped.withColumn("_sign", F.signum(F.col(value) - F.col("prev_value")).cast("int"))
    moving = F.when(F.col("_sign") != 0, F.col("_sign"))
    turned = previous_non_null(signed, keys, ["_t"], slot, {"last_sign": moving})
    flip = (F.col("_sign") != 0) & (F.col("last_sign").isNotNull()) & (F.col("_sign") != F.col("last_sign"))
    return turned.where(flip).select(
        *keys, F.col("prev_time").alias(time), F.col("prev_value").alias(value),
        F.when(F.col("last_sign") > 0, F.lit("high")).otherwise(F.lit("low")).alias("kind"))


def next_extrema(extrema: DataFrame, keys: list[str], time: str, value: str, as_of: Column) -> DataFrame:
    """First high and first low at or after ``as_of``."""
    ahead = extrema.where(F.col(time) >= as_of)
    at = lambda kind, c: F.min_by(c, F.when(F.col("kind") == kind, F.col(time)))
    return ahead.groupBy(*keys).agg(
        F.min(F.when(F.col("kind") == "high", F.col(time))).alias("next_high"), at("high", value).alias("high_value"),
        F.min(F.when(F.col("kind") == "low", F.col(time))).alias("next_low"), at("low", value).alias("low_value"))


def ols_trend(series: DataFrame, keys: list[str], time: str, value: str, origin: str = "2000-01-01 00:00:00") -> DataFrame:
    """Slope per decade and its standard error, plus the series summary.

    Fewer than two points or no spread in time gives no slope; the error needs three.
    """
    days = F.timestamp_diff("MICROSECOND", F.expr(f"timestamp_ntz'{origin}'"), F.col(time)) / F.lit(86_400_000_000.0)
    known = series.where(F.col(value).isNotNull()).withColumn("_x", days)
    stats = known.groupBy(*keys).agg(
        F.count(value).alias("n_points"), F.regr_sxx(value, "_x").alias("_sxx"), F.regr_syy(value, "_x").alias("_syy"),
        F.regr_sxy(value, "_x").alias("_sxy"), F.avg(value).alias("mean_value"),
        F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.max_by(value, time).alias("last_value"))
    usable = (F.col("n_points") >= 2) & (F.col("_sxx") > 0)
    residual = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"))
    return stats.select(
        *keys, "n_points", "mean_value", "first_time", "last_time", "last_value",
        F.when(usable, F.col("_sxy") / F.col("_sxx") * DAYS_PER_DECADE).alias("slope_per_decade"),
        F.when(usable & (F.col("n_points") >= 3),
               F.sqrt(residual / (F.col("n_points") - 2) / F.col("_sxx")) * DAYS_PER_DECADE).alias("slope_se"))


def trend_direction(slope, epsilon) -> Column:
    s, e = F.col(slope) if isinstance(slope, str) else slope, epsilon if isinstance(epsilon, Column) else F.lit(epsilon)
    return (F.when(s.isNull(), F.lit("unknown")).when(F.abs(s) <= F.coalesce(e, F.lit(0.0)), F.lit("stable"))
            .when(s > 0, F.lit("rising")).otherwise(F.lit("falling")))


def trend_conflict(trends: DataFrame, keys: list[str], signal: str, a: str, b: str) -> DataFrame:
    """Two signals side by side; opposite movement is flagged, never averaged."""
    side = lambda s: F.max(F.when(F.col(signal) == s, F.col("direction")))
    both = trends.groupBy(*keys).agg(side(a).alias("first_direction"), side(b).alias("second_direction"))
    opposite = F.array_sort(F.array("first_direction", "second_direction")) == F.array(F.lit("falling"), F.lit("rising"))
    return both.withColumn("conflict", F.coalesce(opposite, F.lit(False)))


def strided(series: DataFrame, keys: list[str], day: str, stride_days: int | None = None, long_span_days: int = LONG_SPAN_DAYS) -> DataFrame:
    """Every ``stride_days``-th day of spans longer than ``long_span_days``; without a stride the whole series.

    Thinning is for a reader that fetches day by day; trends read the whole series.
    """
    if stride_days is None:
        return series
    span = series.groupBy(*keys).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    days = lambda a, b: F.floor(F.timestamp_diff("SECOND", F.col(a), F.col(b)) / 86400)
    joined = series.join(span, keys)
    return joined.where((days("_first", "_last") <= long_span_days) | (days("_first", day) % stride_days == 0)) \
        .select(*series.columns)


def needed_hours(target, as_of) -> dict[str, Column]:
    """Past and future hours to request around a target: whole hours plus one, at least one."""
    ahead = F.timestamp_diff("SECOND", as_of, target) / F.lit(3600.0)
    reach = lambda c: F.greatest(F.lit(1), F.ceil(c).cast("int") + 1)
    return {"past_hours": F.when(ahead < 0, reach(-ahead)).otherwise(F.lit(1)),
            "future_hours": F.when(ahead > 0, reach(ahead)).otherwise(F.lit(1))}


def clamp_hours(hours) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(240), F.coalesce(hours, F.lit(24))))


# ---- unions and fallbacks -----------------------------------------------------------


def union_readings(*sources: DataFrame) -> DataFrame:
    """All readings of all sources; a source that failed simply brings no rows."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def source_gaps(observations: DataFrame, keys: list[str], expected: list[str]) -> DataFrame:
    """Expected sources absent per key: named gaps, never defaults."""
    seen = observations.groupBy(*keys).agg(F.collect_set(
        F.when(F.col("source_id").isin(expected), F.col("source_id"))).alias("_seen"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(s) for s in expected]), F.col("_seen")))
    return seen.select(*keys, F.array_join(missing, ",").alias("missing"), (F.size(missing) > 0).alias("partial"))


def first_valid_source(observations: DataFrame, keys: list[str], priority: list[str]) -> DataFrame:
    """The first source with any valid value wins whole; nothing is blended."""
    rank = F.coalesce(*[F.when(F.col("source_id") == s, F.lit(n)) for n, s in enumerate(priority)])
    ranked = observations.withColumn("_p", rank).where(F.col("_p").isNotNull())
    winner = ranked.where(F.col("value_num").isNotNull()).groupBy(*keys).agg(F.min("_p").alias("_p"))
    return ranked.join(winner, [*keys, "_p"]).drop("_p")


def source_coverage(observations: DataFrame, as_of: Column) -> DataFrame:
    """Per source: rows, newest issue, granule age, resolution and cadence from the source table."""
    per = observations.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.coalesce("issued_at", "acquired_at")).alias("newest"))
    info = dims.table(observations.sparkSession, dims.SOURCE_CADENCE, "source_id, resolution, cadence, validity_h")
    age = F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", F.col("newest"), as_of) / F.lit(3600.0))
    return info.join(per, "source_id", "left").select(
        "source_id", "resolution", "cadence", F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"), "newest",
        age.alias("age_h"), F.col("n_rows").isNotNull().alias("reachable"), "validity_h")


def source_status(coverage: DataFrame, probes_failed: Column, closed_archive: Column) -> DataFrame:
    """FAIL if nothing was reached, STALE past the validity window, else OK; archives never go stale."""
    stale = F.col("age_h") > F.col("validity_h")
    return coverage.withColumn("status", F.when(probes_failed, F.lit("FAIL")).when(stale & ~closed_archive, F.lit("STALE"))
                               .otherwise(F.lit("OK")))


def convert_units(rows: DataFrame, value: str, raw_unit: str, name: str = "converted") -> DataFrame:
    """A row for each standard unit that the raw one converts to, with ``unit`` and the converted value; unknown units give none."""
    units = dims.table(rows.sparkSession, dims.UNITS, "_raw, unit, _factor")
    kept = rows.drop("unit")
    return kept.join(units, F.lower(F.trim(raw_unit)) == F.lower("_raw")).withColumn(name, F.col(value) * F.col("_factor")).drop("_raw", "_factor")
