"""Three-level advice: thresholds, advisory ceiling, hand-off. Ranks: 0 go, 1 caution, 2 do not advise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pelagia import dims
from pelagia.functions import marine
from pelagia.functions.geo import _col

# Fixed values.
PORT_SIGNAL = r"\b(SIGNAL\s*(NO\.?|NUMBER)?\s*[IVX0-9]+|[IVX]{1,4}\s*$)"
NIL_WORDS = ("NO SIGNAL", "NONE", "NO WARNING SIGNAL")
SEA_PATTERN = "(?<![A-Z])(" + "|".join(
    p.replace("(", r"\(").replace(")", r"\)") for p, _ in dims.SEA_PHRASES) + ")(?![A-Z])"
GO, CAUTION, DO_NOT_ADVISE = 0, 1, 2


def normal_sea_text(text) -> Column:
    return F.trim(F.regexp_replace(F.upper(_col(text)), r"[\s ]+", " "))


def sea_phrases(text) -> Column:
    """Sea-state phrases in text order; a longer phrase is never read again as a shorter one."""
    return F.regexp_extract_all(normal_sea_text(text), F.lit(SEA_PATTERN), F.lit(1))


def sea_bands(text) -> Column:
    bands = F.create_map(*[x for p, b in dims.SEA_PHRASES for x in (F.lit(p), F.lit(b))])
    return F.transform(sea_phrases(text), lambda p: bands[p])


def worst_band(text) -> Column:
    """Worst Douglas band named; null when the text names none."""
    return F.array_max(sea_bands(text))


def escalating(text) -> Column:
    norm = normal_sea_text(text)
    hit = F.lit(False)
    for marker in dims.ESCALATION_MARKERS:
        hit = hit | norm.contains(marker)
    return hit


def port_signal_hoisted(signal) -> Column:
    """Anything present that is not an explicit nil; an empty text counts as hoisted, null does not."""
    s = F.upper(F.trim(_col(signal)))
    nil = (s != "") & ~s.rlike(PORT_SIGNAL) & (s.contains("NIL") | s.isin(*NIL_WORDS))
    return F.when(_col(signal).isNull(), F.lit(False)).otherwise(~nil)


def names_district(warning, district) -> Column:
    """Substring, or a token equal to the district, or the same first six letters."""
    text, name = F.upper(_col(warning)), F.upper(F.trim(_col(district)))
    plain = F.regexp_replace(name, "[^A-Z]+", "")
    tokens = F.filter(F.split(text, "[^A-Z]+"), lambda t: F.length(t) > 3)
    close = F.exists(tokens, lambda t: (t == plain) | (
        (F.length(t) >= 6) & (F.length(plain) >= 6) & (F.substring(t, 1, 6) == F.substring(plain, 1, 6))))
    usable = (text != "") & (name != "")
    return F.coalesce(usable & (text.contains(name) | close), F.lit(False))


# ---- thresholds -----------------------------------------------------------------------


def threshold_checks(conditions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and checked variable from wide ``conditions``.

    ``conditions`` has the keys, ``vessel_class`` and hs, wind, gust, period, visibility.
    A missing value or limit is GO with ``evidenced`` false; a missing visibility is not checked.
    """
    steep = F.round(marine.wave_steepness("hs", "period"), 5)
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), c.cast("double").alias("value")) for v, c in (
        ("significant_wave_height", F.col("hs")), ("wind_speed", F.col("wind")), ("wind_gust", F.col("gust")),
        ("wave_steepness", steep), ("visibility", F.col("visibility")))])
    long = conditions.select(*keys, "vessel_class", F.inline(rows))
    joined = long.join(dims.vessel_limits(conditions.sparkSession), ["vessel_class", "variable"])
    v, go, caution = F.col("value"), F.col("go_limit"), F.col("caution_limit")
    rank = (F.when(v.isNull(), F.lit(GO))
            .when(~F.col("higher_is_worse"), F.when(v < go, F.lit(CAUTION)).otherwise(F.lit(GO)))
            .when(v > caution, F.lit(DO_NOT_ADVISE)).when(v > go, F.lit(CAUTION)).otherwise(F.lit(GO)))
    return joined.where(F.col("higher_is_worse") | v.isNotNull()).select(
        *keys, "vessel_class", "variable", "check_order", "value", "go_limit", "caution_limit",
        rank.alias("level_rank"), v.isNotNull().alias("evidenced"))


def baseline(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Worst of the checks; reasons are the failing ones, else the first two evidenced.

    At most five checks exist per key, so the ordered lists stay short.
    """
    entry = F.struct("check_order", "variable")
    lists = checks.groupBy(*keys).agg(
        F.max("level_rank").alias("level_rank"),
        F.array_sort(F.collect_set(F.when(F.col("level_rank") > 0, entry))).alias("_bad"),
        F.array_sort(F.collect_set(F.when(F.col("evidenced"), entry))).alias("_seen"))
    chosen = F.when(F.size("_bad") > 0, F.col("_bad")).otherwise(F.slice("_seen", 1, 2))
    return lists.select(*keys, "level_rank", F.array_join(F.transform(chosen, lambda e: e["variable"]), ",").alias("reasons"))


def apply_proposal(level_rank, proposed_rank) -> dict[str, Column]:
    """A proposal may only worsen the advice; a more permissive one is rejected and noted."""
    rank, proposed = _col(level_rank), _col(proposed_rank)
    return {"level_rank": F.greatest(rank, F.coalesce(proposed, rank)),
            "proposal_rejected": F.coalesce(proposed < rank, F.lit(False))}


# ---- ceiling --------------------------------------------------------------------------


def missing_inputs(row: DataFrame) -> Column:
    """Names of required bulletin inputs that are absent; any of them ends the evaluation."""
    has_text = F.coalesce(F.trim("sea_condition") != "", F.lit(False))
    return F.array_compact(F.array(
        F.when(F.col("bulletin_id").isNull(), F.lit("bulletin")),
        F.when(~has_text, F.lit("sea_condition")),
        F.when(has_text & F.col("band").isNull(), F.lit("sea_condition_parse")),
        F.when(F.col("valid_from").isNull() | F.col("valid_to").isNull(), F.lit("bulletin_validity"))))


def band_caps(spark) -> Column:
    """Map ``class:band`` -> most permissive rank, with below-lowest and unlisted rules applied."""
    listed = {(c, b): r for c, b, r in dims.VESSEL_BANDS}
    pairs = []
    for name in (row[0] for row in dims.VESSEL_CLASSES):
        lowest = min(b for c, b in listed if c == name)
        for band in range(10):
            rank = listed.get((name, band), listed[(name, lowest)] if band < lowest else DO_NOT_ADVISE)
            pairs += [F.lit(f"{name}:{band}"), F.lit(rank)]
    return F.create_map(*pairs)


def compute_ceiling(rows: DataFrame) -> DataFrame:
    """Adds band, missing, rules and ceiling_rank.

    Needs bulletin_id, sea_condition, port_signal, storm_surge_warning, valid_from, valid_to,
    target_time, as_of, vessel_class, district, swell_period_s. The bulletin's age is judged by
    ``as_of``, coverage by ``target_time``; two different clocks.
    """
    base = rows.withColumn("band", worst_band("sea_condition"))
    base = base.withColumn("_missing", missing_inputs(base))
    expired = F.col("as_of") > F.col("valid_to")
    outside = (F.col("target_time") < F.col("valid_from")) | (F.col("target_time") > F.col("valid_to"))
    validity = F.when(expired, "bulletin_expired").when(outside, "bulletin_does_not_cover_departure")
    swell_limits = F.create_map(*[x for r in dims.VESSEL_CLASSES for x in (F.lit(r[0]), F.lit(r[-1]))])
    staged = base.select(
        "*", validity.alias("_validity"),
        F.coalesce(band_caps(rows.sparkSession)[F.concat_ws(":", "vessel_class", "band")], F.lit(DO_NOT_ADVISE)).alias("_band_cap"),
        port_signal_hoisted("port_signal").alias("_hoisted"),
        names_district("storm_surge_warning", "district").alias("_named"))
    staged = staged.withColumn("_swell", F.col("_named") & F.coalesce(
        F.col("swell_period_s") >= swell_limits[F.col("vessel_class")], F.lit(False)))
    complete = F.size("_missing") == 0
    rules = F.array_compact(F.array(
        F.col("_validity"), F.lit("douglas_band_cap"), F.when(F.col("_hoisted"), F.lit("port_signal_hoisted")),
        F.when(F.col("_named"), F.lit("storm_surge_names_district")), F.when(F.col("_swell"), F.lit("long_period_swell"))))
    rank = F.greatest(
        F.when(F.col("_validity").isNotNull(), F.lit(DO_NOT_ADVISE)).otherwise(F.lit(GO)), F.col("_band_cap"),
        F.when(F.col("_swell"), F.lit(DO_NOT_ADVISE)).when(F.col("_named") | F.col("_hoisted"), F.lit(CAUTION)).otherwise(F.lit(GO)))
    return staged.select(
        *base.columns[:-1], F.array_join("_missing", ",").alias("missing"),
        F.when(complete, F.array_join(rules, ",")).otherwise(F.lit("missing_required_input")).alias("rules"),
        F.when(complete, rank).otherwise(F.lit(DO_NOT_ADVISE)).alias("ceiling_rank"))


def apply_ceiling(rows: DataFrame) -> DataFrame:
    """Final rank is the stricter of own level and ceiling; not advising needs a hand-off.

    Needs level_rank, ceiling_rank and handoff (nearest centre, may be null).
    """
    lowered = F.col("ceiling_rank") > F.col("level_rank")
    final = F.greatest("level_rank", "ceiling_rank")
    authority = F.when(final == DO_NOT_ADVISE, F.coalesce("handoff", F.lit(dims.COAST_GUARD[0])))
    return rows.select(
        *[c for c in rows.columns if c not in ("level_rank", "handoff")], final.alias("level_rank"),
        marine.level_name(final, dims.VERDICT_LEVELS).alias("level"), lowered.alias("ceiling_applied"),
        F.when(lowered, marine.level_name(F.col("level_rank"), dims.VERDICT_LEVELS)).alias("downgraded_from"),
        authority.alias("handoff"))


def what_if(requests: DataFrame, key: str, first: Column, second: Column, evaluate) -> DataFrame:
    """Every request at two departure times; the more permissive one is recommended, a tie goes to the earlier.

    ``evaluate`` maps rows with ``target_time`` to rows with ``level_rank`` and ``valid_to``.
    """
    early, late = F.least(first, second), F.greatest(first, second)
    options = F.array(F.struct(F.lit("early").alias("option"), early.alias("target_time")),
                      F.struct(F.lit("late").alias("option"), late.alias("target_time")))
    judged = evaluate(requests.drop("target_time").select("*", F.inline(options)))
    at = lambda o, c: F.max(F.when(F.col("option") == o, F.col(c)))
    both = judged.groupBy(key).agg(
        at("early", "level_rank").alias("early_rank"), at("late", "level_rank").alias("late_rank"),
        at("early", "target_time").alias("_e"), at("late", "target_time").alias("_l"),
        at("early", "valid_to").alias("_ev"), at("late", "valid_to").alias("_lv"))
    better = F.coalesce(F.col("late_rank") < F.col("early_rank"), F.lit(False))
    return both.select(key, "early_rank", "late_rank", F.when(better, F.col("_l")).otherwise(F.col("_e")).alias("recommended"),
                       F.coalesce(F.col("_ev") != F.col("_lv"), F.lit(False)).alias("windows_differ"))


def wide_conditions(governing: DataFrame, keys: list[str]) -> DataFrame:
    """Governing readings as one row per key: hs, period, wind, gust, visibility."""
    names = {"hs": "significant_wave_height", "period": "wave_period", "wind": "wind_speed", "gust": "wind_gust",
             "visibility": "visibility"}
    return governing.groupBy(*keys).agg(*[
        F.max(F.when(F.col("variable") == v, F.col("value_num"))).alias(n) for n, v in names.items()])
