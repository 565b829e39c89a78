"""Bulk text analytics over question, answer and bulletin tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pelagia.functions.geo import _col
from pelagia.plans.ordered import previous_max
from pelagia.session import cut_lineage

# ---- fixed values -----------------------------------------------------------------

#: language, first and last character of its script block
SCRIPTS = (("ta", "\\x{0B80}", "\\x{0BFF}"), ("gu", "\\x{0A80}", "\\x{0AFF}"), ("hi", "\\x{0900}", "\\x{097F}"),
           ("te", "\\x{0C00}", "\\x{0C7F}"), ("ml", "\\x{0D00}", "\\x{0D7F}"), ("kn", "\\x{0C80}", "\\x{0CFF}"),
           ("bn", "\\x{0980}", "\\x{09FF}"), ("or", "\\x{0B00}", "\\x{0B7F}"))
ROMANISED = {
    "ta": ("kadal", "meen", "padagu", "vaanilai", "alai", "kaatru", "naalai", "indru", "pogalama", "poidalama",
           "epadi", "enna", "engey", "seivathu", "vanakkam", "thuraimugam", "meenavar", "kaatu", "neer"),
    "gu": ("dariya", "machhi", "hodi", "havaman", "aavti", "kale", "kem", "kya"),
    "hi": ("samudra", "machhli", "nav", "mausam", "lehar", "hawa", "kal", "aaj"),
}
INTENTS = {
    "safety_check": ("safe", "go out", "should i go", "can i go", "risky", "danger", "weather ok", "கடலுக்கு", "போகலாமா",
                     "பாதுகாப்பு", "ஆபத்து", "pogalama", "kadal poga", "jaay", "surakshit"),
    "fishing_zone": ("fishing zone", "pfz", "where to fish", "fish", "catch", "shoal", "school", "மீன்", "மீன்பிடி", "meen",
                     "machhi", "productive"),
    "route": ("route", "way to", "how do i get", "navigate", "passage", "safest way", "course", "பாதை", "வழி", "paathai", "vazhi"),
    "geofence": ("boundary", "border", "imbl", "sri lanka", "line", "arrest", "detain", "limit", "எல்லை", "இலங்கை", "ellai",
                 "border cross"),
    "hazard": ("cyclone", "storm", "lightning", "thunder", "warning", "alert", "surge", "hazard", "hazards", "hazardous",
               "dangerous", "rough sea", "bad weather", "புயல்", "மின்னல்", "எச்சரிக்கை", "puyal", "minnal", "toofan"),
    "ocean_productivity": ("chlorophyll", "chlorophyl", "chlorophyll concentration", "plankton", "bloom",
                           "sea surface temperature", "sst", "water temperature", "warm water", "productive waters",
                           "feeding ground", "feeding grounds", "upwelling", "front", "favourable", "favorable", "பச்சையம்",
                           "கடல்நீர் வெப்பநிலை", "chlorophyll alavu"),
    "avoid_zone": ("avoid", "avoids", "avoided", "avoiding", "keep out", "stay away", "stay clear", "geofence", "geofences",
                   "geofencing", "geofenced", "no-go", "off limits", "restricted", "restriction", "restrictions", "prohibited",
                   "banned", "closed area", "not allowed", "should not enter", "தவிர்", "தடை", "thavir", "thadai"),
    "tide": ("tide", "high water", "low water", "current", "நீரோட்டம்", "அலை", "ambu"),
    "productivity": ("productivity", "declined", "decline", "fewer fish", "less fish", "why has", "catch is down", "stock",
                     "over the years", "வீழ்ச்சி", "குறைந்த"),
    "harbour": ("harbour", "harbor", "landing centre", "landing center", "nearest port", "shelter", "துறைமுகம்", "thuraimugam"),
    "scenario": ("what if", "instead of", "rather than", "compare", "leave at", "earlier", "later", "என்றால்", "pathilaga"),
    "fleet": ("vessels", "boats", "ships", "trawlers", "fleet", "which vessel", "which boat", "which ship", "how many boats",
              "how many vessels", "nearest vessel", "closest vessel", "nearest boat", "closest boat", "படகுகள்", "padagugal"),
}
DECISION = INTENTS["safety_check"] + INTENTS["route"] + INTENTS["scenario"] + (
    "put to sea", "set out", "head out", "depart", "sail", "venture out", "launch")
INFORMATION = ("what", "which", "where", "why", "who", "list", "show", "explain", "describe", "how many", "how much", "how far",
               "how long", "how deep", "when is", "when does", "tell me", "status of", "closest to", "nearest to", "are there",
               "is there", "any active", "do we have", "என்ன", "எங்கே", "ஏன்", "எத்தனை", "எப்போது", "யார்", "enna", "enge",
               "ethanai", "eppo", "yaar")
BOUNDARY_CUES = (("HAZARD_EXCLUSION", ("cyclone", "hazard", "storm", "exclusion")),
                 ("ECO_SENSITIVE", ("coral", "seagrass", "mangrove", "sensitive", "habitat")),
                 ("MPA", ("park", "mpa", "marine national", "reserve", "sanctuary")),
                 ("IMBL", ("imbl", "boundary", "border", "maritime line")))
#: phrase, hours ahead — the first one present counts
TIME_CUES = (("tomorrow morning", 24), ("tomorrow", 24), ("tonight", 8), ("this evening", 6), ("now", 0), ("நாளை", 24),
             ("இன்று", 0), ("naalai", 24), ("indru", 0))
MORNING, EVENING = ("morning", "காலை", 5), ("evening", "மாலை", 16)
CLOCK = r"\b([01]?\d|2[0-3])[:.]([0-5]\d)\b"
#: Numbers that are never data.
ALLOWED_NUMBERS = ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "12", "24", "100", "1554", "1974", "1976", "2026")
TOLERANCE = 0.06
TERMINATORS = ".!?।"
SPACES = r"[\s\p{Z}]+"
#: The token is taken whole inside the look-ahead, so it cannot be shortened to pass the tests after it.
NUMBER = r"(?<![\w.])(?<![:\-/])(?=(\d{1,4}(?:[.,]\d{1,3})?)(?!\w))\1(?![:\-/])"

# ---- normalisation ----------------------------------------------------------------


@F.pandas_udf(T.StringType())
def compose(text: pd.Series) -> pd.Series:
    """NFC composition; the one text step without a built-in function."""
    return text.str.normalize("NFC")


def collapse(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), SPACES, " "))


def normalise(text, nfc: bool = False) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    return collapse(compose(t) if nfc else t)


def bulletin_clean(text) -> Column:
    """Non-breaking spaces become spaces; white space is collapsed."""
    return collapse(F.regexp_replace(_col(text), "&nbsp;|\\x{00A0}", " "))


# ---- language, intent, kind ---------------------------------------------------------


def with_language(df: DataFrame, text: str, allowed: tuple[str, ...] | None = None, name: str = "lang_found") -> DataFrame:
    """Dominant script, else most romanised cue words, else English.

    Scripts that tie are decided by which appears first in the text.
    """
    t = F.trim(F.coalesce(_col(text), F.lit("")))
    counts = F.array(*[F.struct((-F.regexp_count(t, F.lit(f"[{a}-{b}]"))).alias("n"),
                                F.regexp_instr(t, F.lit(f"[{a}-{b}]")).alias("at"), F.lit(c).alias("c")) for c, a, b in SCRIPTS])
    top = F.array_min(counts)
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(t), r"[^a-z\s]", " ")), r"\s+"))
    romanised = [c for c in ROMANISED if allowed is None or c in allowed]
    among = lambda cues: F.filter("_words", lambda w: w.isin(*cues))
    cue_counts = F.array(*[F.struct((-F.size(among(ROMANISED[c]))).alias("n"), F.lit(k).alias("k"), F.lit(c).alias("c"))
                           for k, c in enumerate(romanised)])
    script = F.col("_top.c") if allowed is None else F.when(F.col("_top.c").isin(*allowed), F.col("_top.c"))
    default = "en" if allowed is None or "en" in allowed else sorted(allowed)[0]
    best = F.array_min(cue_counts) if romanised else F.lit(None)
    staged = df.withColumns({"_top": top, "_words": words})
    cue = F.when(best["n"] < 0, best["c"]) if romanised else F.lit(None).cast("string")
    return staged.withColumn(name, F.coalesce(F.when(F.col("_top.n") < 0, script), cue, F.lit(default))).drop("_top", "_words")


def cue_hits(text: Column, words: Column, cues: tuple[str, ...]) -> Column:
    """Number of cue occurrences: plain words by token, phrases and other scripts by substring."""
    plain = [c for c in cues if c.isascii() and c.isalnum()]
    marked = [c for c in cues if c.isascii() and " " not in c and not c.isalnum()]
    loose = [c for c in cues if c not in plain and c not in marked]
    total = F.size(F.filter(words, lambda w: w.isin(*plain))) if plain else F.lit(0)
    for c in marked:
        total = total + F.regexp_count(text, F.lit(rf"(?<![a-z0-9]){c}(?![a-z0-9])"))
    for c in loose:
        total = total + ((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / len(c)).cast("int")
    return total


def _prepared(df: DataFrame, text: str) -> DataFrame:
    lowered = df.withColumn("_t", F.lower(normalise(text)))
    return lowered.withColumn("_words", F.split("_t", "[^a-z0-9]+"))


def with_intents(df: DataFrame, text: str) -> DataFrame:
    """Adds ``intents`` (most cued first, then name descending) and ``n_hits``."""
    scored = F.array(*[F.struct(cue_hits(F.col("_t"), F.col("_words"), cues).alias("n"), F.lit(name).alias("intent"))
                       for name, cues in INTENTS.items()])
    ranked = F.reverse(F.array_sort(F.filter("_scored", lambda s: s["n"] > 0)))
    named = F.array_join(F.transform(ranked, lambda s: s["intent"]), ",")
    return (_prepared(df, text).withColumn("_scored", scored)
            .withColumns({"intents": F.when(named == "", F.lit("safety_check")).otherwise(named),
                          "n_hits": F.aggregate("_scored", F.lit(0), lambda a, s: a + s["n"])})
            .drop("_t", "_words", "_scored"))


def with_answer_kind(df: DataFrame, text: str) -> DataFrame:
    """Decision cues beat information cues; without either the safe reading is advisory."""
    decision = cue_hits(F.col("_t"), F.col("_words"), tuple(dict.fromkeys(DECISION))) > 0
    information = cue_hits(F.col("_t"), F.col("_words"), INFORMATION) > 0
    return _prepared(df, text).withColumn(
        "answer_kind", F.when(~decision & information, F.lit("INFORMATIONAL")).otherwise(F.lit("ADVISORY"))).drop("_t", "_words")


def with_boundary_class(df: DataFrame, text: str) -> DataFrame:
    """First cue group present, null when the text names no boundary kind."""
    ladder = F.when(F.lit(False), F.lit(""))
    for name, cues in BOUNDARY_CUES:
        ladder = ladder.when(cue_hits(F.col("_t"), F.col("_words"), cues) > 0, F.lit(name))
    return _prepared(df, text).withColumn("boundary_class", ladder).drop("_t", "_words")


def with_departure(df: DataFrame, text: str, as_of: Column) -> DataFrame:
    """Adds ``departure`` and, when two clock times are named, ``first_time`` / ``second_time``."""
    t = F.lower(normalise(text))
    ladder = F.when(F.lit(False), F.lit(0))
    for cue, hours in TIME_CUES:
        ladder = ladder.when(F.col("_t").contains(cue), F.lit(hours))
    base = F.timestamp_add("HOUR", F.coalesce(ladder, F.lit(0)), as_of)
    staged = df.withColumn("_t", t).withColumns({
        "_base": base, "_h": F.regexp_extract_all("_t", F.lit(CLOCK), F.lit(1)),
        "_m": F.regexp_extract_all("_t", F.lit(CLOCK), F.lit(2))})
    day = F.date_trunc("DAY", "_base").cast("timestamp_ntz")
    clock = lambda k: F.timestamp_add("MINUTE", F.get("_h", F.lit(k)).cast("int") * 60 + F.get("_m", F.lit(k)).cast("int"), day)
    named = lambda part: F.when(F.col("_t").contains(part[0]) | F.col("_t").contains(part[1]), F.timestamp_add("HOUR", F.lit(part[2]), day))
    two = F.size("_h") >= 2
    return staged.withColumns({
        "departure": F.when(F.size("_h") > 0, clock(0)).otherwise(F.coalesce(named(MORNING), named(EVENING), F.col("_base"))),
        "first_time": F.when(two, F.least(clock(0), clock(1))), "second_time": F.when(two, F.greatest(clock(0), clock(1)))}) \
        .drop("_t", "_base", "_h", "_m")


# ---- numbers and sentences ----------------------------------------------------------


def number_tokens(text) -> Column:
    """Data-like numbers of a text: no clock times, dates, allowed literals."""
    found = F.regexp_extract_all(_col(text), F.lit(NUMBER), F.lit(1))
    return F.filter(found, lambda n: ~n.isin(*ALLOWED_NUMBERS))


def sourced_intervals(evidence: DataFrame, key: str) -> DataFrame:
    """(key, low, high) accepted around every sourced number: values, magnitudes, roundings, positions, qualifiers."""
    v = F.col("value_num")
    rounded = lambda c: [c, F.bround(c, 0), F.bround(c, 1), F.bround(c, 2)]
    place = lambda c: [F.col(c), F.bround(c, 2), F.bround(c, 3)]
    numbers = F.array(*rounded(v), *rounded(F.abs(v)), *place("lat"), *place("lon"),
                      *([F.col("qualifier"), F.abs("qualifier")] if "qualifier" in evidence.columns else []))
    s = evidence.select(key, F.explode(F.array_distinct(numbers)).alias("_s")).where(F.col("_s").isNotNull()).distinct()
    room = F.greatest(F.lit(TOLERANCE), F.abs("_s") * TOLERANCE)
    return s.select(key, (F.col("_s") - room).alias("low"), (F.col("_s") + room).alias("high"))


def unsourced(tokens: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """The rows of ``tokens`` (key, value, ...) inside no interval of their key.

    Distinct values and intervals are put in value order; a value is sourced when an interval
    that starts at or below it ends at or above it, that is when the running maximum of the
    ends reaches it. No value meets every interval, and repeated values are looked up once.
    """
    stacked = intervals.select(key, F.col("low").alias("_x"), F.lit(0).alias("_side"), F.col("high").alias("_end")).unionByName(
        tokens.select(key, "value").distinct().select(
            key, F.col("value").alias("_x"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_end")))
    slot = F.floor(F.col("_x") / 25).cast("long")
    reached = previous_max(stacked, [key], ["_x", "_side"], slot, F.col("_end"), "_reach")
    bad = reached.where((F.col("_side") == 1) & (F.coalesce("_reach", F.lit(float("-inf"))) < F.col("_x"))) \
        .select(key, F.col("_x").alias("value"))
    return tokens.join(bad, [key, "value"], "left_semi")


def audit_numbers(answers: DataFrame, evidence: DataFrame, key: str, answer_id: str, text: str) -> DataFrame:
    """Numbers of each answer that no evidence of its key supports."""
    tokens = answers.select(key, answer_id, F.explode(number_tokens(text)).alias("token")).withColumn(
        "value", F.replace(F.col("token"), F.lit(","), F.lit(".")).cast("double"))
    # Used twice (distinct values, then all rows), so the texts are tokenised once.
    return unsourced(cut_lineage(tokens), sourced_intervals(evidence, key), key)


def sentences(text) -> Column:
    return F.split(_col(text), r"(?<=[.!?।])[\s\p{Z}]+")


def drop_unsourced_sentences(answers: DataFrame, evidence: DataFrame, key: str, answer_id: str, text: str) -> DataFrame:
    """Each answer without the sentences that contain an unsupported number."""
    parts = answers.select(key, answer_id, F.posexplode(sentences(text)).alias("pos", "sentence"))
    tokens = parts.select(key, answer_id, "pos", F.explode(number_tokens("sentence")).alias("token")).withColumn(
        "value", F.replace(F.col("token"), F.lit(","), F.lit(".")).cast("double"))
    bad = unsourced(cut_lineage(tokens), sourced_intervals(evidence, key), key).select(answer_id, "pos").distinct()
    flagged = parts.join(bad.withColumn("_bad", F.lit(True)), [answer_id, "pos"], "left")
    kept = F.collect_list(F.when(F.col("_bad").isNull(), F.struct("pos", F.trim("sentence").alias("s"))))
    return flagged.groupBy(answer_id).agg(
        F.trim(F.array_join(F.transform(F.array_sort(kept), lambda k: k["s"]), " ")).alias("kept"),
        F.count("_bad").alias("n_removed"))


def tidy_sentences(parts: DataFrame, key: str, pos: str, part: str) -> DataFrame:
    """Trimmed, terminated once, first of equal sentences kept (case, spaces, end marks ignored)."""
    clean = collapse(part)
    same = F.lower(F.trim(F.regexp_replace("_s", f"[{TERMINATORS}]+$", "")))
    rows = parts.select(key, pos, clean.alias("_s")).withColumn("_k", same).where(F.col("_k") != "")
    first = rows.groupBy(key, "_k").agg(F.min_by("_s", pos).alias("_s"), F.min(pos).alias(pos))
    ended = F.when(F.col("_s").rlike(f"[{TERMINATORS}]$"), F.col("_s")).otherwise(F.concat("_s", F.lit(".")))
    return first.select(key, pos, ended.alias("sentence"))
