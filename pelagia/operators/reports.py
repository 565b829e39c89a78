"""Roll-ups: traces, hazards, layers, alerts, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pelagia import dims
from pelagia.plans.ordered import EPOCH
from pelagia.session import cut_lineage


def trace_list(steps: DataFrame, limit: int = 20) -> DataFrame:
    """Newest queries first: span, totals, agents, tools, question and verdict."""
    levels = [name for name, _ in dims.VERDICT_LEVELS]
    token = F.regexp_extract("result_digest", r"Verdict: ([^.\s]*)", 1)
    ceiling = F.when((F.col("kind") == "ceiling") & F.col("level").isin(levels), F.col("level"))
    spoken = F.when((F.col("kind") == "tool_result") & (F.col("tool") == "evaluate_verdict") & token.isin(levels), token)
    order = F.struct("ts", "step_id")
    plan = F.when(F.col("kind") == "plan", order)
    return (steps.groupBy("query_id").agg(
        F.min("ts").alias("started"), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("span_s"),
        F.sum("duration_ms").alias("total_ms"), F.count(F.lit(1)).alias("n_steps"),
        F.array_join(F.array_sort(F.collect_set("agent")), ",").alias("agents"),
        F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"), F.bool_and("ok").alias("all_ok"),
        F.min_by("question", plan).alias("question"), F.min_by("surface", plan).alias("surface"),
        F.coalesce(F.min_by(ceiling, F.when(ceiling.isNotNull(), order)),
                   F.min_by(spoken, F.when(spoken.isNotNull(), order))).alias("verdict"))
        .orderBy(F.col("started").desc(), "query_id").limit(limit))


def trace_stats(steps: DataFrame) -> DataFrame:
    """Counts per tool, per agent and overall in one pass."""
    return steps.groupingSets([["tool"], ["agent"], []], "tool", "agent").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n_steps"),
        F.count_distinct("query_id").alias("n_queries")).select(
        F.when(F.col("_g") == 1, "tool").when(F.col("_g") == 2, "agent").otherwise("all").alias("by"),
        F.coalesce("tool", "agent", F.lit("")).alias("name"), "n_steps", "n_queries")


def trace_sections(steps: DataFrame) -> DataFrame:
    """Steps bucketed into plan / evidence / verdict / ceiling / synthesis / error, with the span of each."""
    section = (F.when(~F.col("ok"), "error").when(F.col("tool") == "evaluate_verdict", "verdict")
               .when(F.col("kind").isin("plan", "ceiling", "synthesis"), F.col("kind")).otherwise("evidence"))
    return steps.groupBy("query_id", section.alias("section")).agg(
        F.count(F.lit(1)).alias("n_steps"), F.min("ts").alias("first_ts"),
        F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("span_s"))


def trace_tree(steps: DataFrame) -> DataFrame:
    """Root and depth of every step by pointer doubling.

    An unknown or own parent makes a root; a cycle is cut by making its smallest step id a root.
    """
    ids = steps.select("query_id", "step_id")
    known = ids.select("query_id", F.col("step_id").alias("parent_id"), F.lit(True).alias("_k"))
    # anc = the 2^k-th ancestor (or the root), seen = smallest step id met on the way there
    state = steps.select("query_id", "step_id", "parent_id").join(known, ["query_id", "parent_id"], "left").select(
        "query_id", "step_id",
        F.when(F.col("_k") & (F.col("parent_id") != F.col("step_id")), F.col("parent_id")).alias("anc"))
    state = _double(state.withColumn("parent", F.col("anc")).withColumn("depth", F.when(F.col("anc").isNull(), 0).otherwise(1)))
    return state


def _double(start: DataFrame) -> DataFrame:
    state = cut_lineage(start.withColumn("root", F.coalesce("anc", "step_id")).withColumn(
        "low", F.least("step_id", F.coalesce("anc", "step_id"))))
    total = state.count()
    rounds = max(1, total.bit_length()) + 1
    for n in range(rounds):
        up = state.select("query_id", F.col("step_id").alias("root"), F.col("root").alias("_r"),
                          F.col("depth").alias("_d"), F.col("low").alias("_l"), F.col("anc").alias("_a"))
        state = cut_lineage(state.join(up, ["query_id", "root"], "left").select(
            "query_id", "step_id", "parent", F.when(F.col("anc").isNotNull(), F.col("_a")).alias("anc"),
            F.coalesce("_r", "root").alias("root"), (F.col("depth") + F.when(F.col("anc").isNotNull(), F.coalesce("_d", F.lit(0)))
                                                     .otherwise(F.lit(0))).cast("long").alias("depth"),
            F.least("low", F.coalesce("_l", "low")).alias("low")))
        if not state.where(F.col("anc").isNotNull()).limit(1).count():
            return state.select("query_id", "step_id", "parent", "root", "depth")
    # What still has an ancestor hangs below a cycle: cut it at the cycle's smallest step id.
    # By now every far ancestor lies on a cycle, and a cycle member's path is the cycle itself.
    looped = state.where(F.col("anc").isNotNull())
    on_cycle = looped.select("query_id", F.col("anc").alias("step_id")).distinct()
    cuts = looped.join(on_cycle, ["query_id", "step_id"], "left_semi").select(
        "query_id", F.col("low").alias("step_id")).distinct().withColumn("_cut", F.lit(True))
    again = state.join(cuts, ["query_id", "step_id"], "left").select(
        "query_id", "step_id", F.when(F.col("_cut").isNull(), F.col("parent")).alias("anc"))
    return _double(again.withColumn("parent", F.col("anc")).withColumn("depth", F.when(F.col("anc").isNull(), 0).otherwise(1)))


def track_counts(points: DataFrame) -> DataFrame:
    """Per cyclone: number of track points and the level of the first."""
    return points.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.min_by("alert_level", F.struct("from_date", "episode_id")).alias("first_level"))


def hazard_summary(regions: DataFrame, key: str, events: DataFrame, polygons: DataFrame, tracks: DataFrame,
                   failed: DataFrame) -> DataFrame:
    """Counts of each hazard kind per region; no hazard only if all kinds are empty, unknown if all sources failed."""
    tagged = (events.select(key, F.lit("event").alias("kind")).unionByName(polygons.select(key, F.lit("polygon").alias("kind")))
              .unionByName(tracks.select(key, F.lit("track").alias("kind"))))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    counts = tagged.groupBy(key).agg(count("event").alias("events"), count("polygon").alias("polygons"),
                                     count("track").alias("tracks"))
    zero = F.lit(0).cast("bigint")
    joined = regions.select(key).join(counts, key, "left").join(failed.select(key, F.lit(True).alias("_f")), key, "left")
    cols = {c: F.coalesce(c, zero) for c in ("events", "polygons", "tracks")}
    total = cols["events"] + cols["polygons"] + cols["tracks"]
    return joined.select(key, *[c.alias(n) for n, c in cols.items()],
                         F.when(F.col("_f"), "unknown").when(total == 0, "no_active_hazard").otherwise("hazard").alias("state"))


def counts_per_class(features: DataFrame) -> DataFrame:
    """Features per fence class in canonical order; absent classes count zero."""
    counts = features.groupBy(F.col("layer").alias("fence_class")).agg(F.count(F.lit(1)).alias("n"))
    return dims.fence_classes(features.sparkSession).join(counts, "fence_class", "left").select(
        "fence_class", "class_order", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_features"))


def layer_catalogue(features: DataFrame, layers: list[str]) -> DataFrame:
    """Per layer: feature count, source and time of the newest feature; absent layers count zero."""
    newest = F.struct("acquired_at", "seq")
    per = features.groupBy("layer_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("source_id", newest).alias("source_id"),
                                           F.max("acquired_at").alias("acquired_at"))
    names = dims.table(features.sparkSession, [(n,) for n in layers], "layer_id")
    return names.join(per, "layer_id", "left").select(
        "layer_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_features"), "source_id", "acquired_at")


def worst_level(rows: DataFrame, keys: list[str], rank: str, known_keys: DataFrame, empty_rank: int) -> DataFrame:
    """Maximum rank per key; a key without rows gets the given rank."""
    worst = rows.groupBy(*keys).agg(F.max(rank).alias("_w"))
    return known_keys.join(worst, keys, "left").select(*keys, F.coalesce("_w", F.lit(empty_rank)).alias("worst_rank"))


def ingest_report(runs: DataFrame) -> DataFrame:
    """Per run: sources, failures and rows; the run fails only if every source failed."""
    return runs.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_sources"), F.count_if(~F.col("ok")).alias("n_failed"), F.sum("n_rows").alias("n_rows"),
        F.bool_or("ok").alias("run_ok"))


def observation_contract(observations: DataFrame) -> DataFrame:
    """Every observation with its rejection reason, null when it is accepted."""
    both = F.col("value_num").isNotNull() & F.col("value_text").isNotNull()
    reason = (F.when(F.col("source_id").isNull(), "no provenance").when(F.col("acquired_at").isNull(), "no acquisition time")
              .when(both, "two values").when(F.col("value_num").isNull() & F.col("value_text").isNull(), "no value"))
    return observations.withColumn("reason", reason)


def verdict_contract(verdicts: DataFrame) -> DataFrame:
    """Legal level, and a handoff wherever the advice is not to go."""
    legal = F.coalesce(F.col("level").isin([n for n, _ in dims.VERDICT_LEVELS]), F.lit(False))
    reason = F.when(~legal, "illegal level").when(
        (F.col("level") == "DO_NOT_ADVISE") & F.col("handoff").isNull(), "no handoff")
    return verdicts.withColumn("reason", reason)


def extent_covers(products: DataFrame, bbox=dims.REGION_BBOX) -> DataFrame:
    """Whether each product's extent meets the region box (closed on all sides)."""
    west, south, east, north = bbox
    extent = products.groupBy("product").agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon")
                                               for n, f in (("min", F.min), ("max", F.max))])
    meets = (F.col("min_lon") <= east) & (F.col("max_lon") >= west) & (F.col("min_lat") <= north) & (F.col("max_lat") >= south)
    return extent.withColumn("covers", F.coalesce(meets, F.lit(False)))


# ---- alerts -------------------------------------------------------------------------


def alert_transitions(ticks: DataFrame, keys: list[str], acks: DataFrame | None = None) -> DataFrame:
    """Emit / suppress / clear for alerts evaluated once per tick.

    ``ticks`` has the key, an integer ``tick`` and ``level_rank``. A row is emitted when the
    key was not active in the tick before or its rank rose; a key absent from a tick is
    cleared there; an acknowledgement at a tick makes the key inactive for the next one.
    Each row is sent to its own tick and the next, so no per-key ordering is needed.
    """
    none = F.lit(None).cast("int")
    rows = ticks.select(*keys, F.inline(F.array(
        F.struct(F.col("tick").alias("tick"), F.col("level_rank").alias("cur"), none.alias("prev")),
        F.struct((F.col("tick") + 1).alias("tick"), none.alias("cur"), F.col("level_rank").alias("prev"))))).withColumn(
        "ack", F.lit(None).cast("boolean"))
    if acks is not None:
        rows = rows.unionByName(acks.select(*keys, (F.col("tick") + 1).alias("tick"), F.lit(None).cast("int").alias("cur"),
                                            F.lit(None).cast("int").alias("prev"), F.lit(True).alias("ack")))
    paired = rows.groupBy(*keys, "tick").agg(F.max("cur").alias("cur"), F.max("prev").alias("prev"), F.bool_or("ack").alias("ack"))
    prev = F.when(F.col("ack"), F.lit(None).cast("int")).otherwise(F.col("prev"))
    action = (F.when(F.col("cur").isNull(), F.when(prev.isNotNull(), F.lit("clear")))
              .when(prev.isNull() | (F.col("cur") > prev), F.lit("emit")).otherwise(F.lit("suppress")))
    return paired.withColumn("action", action).where(F.col("action").isNotNull()).select(
        *keys, "tick", F.coalesce("cur", "prev").alias("level_rank"), "action")


def active_difference(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Keys active in a tick and gone in the next tick that was evaluated at all."""
    shifted = ticks.select(*keys, (F.col("tick") + 1).alias("tick"))
    held = ticks.select("tick").distinct()
    return shifted.join(ticks.select(*keys, "tick"), [*keys, "tick"], "left_anti").join(held, "tick", "left_semi") \
        .select(*keys, "tick")


def alert_queue_store() -> list[Column]:
    """Level first, oldest first."""
    return [F.col("level_rank").desc(), F.col("created_at").asc(), F.col("alert_id")]


def alert_queue_console() -> list[Column]:
    """Unacknowledged first, then level, distance (missing last), newest."""
    return [F.col("acked").asc(), F.col("level_rank").desc(), F.col("distance_nm").asc_nulls_last(),
            F.col("created_at").desc(), F.col("alert_id")]


def tick_start(tick, seconds: int) -> Column:
    return F.timestamp_add("SECOND", F.col(tick) * seconds, F.expr(EPOCH))


def with_copy(rows: DataFrame, fence_class: str, level: str) -> DataFrame:
    """Adds ``copy`` and ``title`` of the class; INFO has no copy of its own and takes that of WARN."""
    spark = rows.sparkSession
    copy = dims.table(spark, dims.ALERT_COPY, "_class, _level, copy")
    titles = dims.table(spark, [(r[0], r[6]) for r in dims.FENCE_CLASSES], "_titled, title")
    shown = F.when(F.col(level) == "INFO", F.lit("WARN")).otherwise(F.col(level))
    return rows.join(copy, (F.col(fence_class) == F.col("_class")) & (shown == F.col("_level"))) \
        .join(titles, F.col(fence_class) == F.col("_titled")).drop("_class", "_level", "_titled")
