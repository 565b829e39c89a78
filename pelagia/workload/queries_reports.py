"""Trace, hazard, layer, alert and contract reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pelagia import dims
from pelagia.operators import fences as fence_ops, reports
from pelagia.plans.ordered import balanced
from pelagia.workload.queries_fences import LEVELS_SQL, TICKS_SQL, nearest_sql
from pelagia.workload.registry import query, r6
from pelagia.workload.views import Views

_VERDICT_SQL = """coalesce(arg_min(CASE WHEN kind = 'ceiling' AND level IN ('GO','GO_WITH_CAUTION','DO_NOT_ADVISE') THEN level END, turn) FILTER (WHERE kind = 'ceiling' AND level IN ('GO','GO_WITH_CAUTION','DO_NOT_ADVISE')),
    arg_min(regexp_extract(result_digest, 'Verdict: ([^.\\s]*)', 1), turn) FILTER (WHERE kind = 'tool_result' AND tool = 'evaluate_verdict' AND regexp_extract(result_digest, 'Verdict: ([^.\\s]*)', 1) IN ('GO','GO_WITH_CAUTION','DO_NOT_ADVISE')))"""


@query("a5_trace_list", f"""
SELECT query_id, min(ts) AS started, date_diff('second', min(ts), max(ts)) AS span_s, round(sum(duration_ms), 6) AS total_ms, count(*) AS n_steps,
       string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents, coalesce(string_agg(DISTINCT tool, ',' ORDER BY tool), '') AS tools, bool_and(ok) AS all_ok,
       arg_min(question, turn) FILTER (WHERE kind = 'plan') AS question, arg_min(surface, turn) FILTER (WHERE kind = 'plan') AS surface, {_VERDICT_SQL} AS verdict
FROM {{trace_steps}} GROUP BY query_id ORDER BY started DESC, query_id LIMIT 20""")
def a5(v: Views):
    return reports.trace_list(v.trace_steps)


@query("a12_trace_stats", """
SELECT 'tool' AS by, coalesce(tool, '') AS name, count(*) AS n_steps, count(DISTINCT query_id) AS n_queries FROM {trace_steps} GROUP BY tool
UNION ALL SELECT 'agent', coalesce(agent, ''), count(*), count(DISTINCT query_id) FROM {trace_steps} GROUP BY agent
UNION ALL SELECT 'all', '', count(*), count(DISTINCT query_id) FROM {trace_steps}""")
def a12(v: Views):
    return reports.trace_stats(v.trace_steps)


@query("q7_trace_sections", """
SELECT query_id, CASE WHEN NOT ok THEN 'error' WHEN tool = 'evaluate_verdict' THEN 'verdict' WHEN kind IN ('plan', 'ceiling', 'synthesis') THEN kind ELSE 'evidence' END AS section,
       count(*) AS n_steps, min(ts) AS first_ts, date_diff('second', min(ts), max(ts)) AS span_s FROM {trace_steps} GROUP BY 1, 2""")
def q7(v: Views):
    return reports.trace_sections(v.trace_steps)


@query("q6_trace_tree", """
WITH RECURSIVE up AS (
    SELECT query_id, step_id, turn, turn AS t, 0::BIGINT AS depth, step_id AS root FROM {trace_steps}
    UNION ALL
    SELECT u.query_id, u.step_id, u.turn, p.turn, u.depth + 1, p.step_id FROM up u JOIN {trace_steps} c ON c.query_id = u.query_id AND c.step_id = u.root
    JOIN {trace_steps} p ON p.query_id = c.query_id AND p.step_id = c.parent_id)
SELECT query_id, step_id, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY 1, 2""")
def q6(v: Views):
    return reports.trace_tree(v.trace_steps.dropDuplicates(["query_id", "step_id"])).select("query_id", "step_id", "root", "depth")


@query("a7_track_counts", """
SELECT event_id, count(*) AS n_points, arg_min(alert_level, (from_date, episode_id)) AS first_level FROM {cyclones} GROUP BY 1""")
def a7(v: Views):
    return reports.track_counts(v.cyclones)


@query("u2_hazard_union", """
WITH e AS (SELECT event_id % 400 AS k FROM {cyclones} WHERE is_current AND alert_level = 'Red'),
p AS (SELECT seq % 400 AS k FROM {features} WHERE layer_id = 'mpa'), t AS (SELECT event_id % 400 AS k FROM {cyclones} WHERE alert_level = 'Orange'),
r AS (SELECT c_custkey % 500 AS k FROM {customer} GROUP BY 1)
SELECT k, (SELECT count(*) FROM e WHERE e.k = r.k) AS events, (SELECT count(*) FROM p WHERE p.k = r.k) AS polygons, (SELECT count(*) FROM t WHERE t.k = r.k) AS tracks,
       CASE WHEN k % 50 = 7 THEN 'unknown' WHEN (SELECT count(*) FROM e WHERE e.k = r.k) + (SELECT count(*) FROM p WHERE p.k = r.k) + (SELECT count(*) FROM t WHERE t.k = r.k) = 0 THEN 'no_active_hazard' ELSE 'hazard' END AS state FROM r""")
def u2(v: Views):
    k = lambda c: (F.col(c) % 400).alias("k")
    events = v.cyclones.where("is_current AND alert_level = 'Red'").select(k("event_id"))
    tracks = v.cyclones.where("alert_level = 'Orange'").select(k("event_id"))
    polygons = v.features.where("layer_id = 'mpa'").select(k("seq"))
    regions = v.customer.select((F.col("c_custkey") % 500).alias("k")).distinct()
    return reports.hazard_summary(regions, "k", events, polygons, tracks, regions.where("k % 50 = 7"))


@query("u3_exclusion_union", """
SELECT 'hazard' AS kind, layer, count(*) AS n FROM {fences} WHERE layer = 'HAZARD_EXCLUSION' GROUP BY 2
UNION ALL SELECT 'legal', layer, count(*) FROM {fences} WHERE layer LIKE 'IMBL%' GROUP BY 2
UNION ALL SELECT 'protected', layer, count(*) FROM {fences} WHERE layer = 'MPA' GROUP BY 2""")
def u3(v: Views):
    pick = lambda kind, cond: v.fences.where(cond).select(F.lit(kind).alias("kind"), "layer", "fkey")
    union = pick("hazard", "layer = 'HAZARD_EXCLUSION'").unionByName(pick("legal", "layer LIKE 'IMBL%'")).unionByName(
        pick("protected", "layer = 'MPA'"))
    return union.groupBy("kind", "layer").agg(F.count(F.lit(1)).alias("n"))


@query("a8_counts_per_class", f"""
WITH c AS ({dims.rows_sql(dims.FENCE_CLASSES, dims.FENCE_COLUMNS)})
SELECT fence_class, class_order, count(f.fkey) AS n_features FROM c LEFT JOIN {{fences}} f ON f.layer = c.fence_class GROUP BY 1, 2""")
def a8(v: Views):
    return reports.counts_per_class(v.fences)


@query("a17_layer_catalogue", """
SELECT l.layer_id, count(f.seq) AS n_features, arg_max(f.source_id, (f.acquired_at, f.seq)) AS source_id, max(f.acquired_at) AS acquired_at
FROM (VALUES ('mpa'), ('eco_coral'), ('bathymetry'), ('pfz'), ('coastline')) l(layer_id) LEFT JOIN {features} f USING (layer_id) GROUP BY 1""")
def a17(v: Views):
    return reports.layer_catalogue(v.features, ["mpa", "eco_coral", "bathymetry", "pfz", "coastline"])


@query("a16_ingest_report", """
WITH r AS (SELECT CAST(DAY_OF(ts) AS TIMESTAMP) AS run, event_type AS src, count(*) > 60 AS ok, count(*) AS n FROM {events} GROUP BY 1, 2)
SELECT run, count(*) AS n_sources, count(*) FILTER (WHERE NOT ok) AS n_failed, CAST(sum(n) AS BIGINT) AS n_rows, bool_or(ok) AS run_ok FROM r GROUP BY 1""")
def a16(v: Views):
    runs = v.events.groupBy(F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("run"), "event_type").agg(F.count(F.lit(1)).alias("n_rows"))
    return reports.ingest_report(runs.withColumn("ok", F.col("n_rows") > 60))


@query("q1_observation_contract", """
SELECT obs_id, CASE WHEN obs_id % 17 = 0 THEN 'no provenance' WHEN obs_id % 19 = 0 AND value_num IS NOT NULL THEN 'two values' WHEN value_num IS NULL AND obs_id % 19 <> 0 THEN 'no value' END AS reason FROM {observations}""")
def q1(v: Views):
    rows = v.observations.withColumn("source_id", F.when(F.col("obs_id") % 17 != 0, F.col("source_id"))) \
        .withColumn("value_text", F.when(F.col("obs_id") % 19 == 0, F.lit("x")))
    return reports.observation_contract(rows).select("obs_id", "reason")


@query("q2_verdict_contract", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'illegal level' WHEN o_orderkey % 4 = 2 AND o_orderkey % 3 = 0 THEN 'no handoff' END AS reason FROM {orders}""")
def q2(v: Views):
    k = F.col("o_orderkey")
    level = F.when(k % 4 == 0, "GO").when(k % 4 == 1, "GO_WITH_CAUTION").when(k % 4 == 2, "DO_NOT_ADVISE").otherwise("MAYBE")
    rows = v.orders.select("o_orderkey", level.alias("level"), F.when(k % 3 != 0, "harbour office").alias("handoff"))
    return reports.verdict_contract(rows).select("o_orderkey", "reason")


@query("q5_extent_covers", """
WITH p AS (SELECT vessel_id AS product, lat - (vessel_id % 9) AS lat, lon + (vessel_id % 7) AS lon FROM {positions})
SELECT product, min(lat) <= 10.9 AND max(lat) >= 8 AND min(lon) <= 80.6 AND max(lon) >= 78 AS covers FROM p GROUP BY 1""")
def q5(v: Views):
    shifted = v.positions.select(F.col("vessel_id").alias("product"), (F.col("lat") - F.col("vessel_id") % 9).alias("lat"),
                                 (F.col("lon") + F.col("vessel_id") % 7).alias("lon"))
    return reports.extent_covers(shifted).select("product", "covers")


# ---- alerts per vessel and hour -------------------------------------------------------

ALERT_TICKS = f"""{TICKS_SQL}, {nearest_sql('ticked', 'vessel_id, tick_start')}, {LEVELS_SQL},
    ticks AS (SELECT vessel_id, layer, fkey, date_diff('hour', TIMESTAMP '1970-01-01', tick_start) AS tick, level_rank, distance_nm, severity_rank
              FROM levelled WHERE level_rank > 0)"""
KEYS = ["vessel_id", "layer", "fkey"]


def alert_ticks(v: Views):
    """What each vessel is warned of per hour; both tables are written, as they are read more than once."""
    from pelagia.session import cut_lineage

    hourly = cut_lineage(balanced(fence_ops.latest_per_tick(v.positions, 3600).select("vessel_id", "tick", "tick_start", "lat", "lon")))
    near = fence_ops.nearest_features(hourly, v.fence_segments)
    return cut_lineage(fence_ops.with_levels(near, v.fences).where("level_rank > 0").select(*KEYS, "tick", "tick_start", "level_rank", "distance_nm"))


TRANSITIONS = """
    cur AS (SELECT t.*, p.level_rank AS prev FROM ticks t LEFT JOIN ticks p ON p.vessel_id = t.vessel_id AND p.layer = t.layer AND p.fkey = t.fkey AND p.tick = t.tick - 1),
    acts AS (SELECT vessel_id, layer, fkey, tick, level_rank, CASE WHEN prev IS NULL OR {ack} OR level_rank > prev THEN 'emit' ELSE 'suppress' END AS action FROM cur
             UNION ALL SELECT vessel_id, layer, fkey, tick + 1, level_rank, 'clear' FROM ticks t WHERE NOT {ackc}
             AND NOT EXISTS (SELECT 1 FROM ticks n WHERE n.vessel_id = t.vessel_id AND n.layer = t.layer AND n.fkey = t.fkey AND n.tick = t.tick + 1))"""


@query("x2_alert_transitions", f"""
WITH {ALERT_TICKS}, {TRANSITIONS.format(ack='false', ackc='false')} SELECT * FROM acts""")
def x2(v: Views):
    """Batch twin of the streaming alert state."""
    return reports.alert_transitions(alert_ticks(v), KEYS)


@query("x2_alert_acknowledged", f"""
WITH {ALERT_TICKS}, {TRANSITIONS.format(ack='(tick - 1) % 4 = 0', ackc='(t.tick % 4 = 0)')} SELECT * FROM acts""")
def x2ack(v: Views):
    ticks = alert_ticks(v)
    return reports.alert_transitions(ticks, KEYS, ticks.where("tick % 4 = 0").select(*KEYS, "tick"))


@query("u4_active_difference", f"""
WITH {ALERT_TICKS} SELECT vessel_id, layer, fkey, tick + 1 AS tick FROM ticks t
WHERE EXISTS (SELECT 1 FROM ticks a WHERE a.tick = t.tick + 1)
  AND NOT EXISTS (SELECT 1 FROM ticks n WHERE n.vessel_id = t.vessel_id AND n.layer = t.layer AND n.fkey = t.fkey AND n.tick = t.tick + 1)""")
def u4(v: Views):
    return reports.active_difference(alert_ticks(v).select(*KEYS, "tick"), KEYS)


_ALERTS = """(SELECT event_id AS alert_id, user_id AS vessel_id, CAST(event_id % 4 AS INT) AS level_rank, ts AS created_at, event_id % 3 = 0 AS acked, event_id % 5 <> 0 AS active,
              CASE WHEN event_id % 11 <> 0 THEN (event_id % 500) / 100 END AS distance_nm FROM {events})"""


@query("t4_alert_queue", f"""
WITH a AS {_ALERTS}
(SELECT 'store' AS queue, alert_id, round(distance_nm, 6) AS distance_nm FROM a WHERE true)
UNION ALL (SELECT 'console', alert_id, round(distance_nm, 6) FROM a)""")
def t4(v: Views):
    alerts = v.sql(_ALERTS.strip()[1:-1])
    first = lambda name, order: alerts.orderBy(*order).select(F.lit(name).alias("queue"), "alert_id", "distance_nm")
    return first("store", reports.alert_queue_store()).unionByName(first("console", reports.alert_queue_console()))


@query("t6_alert_history", f"WITH a AS {_ALERTS} SELECT alert_id, vessel_id, created_at FROM a ORDER BY created_at DESC, alert_id DESC LIMIT 500")
def t6(v: Views):
    """The 500 newest alerts; the store keeps no more."""
    return v.sql(_ALERTS.strip()[1:-1]).orderBy(F.col("created_at").desc(), F.col("alert_id").desc()) \
        .limit(500).select("alert_id", "vessel_id", "created_at")


@query("p11_alert_filter", f"WITH a AS {_ALERTS} SELECT alert_id FROM a WHERE vessel_id = 8 AND created_at >= TIMESTAMP '2024-01-10' AND active")
def p11(v: Views):
    from pelagia.operators.filters import alerts_for
    return alerts_for(v.sql(_ALERTS.strip()[1:-1]), 8, datetime(2024, 1, 10), True).select("alert_id")


@query("x4_latest_position", "SELECT vessel_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM {positions} GROUP BY 1")
def x4(v: Views):
    return v.positions.groupBy("vessel_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("x7_tick_windows", """
SELECT vessel_id, date_trunc('minute', ts) AS tick_start, arg_max(event_id, (ts, event_id)) AS event_id FROM {positions} GROUP BY 1, 2""")
def x7(v: Views):
    return fence_ops.latest_per_tick(v.positions, 60).select("vessel_id", "tick_start", "event_id")
