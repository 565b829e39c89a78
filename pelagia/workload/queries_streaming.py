"""Streaming jobs run to completion over the event table, and the catalogue."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from pelagia import catalog
from pelagia.operators.fences import HAZARD
from pelagia.session import shared_folder
from pelagia.streaming import alerts
from pelagia.workload.queries_fences import brg, hav
from pelagia.workload.queries_reports import _ALERTS, ALERT_TICKS, TRANSITIONS
from pelagia.workload.queries_scalars import DOUGLAS_SQL, FRESHNESS_SQL, NOW, SPAN_SQL
from pelagia.workload.registry import query, r6
from pelagia.workload.views import _SPARK_MACROS, AS_OF, VIEWS, Views, _expand


def run_proximities(v: Views, events, base: str, clock: alerts.Clock, **more) -> None:
    """Stream what is new of landed events through the fence check."""
    positions = v.spark.sql(_expand(VIEWS["positions"], _SPARK_MACROS), events=events)
    writer = alerts.proximity_batches(positions, more.pop("segments", v.fence_segments), v.fences, 3600, f"{base}/proximities", clock=clock, **more)
    writer.option("checkpointLocation", f"{base}/offsets-1").trigger(availableNow=True).start().awaitTermination()


#: Every hazard zone is checked, of the other classes the nearest fence.
EACH_ZONE = ALERT_TICKS.replace("PARTITION BY vessel_id, tick_start, layer ", f"PARTITION BY vessel_id, tick_start, layer, CASE WHEN layer = '{HAZARD}' THEN fkey END ")
assert EACH_ZONE != ALERT_TICKS


@query("x1_stream_proximities", f"""
WITH {EACH_ZONE} SELECT vessel_id, tick, layer, fkey, level_rank, round(distance_nm, 6) AS distance_nm, CAST(true AS BOOLEAN) AS hazards_checked FROM ticks""")
def x1(v: Views):
    """The event file through the fence check; hazard zones come from a loader and are each checked."""
    base = f"{shared_folder(v.spark)}/stream-{uuid.uuid4().hex}"
    events = v.spark.readStream.schema(v.events.schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    zone = F.col("layer") == HAZARD
    run_proximities(v, events, base, alerts.Clock(), segments=v.fence_segments.where(~zone), hazards=lambda: (v.fence_segments.where(zone), v.fences.where(zone)))
    return v.spark.read.schema(alerts.PROXIMITY_SCHEMA).parquet(f"{base}/proximities").select(
        "vessel_id", "tick", "layer", "fkey", "level_rank", "distance_nm", "hazards_checked")


@query("x2_stream_alerts", f"""
WITH {ALERT_TICKS}, {TRANSITIONS.format(ack='(tick - 1) % 4 = 0', ackc='(t.tick % 4 = 0)')} SELECT * FROM acts""")
def x2(v: Views):
    """The stateful stream over three landings of the events with the acknowledgements of each, and the end of time after them."""
    base = f"{shared_folder(v.spark)}/stream-{uuid.uuid4().hex}"
    clock = alerts.Clock()
    first, last = v.events.agg(F.min(F.date_trunc("HOUR", "ts")), F.max("ts")).first()
    cuts = [first + k * ((last - first) // 3) for k in range(3)] + [None]
    cuts = [c and c.replace(minute=0, second=0, microsecond=0) for c in cuts]
    for low, high in zip(cuts, cuts[1:]):
        inside = F.col("ts") >= F.lit(low)
        v.events.where(inside if high is None else inside & (F.col("ts") < F.lit(high))).write.mode("append").parquet(f"{base}/events")
        run_proximities(v, v.spark.readStream.schema(v.events.schema).parquet(f"{base}/events"), base, clock)
        new = v.spark.read.schema(alerts.PROXIMITY_SCHEMA).parquet(f"{base}/proximities").where(F.col("tick_start") >= F.lit(low))
        alerts.land_acknowledgements(new.where("tick % 4 = 0"), f"{base}/acknowledgements", clock, 3600)
        run_alerts(v, base)
    alerts.land_time(v.spark, f"{base}/acknowledgements", clock, last + datetime.timedelta(days=1))
    return run_alerts(v, base)


def run_alerts(v: Views, base: str):
    """Stream what is new of the landed proximities and acknowledgements through the alert state; the log so far."""
    seen = v.spark.readStream.schema(alerts.PROXIMITY_SCHEMA).parquet(f"{base}/proximities")
    acks = v.spark.readStream.schema(alerts.ACK_SCHEMA).parquet(f"{base}/acknowledgements")
    job = alerts.alert_actions(seen, acknowledgements=acks).writeStream.format("parquet").option("path", f"{base}/alerts") \
        .option("checkpointLocation", f"{base}/offsets-2").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return v.spark.read.schema(alerts.ACTION_SCHEMA).parquet(f"{base}/alerts")


@query("x3_replace_all_fences", """
WITH f AS (SELECT p_partkey AS fkey, 'hazard_' || CAST(p_size % 3 AS VARCHAR) AS layer, p_partkey % 17 + p_size % 3 AS version FROM {part})
SELECT fkey, layer, version FROM f WHERE version = (SELECT max(version) FROM f g WHERE g.layer = f.layer)""")
def x3(v: Views):
    rows = v.part.select(F.col("p_partkey").alias("fkey"), F.concat(F.lit("hazard_"), (F.col("p_size") % 3).cast("string")).alias("layer"),
                         (F.col("p_partkey") % 17 + F.col("p_size") % 3).alias("version"))
    return alerts.latest_version(rows).select("fkey", "layer", "version")


@query("x5_alert_upsert", f"""
WITH a AS (SELECT alert_id % 700 AS alert_id, level_rank, created_at FROM {_ALERTS} q) SELECT alert_id, arg_max(level_rank, (created_at, level_rank)) AS level_rank, max(created_at) AS created_at FROM a GROUP BY 1""")
def x5(v: Views):
    log = v.sql(_ALERTS.strip()[1:-1]).select((F.col("alert_id") % 700).alias("alert_id"), "level_rank", "created_at")
    return alerts.current_alerts(log, order=("created_at", "level_rank"))


@query("x6_late_and_stale", f"""
WITH s AS (SELECT *, {SPAN_SQL} AS span FROM {{observations}})
SELECT obs_id, date_diff('microsecond', valid_time, TIMESTAMP '{AS_OF}') // 1000000 > 43200 AS late, {FRESHNESS_SQL.format(now=f"TIMESTAMP '{AS_OF}'")} AS freshness FROM s WHERE valid_time <= TIMESTAMP '{AS_OF}'""")
def x6(v: Views):
    seen = v.observations.where(F.col("valid_time") <= F.expr(NOW))
    on_time, late = alerts.split_late(seen, "valid_time", F.expr(NOW), 43200)
    both = on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return alerts.graded(both, F.expr(NOW)).select("obs_id", "late", "freshness")


@query("d1_operator_call", "SELECT event_id, episode_id FROM {cyclones} WHERE is_current AND coalesce(lat BETWEEN 3 AND 15.9 AND lon BETWEEN 73 AND 85.6, false)")
def d1(v: Views):
    """An operator called by name; the unknown argument is dropped and reported."""
    result, dropped, error = catalog.call("filters.current_events", v.cyclones, colour="red")
    assert dropped == ["colour"] and error is None
    return result.select("event_id", "episode_id")


@query("d3_sql_functions", f"""
SELECT event_id, round({hav('lat', 'lon', '9.2876', '79.3129')}, 6) AS nm, round({brg('lat', 'lon', '9.2876', '79.3129')}, 6) AS deg,
       CAST({DOUGLAS_SQL.format(h='speed_kn')} AS INT) AS band FROM {{positions}}""")
def d3(v: Views):
    catalog.register_sql_functions(v.spark)
    return v.sql("SELECT event_id, haversine_nm(lat, lon, 9.2876D, 79.3129D) AS nm, bearing_deg(lat, lon, 9.2876D, 79.3129D) AS deg, "
                 "douglas_band(speed_kn) AS band FROM {positions}")
