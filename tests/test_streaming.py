"""The stateful stream over several micro-batches equals its batch twin."""

import datetime
import uuid

from pyspark.sql import functions as F

from pelagia.operators import reports
from pelagia.session import shared_folder
from pelagia.streaming import alerts


HOUR = "timestamp_ntz'1970-01-01 00:00:00'"


def landed(spark, rows, base, clock, acks=()):
    """Land sightings (vessel, tick, rank) and acknowledgements (vessel, tick), then run the alert job over what is new."""
    if rows:
        df = spark.createDataFrame(rows, "vessel_id BIGINT, tick BIGINT, level_rank INT").select(
            "vessel_id", "tick", alerts.tick_time("tick", 3600).alias("tick_start"), F.lit("MPA").alias("layer"), F.lit(1).alias("fkey"), "level_rank",
            F.lit(0.1).alias("distance_nm"), F.lit(0).cast("bigint").alias("event_id"), F.lit(None).cast("boolean").alias("hazards_checked"))
        clock.stamp(df, "tick_start").coalesce(1).write.mode("append").parquet(f"{base}/in")
    if acks:
        alerts.land_acknowledgements(spark.createDataFrame([(k, "MPA", 1, t) for k, t in acks], "vessel_id BIGINT, layer STRING, fkey INT, tick BIGINT").coalesce(1), f"{base}/acks", clock, 3600)


def run_alerts(spark, base):
    stream = spark.readStream.schema(alerts.PROXIMITY_SCHEMA).parquet(f"{base}/in")
    acks = spark.readStream.schema(alerts.ACK_SCHEMA).parquet(f"{base}/acks")
    job = alerts.alert_actions(stream, acknowledgements=acks).writeStream.format("parquet").option("path", f"{base}/out") \
        .option("checkpointLocation", f"{base}/offsets").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return sorted((r.vessel_id, r.tick, r.action, r.level_rank) for r in spark.read.parquet(f"{base}/out").collect())


def test_stream_equals_batch(spark):
    base = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    rows = [(k, t, 1 + (k * 3 + t * t) % 3) for k in range(6) for t in range(100, 112) if (k + t) % 5]
    acks = [(k, t) for k in range(6) for t in range(100, 112) if (k + 2 * t) % 7 == 0]
    clock = alerts.Clock()
    for low, high in ((100, 104), (104, 108), (108, 112)):
        inside = lambda r: low <= r[1] < high  # noqa: B023, E731
        landed(spark, list(filter(inside, rows)), base, clock, list(filter(inside, acks)))
        run_alerts(spark, base)
    alerts.land_time(spark, f"{base}/acks", clock, datetime.datetime(1970, 1, 6))  # hour 120
    got = run_alerts(spark, base)
    keyed = lambda r, schema: spark.createDataFrame(r, schema).withColumns({"layer": F.lit("MPA"), "fkey": F.lit(1)})
    twin = reports.alert_transitions(keyed(rows, "vessel_id BIGINT, tick BIGINT, level_rank INT"), alerts.KEY, keyed(acks, "vessel_id BIGINT, tick BIGINT"))
    assert got == sorted((r.vessel_id, r.tick, r.action, r.level_rank) for r in twin.collect())
    assert alerts.Clock(spark, f"{base}/in", f"{base}/acks").now == clock.now


def test_late_rows_and_early_acknowledgements_leave_or_wait(spark):
    base = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    clock = alerts.Clock()
    landed(spark, [(1, 100, 1), (1, 101, 1), (2, 100, 2), (3, 100, 1)], base, clock, [(3, 101)])  # the last before its sighting
    run_alerts(spark, base)
    landed(spark, [(1, 100, 3), (2, 101, 2), (3, 101, 1)], base, clock, [(1, 100), (2, 100)])  # a late row, a late and a timely acknowledgement
    run_alerts(spark, base)
    landed(spark, [(3, 102, 1), (9, 110, 1)], base, clock)
    run_alerts(spark, base)
    landed(spark, [(2, 101, 3), (2, 109, 1)], base, clock)  # late after its alert was cleared by time
    got = run_alerts(spark, base)
    assert [x for x in got if x[0] == 1] == [(1, 100, "emit", 1), (1, 100, "late", 3), (1, 100, "late_ack", None), (1, 101, "suppress", 1), (1, 102, "clear", 1)]
    assert [x for x in got if x[0] == 2] == [(2, 100, "emit", 2), (2, 101, "emit", 2), (2, 101, "late", 3), (2, 102, "clear", 2), (2, 109, "emit", 1)]
    assert [x for x in got if x[0] == 3] == [(3, 100, "emit", 1), (3, 101, "suppress", 1), (3, 102, "emit", 1), (3, 103, "clear", 1)]


def test_hazard_loader_failure_keeps_static_fences(spark):
    from pelagia.workload.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    base = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    events = spark.readStream.schema(v.events.schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    positions = events.select("event_id", F.col("user_id").alias("vessel_id"), "ts", F.lit(8.25).alias("lat"), F.lit(78.3).alias("lon"))

    def broken():
        raise OSError("hazard feed down")

    alerts.proximity_batches(positions, v.fence_segments, v.fences, 86400, f"{base}/p", broken) \
        .option("checkpointLocation", f"{base}/o").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{base}/p").count() > 0


def test_every_hazard_zone_is_checked_and_a_failure_is_shown(spark):
    from pelagia.workload.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    events = spark.readStream.schema(v.events.schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    positions = events.select("event_id", F.col("user_id").alias("vessel_id"), "ts", F.lit(8.25).alias("lat"), F.lit(78.3).alias("lon"))
    # Two zones over the point, one far off.
    ring = [(0, 0, 2, 0), (2, 0, 2, 2), (2, 2, 0, 2), (0, 2, 0, 0)]
    at = {901: (78.25, 8.2), 902: (78.26, 8.21), 903: (70.0, 8.2)}
    lines = [("HAZARD_EXCLUSION", k, 0, 0, i, x + a / 10, y + b / 10, x + c / 10, y + d / 10, True) for k, (x, y) in at.items() for i, (a, b, c, d) in enumerate(ring)]
    segments = spark.createDataFrame(lines, "layer string, fkey int, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double, is_polygon boolean")
    zones = spark.createDataFrame([(k, "HAZARD_EXCLUSION", f"zone {k}", None, None) for k in at], "fkey int, layer string, name string, own_warn_nm double, own_critical_nm double")

    def broken():
        raise OSError("hazard feed down")

    def run(loader):
        base = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
        alerts.proximity_batches(positions, v.fence_segments, v.fences, 86400, f"{base}/p", loader) \
            .option("checkpointLocation", f"{base}/o").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(alerts.PROXIMITY_SCHEMA).parquet(f"{base}/p").collect()

    plain, seen, failed = run(None), run(lambda: (segments, zones)), run(broken)
    key = lambda r: (r.vessel_id, r.tick, r.layer, r.fkey, r.level_rank)
    ticks = {(r.vessel_id, r.tick) for r in plain}
    assert {key(r)[:4] for r in seen if r.fkey > 900} == {(*t, "HAZARD_EXCLUSION", k) for t in ticks for k in (901, 902)}
    assert sorted(key(r) for r in seen if r.fkey < 900) == sorted(map(key, failed)) == sorted(map(key, plain))
    assert {r.hazards_checked for r in plain} == {None} and {r.hazards_checked for r in seen} == {True} and {r.hazards_checked for r in failed} == {False}
