"""Repeated points, ties, requests without rows, tick lengths."""

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from pelagia.functions import marine
from pelagia.operators import fences, filters, observe, reports
from pelagia.plans.spatial import nearest_features, polygons_containing
from pelagia.session import shared_folder
from pelagia.sources import ingest
from pelagia.streaming import alerts

SEGMENTS = "layer string, fkey int, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double, is_polygon boolean"


def square(layer, key, x, y, side):
    corners = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    return [(layer, key, 0, 0, i, *a, *b, True) for i, (a, b) in enumerate(zip(corners, corners[1:]))]


@pytest.mark.parametrize("limit", [0, 200_000])
def test_repeated_points_each_get_their_rows(spark, limit):
    r = random.Random(1)
    shapes = [square("a", k, 78 + r.random(), 8 + r.random(), 0.4) for k in range(6)] + [square("b", 9, 78.2, 8.2, 0.5)]
    segments = spark.createDataFrame([s for shape in shapes for s in shape], SEGMENTS)
    points = [(78 + 1.3 * r.random(), 8 + 1.3 * r.random()) for _ in range(40)]
    points += points[:15] + points[:15]
    frame = spark.createDataFrame(points, "lon double, lat double")
    inside = lambda p, s: s[0][5] <= p[0] < s[1][5] and s[0][6] <= p[1] < s[2][6]
    want = sorted((round(p[0], 9), s[0][0], s[0][1]) for p in points for s in shapes if inside(p, s))
    got = polygons_containing(frame, segments, broadcast_rows=limit).collect()
    assert sorted((round(x.lon, 9), x.layer, x.fkey) for x in got) == want
    near = nearest_features(frame, segments, broadcast_rows=limit).collect()
    assert len(near) == 2 * len(points)
    for x in near:
        hit = [s[0][1] for s in shapes if s[0][0] == x.layer and inside((x.lon, x.lat), s)]
        assert x.inside == bool(hit) and (not hit or x.fkey == min(hit))
    for k in (2, 3):
        assert nearest_features(frame, segments, k=k, broadcast_rows=limit).groupBy("layer").count().where("layer = 'a'").first()["count"] == k * len(points)


def test_fixed_rounds_the_exact_double(spark):
    r = random.Random(2)
    values = [0.125, 0.375, 2.675, 1.005, 1.25, 2.25, 0.25, 0.05, 4.35, -0.125, -2.5, 0.0, 1e6 + 0.125, 123456.785] + [r.randrange(10 ** 6) / 1000 for _ in range(500)] + [
        r.randrange(4000) / 8 for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", marine.fixed("v", 1).alias("a"), marine.fixed("v", 2).alias("b")).collect()
    assert [(x.a, x.b) for x in rows] == [(f"{x.v:.1f}", f"{x.v:.2f}") for x in rows]
    assert spark.createDataFrame([(None,)], "v double").select(marine.fixed("v", 2).alias("a")).first().a is None


def test_eta_and_provenance(spark):
    row = spark.sql("SELECT 4500D s, 8100D t, 's' i, timestamp_ntz'2026-09-01 10:00:00.25' a, timestamp_ntz'2026-09-01 10:00:00' b")
    got = row.select(marine.eta_in_words("s"), marine.eta_in_words("t"), marine.provenance_id("i", F.lit(None).cast("timestamp_ntz"), "a"), marine.provenance_id("i", "b", "a")).first()
    assert tuple(got) == ("1.2 h", "2.2 h", "s@2026-09-01T10:00:00.250000+00:00", "s@2026-09-01T10:00:00+00:00")


def test_message_without_name_or_own_copy(spark):
    rows = spark.createDataFrame([("MPA", "INFO", "", 1.25), ("MPA", "WARN", None, None)], "c string, l string, n string, d double")
    got = [x.m for x in reports.with_copy(rows, "c", "l").select(marine.fill_message("copy", "n", "d", F.lit("soon"), "title").alias("m")).collect()]
    assert sorted(m.split(" ahead")[0] for m in got) == ["Marine National Park boundary is 1.2 nm", "Marine National Park boundary is ? nm"]


def test_coverage_of_requests_with_nothing_to_check(spark):
    present = spark.createDataFrame([("a", "MPA"), ("b", None), ("c", "USER_DEFINED")], "scan string, layer string")
    got = {x.scan: (x.status, x.hard_gap) for x in fences.class_coverage(present, "scan", spark.createDataFrame([("d",)], "scan string")).collect()}
    assert got == {"a": ("partial", True), "b": ("abstain", True), "c": ("abstain", True), "d": ("abstain", True)}


def test_no_limit_unless_asked(spark):
    days = spark.sql("SELECT 1 k, timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, id) AS day FROM range(1000)".replace("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, id)", "timestampadd(DAY, id, timestamp_ntz'2020-01-01 00:00:00')"))
    assert observe.strided(days, ["k"], "day").count() == 1000
    assert observe.strided(days, ["k"], "day", stride_days=8).count() == math.ceil(1000 / 8)
    span = filters.cap_span(F.expr("timestamp_ntz'2000-01-01 00:00:00'"), F.expr("timestamp_ntz'2026-01-01 00:00:00'"))
    assert str(spark.range(1).select(span["win_end"].alias("e")).first().e) == "2026-01-01 00:00:00"


@pytest.mark.parametrize("tick_s", [60, 3600])
def test_stream_clears_by_the_timer(spark, tick_s):
    """Three micro-batches at the given tick: the stream equals its batch twin, clears included, up to the watermark."""
    base = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    rows = [(k, t, 1 + (k * 3 + t * t) % 3) for k in range(6) for t in range(100, 112) if (k + t) % 5 and not (k == 2 and t > 104)] + [(9, 140, 1)]
    frame = spark.createDataFrame(rows, "vessel_id BIGINT, tick BIGINT, level_rank INT").select(
        "vessel_id", "tick", F.timestamp_add("SECOND", F.col("tick") * tick_s, F.expr("timestamp_ntz'1970-01-01 00:00:00'")).alias("tick_start"),
        F.lit("MPA").alias("layer"), F.lit(1).alias("fkey"), "level_rank", F.lit(0.1).alias("distance_nm"), F.lit(0).cast("bigint").alias("event_id"))
    for low, high in ((100, 104), (104, 112), (112, 200)):
        frame.where((F.col("tick") >= low) & (F.col("tick") < high)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(alerts.PROXIMITY_SCHEMA).parquet(f"{base}/in")
        alerts.alert_actions(stream, f"{2 * tick_s} seconds", tick_s).writeStream.format("parquet").option("path", f"{base}/out").option(
            "checkpointLocation", f"{base}/offsets").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(x.vessel_id, x.tick, x.level_rank, x.action) for x in spark.read.parquet(f"{base}/out").collect()}
    twin = reports.alert_transitions(frame.select("vessel_id", "layer", "fkey", "tick", "level_rank"), alerts.KEY)
    want = {(x.vessel_id, x.tick, x.level_rank, x.action) for x in twin.collect()}
    assert got == {x for x in want if x[0] != 9 or x[3] != "clear"}  # the newest sighting is not past the watermark yet


FEATURE = '{"type":"Feature","feature_key":"k%d","source_id":"src","acquired_at":"2026-09-01T10:00:00.25+05:30","geometry":%s,"properties":%s}'


def test_collections_and_single_features(spark):
    point = FEATURE % (1, '{"type":"MultiPoint","coordinates":[[78,9],[79,8]]}', '{"a":"1"}')
    line = FEATURE % (2, '{"type":"LineString","coordinates":[[78,9],[79,8],[80,8]]}', "{}")
    rows = spark.createDataFrame([(1, '{"type":"FeatureCollection","features":[%s,%s]}' % (point, line)), (2, line), (3, "broken"), (4, '{"features":[]}')], "n int, value string")
    features, segments = ingest.ingest_geojson(rows)
    assert sorted((f.n, f.feature_key, f.source_id, str(f.acquired_at)) for f in features.collect()) == [
        (1, "k1", "src", "2026-09-01 04:30:00.250000"), (1, "k2", "src", "2026-09-01 04:30:00.250000"), (2, "k2", "src", "2026-09-01 04:30:00.250000")]
    assert sorted((x.n, x.feature_key, x.part, x.seq, x.x1) for x in segments.collect()) == [
        (1, "k1", 0, 0, 78.0), (1, "k1", 1, 0, 79.0), (1, "k2", 0, 0, 78.0), (1, "k2", 0, 1, 79.0), (2, "k2", 0, 0, 78.0), (2, "k2", 0, 1, 79.0)]
    assert sorted(x.n for x in ingest.rejected_rows(rows, features, ["n"]).collect()) == [3, 4]


def test_cyclones_from_a_collection(spark):
    one = lambda k, more="": FEATURE % (k, '{"type":"Point","coordinates":[80.5,9.5]}', '{"eventid":%d,"episodeid":1,"iscurrent":"true","fromdate":"2026-09-01T10:00:00"%s}' % (k, more))
    rows = spark.createDataFrame([('{"features":[%s,%s,%s]}' % (one(1), one(2, ',"name":"Storm"'), FEATURE % (3, "null", "{}")),), (one(4),), ("x",)], "value string")
    got = sorted((e.event_id, e.name, e.lat, e.alert_level, e.is_current, str(e.from_date)) for e in ingest.parse_cyclones(rows).collect())
    assert got == [("1", "TC-1", 9.5, "Green", True, "2026-09-01 10:00:00"), ("2", "Storm", 9.5, "Green", True, "2026-09-01 10:00:00"), ("4", "TC-4", 9.5, "Green", True, "2026-09-01 10:00:00")]


def test_csv_columns_by_name(spark):
    lines = ["time,latitude,longitude,chl", "UTC,degrees_north,degrees_east,mg m-3", "2026-09-01T00:00:00Z,9.5,79.5,0.4", "2026-09-02T00:00:00Z,9.5,79.5,NaN"]
    rows = spark.createDataFrame([("f", x) for x in lines] + [("no names", lines[2])], "file string, value string")
    got = ingest.ingest_griddap_csv(rows, {"chl": None, "sst": None})
    assert [(x.file, x.variable, x.value_num, x.unit, x.lat, x.depth) for x in got.collect()] == [("f", "chl", 0.4, "mg m-3", 9.5, None)]
    assert ingest.rejected_rows(rows.select("file").distinct(), got, ["file"]).first().file == "no names"


def test_trace_times(spark):
    lines = ['{"step_id":"%s","query_id":"q","ts":"%s","provenance_ids":["p"],"args":{"a":1},"why":"w"}' % (i, t) for i, t in enumerate(
        ["2026-09-01T10:00:00.123456+00:00", "2026-09-01T10:00:00", "2026-09-01T10:00:00+05:30", "nonsense"])]
    got = {x.step_id: str(x.ts) for x in ingest.read_traces(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {"0": "2026-09-01 10:00:00.123456", "1": "2026-09-01 10:00:00", "2": "2026-09-01 04:30:00", "3": "None"}
