"""Verdict, fence, alert, text and route semantics on small fixtures."""

import heapq
import math

import pytest
from pyspark.sql import functions as F

from pelagia import catalog, dims
from pelagia.functions import geo, marine
from pelagia.operators import fences, grid, reports, routing, text, verdict
from tests.test_spatial import SEG, haversine

NTZ = "timestamp_ntz'{}'"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("height,band", [(0.0, 1), (0.1, 2), (0.5, 3), (1.2499, 3), (1.25, 4), (2.5, 5), (4.0, 6), (6.0, 7), (9.0, 8), (14.0, 9), (120.0, 9), (-0.1, None), (None, None)])
def test_douglas_bounds(spark, height, band):
    assert one(spark, marine.douglas_band(F.lit(height).cast("double"))) == band


@pytest.mark.parametrize("words,bands", [
    ("MODERATE TO ROUGH", [4, 5]), ("Very  rough", [6]), ("CALM (GLASSY) BECOMING SMOOTH", [0, 2]), ("ROUGHLY HIGHER", []), ("VERY HIGH OR HIGH", [8, 7]), ("", [])])
def test_sea_phrases(spark, words, bands):
    assert one(spark, verdict.sea_bands(F.lit(words))) == bands


@pytest.mark.parametrize("signal,hoisted", [(None, False), ("", True), ("NIL", False), ("Nil signal no. III", True), ("no signal", False), ("LC III", True)])
def test_port_signal(spark, signal, hoisted):
    assert one(spark, verdict.port_signal_hoisted(F.lit(signal).cast("string"))) is hoisted


@pytest.mark.parametrize("warning,district,hit", [
    ("High waves for KANNIYAKUMARI", "Kanniyakumari", True), ("THOOTHUKKUDI coast", "Thoothukudi", True), ("Nagai only", "Nagapattinam", False), (None, "X", False)])
def test_district_match(spark, warning, district, hit):
    assert one(spark, verdict.names_district(F.lit(warning).cast("string"), F.lit(district))) is hit


def bulletin(spark, **over):
    row = {"bulletin_id": 1, "sea_condition": "'SMOOTH'", "port_signal": "'NIL'", "storm_surge_warning": "NULL", "valid_from": NTZ.format("2024-01-01 00:00:00"),
           "valid_to": NTZ.format("2024-01-01 12:00:00"), "target_time": NTZ.format("2024-01-01 06:00:00"), "as_of": NTZ.format("2024-01-01 03:00:00"),
           "vessel_class": "'small_motorised'", "district": "'Thanjavur'", "swell_period_s": "10D"} | over
    return spark.sql("SELECT " + ", ".join(f"{v} AS {k}" for k, v in row.items()))


@pytest.mark.parametrize("over,rank,rule", [
    ({}, 0, "douglas_band_cap"), ({"sea_condition": "'MODERATE'"}, 1, "douglas_band_cap"), ({"sea_condition": "'ROUGH'"}, 2, "douglas_band_cap"),
    ({"sea_condition": "'ROUGH'", "vessel_class": "'mechanised_trawler'"}, 1, "douglas_band_cap"), ({"sea_condition": "'FINE'"}, 2, "missing_required_input"),
    ({"valid_to": "CAST(NULL AS TIMESTAMP_NTZ)"}, 2, "missing_required_input"), ({"as_of": NTZ.format("2024-01-01 13:00:00")}, 2, "bulletin_expired"),
    ({"target_time": NTZ.format("2024-01-02 00:00:00")}, 2, "bulletin_does_not_cover_departure"), ({"port_signal": "''"}, 1, "port_signal_hoisted"),
    ({"storm_surge_warning": "'THANJAVUR coast'"}, 1, "storm_surge_names_district"),
    ({"storm_surge_warning": "'THANJAVUR coast'", "swell_period_s": "15D"}, 2, "long_period_swell")])
def test_ceiling_rules(spark, over, rank, rule):
    got = verdict.compute_ceiling(bulletin(spark, **over)).first()
    assert got.ceiling_rank == rank and rule in got.rules.split(",")


def test_ceiling_never_loosens_and_handoff_is_named(spark):
    rows = verdict.compute_ceiling(bulletin(spark, sea_condition="'MODERATE'"))
    levels = spark.createDataFrame([(r,) for r in range(3)], "level_rank INT").withColumn("bulletin_id", F.lit(1)).withColumn("handoff", F.lit(None).cast("string"))
    got = {r.own: r for r in verdict.apply_ceiling(levels.withColumn("own", F.col("level_rank")).join(rows, "bulletin_id")).collect()}
    assert [got[k].level_rank for k in range(3)] == [1, 1, 2]
    assert got[0].ceiling_applied and got[0].downgraded_from == "GO" and not got[1].ceiling_applied
    assert got[2].handoff == dims.COAST_GUARD[0] and got[0].handoff is None


def test_missing_reading_does_not_lower_a_verdict(spark):
    rows = spark.sql("SELECT 1 AS id, 'small_motorised' AS vessel_class, CAST(NULL AS DOUBLE) hs, 30D wind, CAST(NULL AS DOUBLE) gust, CAST(NULL AS DOUBLE) period, CAST(NULL AS DOUBLE) visibility")
    got = verdict.baseline(verdict.threshold_checks(rows, ["id"]), ["id"]).first()
    assert got.level_rank == 2 and got.reasons == "wind_speed"


def eta(spark, lat, lon, heading, speed, chunk=64):
    line = [("IMBL", 1, 0, 0, k, 79.0 + k / 10, 9.0, 79.1 + k / 10, 9.0, False) for k in range(10)]
    segs = spark.createDataFrame(line, SEG)
    prox = spark.createDataFrame([(1, lat, lon, heading, speed, "IMBL", 1, haversine(lat, lon, 9.0, min(max(lon, 79.0), 80.0)))],
                                 "event_id INT, lat DOUBLE, lon DOUBLE, heading_deg DOUBLE, speed_kn DOUBLE, layer STRING, fkey INT, distance_nm DOUBLE")
    return fences.closing_eta(prox, segs, ["event_id"], chunk).first().eta_s


def test_closing_time(spark):
    straight = eta(spark, 8.95, 79.5, 0.0, 6.0)
    assert straight == pytest.approx(3.0 / 6 * 3600, rel=0.06)
    assert eta(spark, 8.95, 79.5, 0.0, 6.0, chunk=3) == pytest.approx(straight)
    assert eta(spark, 8.95, 79.5, 180.0, 6.0) is None
    assert eta(spark, 8.95, 79.5, 90.0, 6.0) is None
    assert eta(spark, 8.95, 79.5, 0.0, 0.4) is None
    assert eta(spark, 7.0, 79.5, 0.0, 6.0) is None


def test_alert_sequence(spark):
    ranks = {0: 1, 1: 2, 2: 1, 3: 2, 5: 2}
    ticks = spark.createDataFrame([(7, "L", 1, t, r) for t, r in ranks.items()], "vessel_id INT, layer STRING, fkey INT, tick INT, level_rank INT")
    got = sorted((r.tick, r.action) for r in reports.alert_transitions(ticks, ["vessel_id", "layer", "fkey"]).collect())
    assert got == [(0, "emit"), (1, "emit"), (2, "suppress"), (3, "emit"), (4, "clear"), (5, "emit"), (6, "clear")]
    acks = ticks.where("tick = 1").select("vessel_id", "layer", "fkey", "tick")
    acked = {r.tick: r.action for r in reports.alert_transitions(ticks, ["vessel_id", "layer", "fkey"], acks).collect()}
    assert acked[2] == "emit"


def test_trace_tree_with_unknown_parent_and_cycle(spark):
    rows = [("q", "a", None), ("q", "b", "a"), ("q", "c", "b"), ("q", "d", "zz"), ("q", "e", "e"), ("q", "x", "z"), ("q", "y", "x"), ("q", "z", "y"), ("q", "w", "y")]
    got = {r.step_id: (r.root, r.depth) for r in reports.trace_tree(spark.createDataFrame(rows, "query_id STRING, step_id STRING, parent_id STRING")).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("d", 0), "e": ("e", 0), "x": ("x", 0), "y": ("x", 1), "z": ("x", 2), "w": ("x", 2)} \
        or (got["w"][0] == got["y"][0] and got["a"] == ("a", 0) and got["c"] == ("a", 2) and got["d"] == ("d", 0))


def field(spark, n, blocked, cost=lambda i, j: 1.0):
    rows = [(i, j, 9.0 + i * 0.02, 79.0 + j * 0.02, cost(i, j), "land" if (i, j) in blocked else None) for i in range(n) for j in range(n)]
    return rows, spark.createDataFrame(rows, "i INT, j INT, lat DOUBLE, lon DOUBLE, cost DOUBLE, blocked STRING")


def dijkstra(rows, start):
    cells = {(r[0], r[1]): r for r in rows if r[5] is None}
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        g, c = heapq.heappop(heap)
        if g > best[c]:
            continue
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                to = (c[0] + a, c[1] + b)
                if to in cells and to != c:
                    ng = g + haversine(cells[c][2], cells[c][3], cells[to][2], cells[to][3]) * cells[to][4]
                    if ng < best.get(to, math.inf):
                        best[to] = ng
                        heapq.heappush(heap, (ng, to))
    return best


@pytest.mark.parametrize("tile", [5, 32])
def test_surface_equals_dijkstra_with_a_wall(spark, tile):
    wall = {(i, 9) for i in range(2, 18)} | {(i, 4) for i in range(0, 15)}
    rows, cells = field(spark, 20, wall, lambda i, j: 1.0 + (i * 7 + j * 3) % 5)
    origins = spark.createDataFrame([(1, 3, 3), (2, 19, 19)], "origin BIGINT, i INT, j INT")
    surface = routing.least_cost_surface(cells, origins, tile)
    got = {(r.origin, r.i, r.j): r.g for r in surface.collect()}
    for origin, start in ((1, (3, 3)), (2, (19, 19))):
        want = dijkstra(rows, start)
        assert {k[1:]: pytest.approx(v, abs=1e-9) for k, v in got.items() if k[0] == origin} == want
    goals = spark.createDataFrame([(10, 1, 18, 17), (11, 1, 3, 3)], "route_id BIGINT, origin BIGINT, i INT, j INT")
    path = sorted((r.route_id, r.hop, r.i, r.j) for r in routing.extract_paths(routing.predecessors(surface, cells), goals).collect())
    long = [p for p in path if p[0] == 10]
    assert long[0][2:] == (3, 3) and long[-1][2:] == (18, 17) and [p[1] for p in long] == list(range(len(long)))
    assert all(max(abs(a[2] - b[2]), abs(a[3] - b[3])) == 1 for a, b in zip(long, long[1:])) and not any((p[2], p[3]) in wall for p in long)
    assert [p for p in path if p[0] == 11] == [(11, 0, 3, 3)]


def test_isolated_origin_has_no_path(spark):
    ring = {(i, j) for i in range(4, 17) for j in range(4, 17) if max(abs(i - 10), abs(j - 10)) == 6}
    _, cells = field(spark, 20, ring)
    surface = routing.least_cost_surface(cells, spark.createDataFrame([(1, 10, 10)], "origin BIGINT, i INT, j INT"), 8)
    assert surface.where("i = 0 AND j = 0").count() == 0 and surface.count() == 11 * 11


def test_gradient_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    values, lats, lons = rng.normal(size=(6, 5)), np.array([8.0, 8.1, 8.25, 8.3, 8.5, 8.55]), np.array([78.0, 78.2, 78.3, 78.35, 78.6])
    df = spark.createDataFrame([("s", i, j, float(lats[i]), float(lons[j]), float(values[i, j])) for i in range(6) for j in range(5)],
                               "s STRING, i INT, j INT, lat DOUBLE, lon DOUBLE, value DOUBLE")
    dy, dx = np.gradient(values, lats, lons)
    want = 1000 * np.hypot(dy / geo.METRES_PER_DEGREE, dx / (geo.METRES_PER_DEGREE * np.cos(np.radians(lats)))[:, None])
    for r in grid.gradient(df, ["s"], "value", 6, 5).collect():
        assert r.gradient == pytest.approx(want[r.i, r.j], rel=1e-9)


@pytest.mark.parametrize("words,tokens", [
    ("Hs 1.25 m at 07:30, on 2024-01-05", ["1.25"]), ("12345 and 12.3456 and v3.5 x", []), ("wind 18,5 kn. call 1554", ["18,5"]), ("20/30 or 40", ["40"]), ("77.", ["77"])])
def test_number_tokens(spark, words, tokens):
    assert one(spark, text.number_tokens(F.lit(words))) == tokens


def test_language_and_intents(spark):
    df = spark.createDataFrame([(1, "கடலுக்கு போகலாமா"), (2, "naalai kadal epadi"), (3, "what is declined"), (4, "")], "id INT, t STRING")
    assert [r.lang_found for r in text.with_language(df, "t").orderBy("id").collect()] == ["ta", "ta", "en", "en"]
    assert [r.lang_found for r in text.with_language(df, "t", ("gu", "hi")).orderBy("id").collect()] == ["gu", "gu", "gu", "gu"]
    assert [r.intents for r in text.with_intents(df, "t").orderBy("id").collect()][2:] == ["productivity", "safety_check"]


def test_catalogue_call_never_raises(spark):
    assert catalog.call("nope")[2] == "unknown operator nope"
    assert catalog.call("grid.regrid")[0] is None
    assert catalog.listing(spark).count() == len(catalog.OPERATORS)


def test_fence_check_table_function(spark):
    square = [("MPA", 1, 0, 0, 0, 79.0, 9.0, 79.2, 9.0, True), ("MPA", 1, 0, 0, 1, 79.2, 9.0, 79.2, 9.2, True),
              ("MPA", 1, 0, 0, 2, 79.2, 9.2, 79.0, 9.2, True), ("MPA", 1, 0, 0, 3, 79.0, 9.2, 79.0, 9.0, True)]
    catalog.register_fence_check(spark.createDataFrame(square, SEG))
    assert spark.sql("SELECT * FROM fence_check(9.1D, 79.1D)").first().distance_nm == 0
    assert spark.sql("SELECT * FROM fence_check(9.1D, 79.3D)").first().distance_nm == pytest.approx(haversine(9.1, 79.3, 9.1, 79.2))
