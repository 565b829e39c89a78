"""The nearest-feature join against brute force on random shapes."""

import math
import random

import pytest

from pelagia.plans.spatial import nearest_features, point_segments, polygons_containing

SEG = "layer STRING, fkey INT, part INT, ring INT, seq INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, is_polygon BOOLEAN"


def haversine(a1, o1, a2, o2):
    p1, p2 = math.radians(a1), math.radians(a2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(o2 - o1) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h))) / 1852


def shapes(seed, n, spread=20.0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        layer = "abc"[k % 3]
        cx, cy = rng.uniform(60, 60 + spread), rng.uniform(-10, -10 + spread)
        if k % 2:
            ring = [(cx + 1.5 * math.cos(t), cy + 1.0 * math.sin(t)) for t in [i * math.pi / 5 for i in range(10)]]
            rows += [(layer, k, 0, 0, i, *ring[i], *ring[(i + 1) % 10], True) for i in range(10)]
            hole = [(cx - 0.3, cy - 0.3), (cx + 0.3, cy - 0.3), (cx + 0.3, cy + 0.3), (cx - 0.3, cy + 0.3)]
            rows += [(layer, k, 0, 1, 10 + i, *hole[i], *hole[(i + 1) % 4], True) for i in range(4)]
        else:
            pts = [(cx, cy)]
            for _ in range(4):
                pts.append((pts[-1][0] + rng.uniform(-1, 1), pts[-1][1] + rng.uniform(-1, 1)))
            rows += [(layer, k, 0, 0, i, *pts[i], *pts[i + 1], False) for i in range(4)]
    return rows


def brute(points, rows, k):
    out = {}
    for pid, lat, lon in points:
        per = {}
        for layer, fkey, _, _, _, x1, y1, x2, y2, poly in rows:
            dx, dy = x2 - x1, y2 - y1
            t = 0 if dx == dy == 0 else max(0, min(1, ((lon - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy)))
            qx, qy = x1 + t * dx, y1 + t * dy
            d2 = (lon - qx) ** 2 + (lat - qy) ** 2
            best = per.setdefault((layer, fkey), [math.inf, 0, 0, 0, poly])
            if d2 < best[0]:
                best[:3] = d2, qx, qy
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                best[3] += 1
        ranked = {}
        for (layer, fkey), (_, qx, qy, crossings, poly) in per.items():
            inside = poly and crossings % 2 == 1
            d = 0.0 if inside else haversine(lat, lon, qy, qx)
            ranked.setdefault(layer, []).append((round(d, 9), fkey, inside))
        for layer, found in ranked.items():
            for rank, (d, fkey, inside) in enumerate(sorted(found)[:k], 1):
                out[(pid, layer, rank)] = (fkey, round(d, 6), inside)
    return out


@pytest.mark.parametrize("k,rows_limit,spread", [(1, 200_000, 20.0), (3, 200_000, 20.0), (1, 0, 20.0), (2, 0, 3.0), (1, 200_000, 0.5)])
def test_nearest_equals_brute_force(spark, k, rows_limit, spread):
    rows = shapes(7, 40, spread)
    rng = random.Random(k)
    points = [(i, rng.uniform(-14, -6 + spread), rng.uniform(57, 64 + spread)) for i in range(150)]
    # A third of the points in one place: a hot cell.
    points += [(150 + i, -5.0, 65.0) for i in range(75)] + [(300, None, 60.0)]
    got = nearest_features(spark.createDataFrame(points, "pid INT, lat DOUBLE, lon DOUBLE"), spark.createDataFrame(rows, SEG),
                           k=k, broadcast_rows=rows_limit)
    found = {(r.pid, r.layer, r.rank): (r.fkey, round(r.distance_nm, 6), r.inside) for r in got.collect()}
    want = brute([p for p in points if p[1] is not None], rows, k)
    assert found.keys() == want.keys()
    assert all(f[0] == w[0] and f[2] == w[2] and abs(f[1] - w[1]) < 1e-5 for f, w in ((found[key], want[key]) for key in want))


def test_far_points_and_identical_ports(spark):
    ports = [(i, 10.0 if i < 5 else 40.0, 20.0 if i < 5 else -150.0) for i in range(8)]
    df = spark.createDataFrame(ports, "port_id INT, lat DOUBLE, lon DOUBLE")
    points = spark.createDataFrame([(1, -60.0, 170.0), (2, 10.0, 20.0)], "pid INT, lat DOUBLE, lon DOUBLE")
    got = nearest_features(points, point_segments(df, "p", "port_id", "lat", "lon"), k=2)
    found = sorted((r.pid, r.rank, r.fkey) for r in got.collect())
    order = sorted(ports, key=lambda p: (round(haversine(-60, 170, p[1], p[2]), 9), p[0]))
    assert found == [(1, 1, order[0][0]), (1, 2, order[1][0]), (2, 1, 0), (2, 2, 1)]


def test_max_distance_and_polygons(spark):
    rows = shapes(3, 20)
    points = [(i, -10 + i * 0.37 % 20, 60 + i * 0.73 % 20) for i in range(200)]
    pdf = spark.createDataFrame(points, "pid INT, lat DOUBLE, lon DOUBLE")
    segs = spark.createDataFrame(rows, SEG)
    near = nearest_features(pdf, segs, max_nm=30.0).collect()
    want = {key[:2]: v for key, v in brute(points, rows, 1).items() if v[1] <= 30}
    assert {(r.pid, r.layer): (r.fkey, round(r.distance_nm, 6), r.inside) for r in near} == want
    inside = {(r.pid, r.fkey) for r in polygons_containing(pdf, segs).collect()}
    assert inside == {(k[0], v[0]) for k, v in brute(points, rows, 99).items() if v[2]}


def test_crowded_places_bound_the_candidates(spark):
    """500 ports at each of two places: a cell lists the first k of a place, and the answer is that of all ports."""
    from pelagia.plans.spatial import candidate_index

    ports = [(i, 10.0 + i % 2, 20.0) for i in range(1000)]
    segments = point_segments(spark.createDataFrame(ports, "port_id INT, lat DOUBLE, lon DOUBLE"), "p", "port_id", "lat", "lon")
    points = spark.createDataFrame([(1, 10.0, 20.001), (2, 11.0, 20.001)], "pid INT, lat DOUBLE, lon DOUBLE")
    assert candidate_index(points, segments, k=3)[2] <= 12
    for limit in (0, 200_000):
        got = sorted((r.pid, r.rank, r.fkey) for r in nearest_features(points, segments, k=3, broadcast_rows=limit).collect())
        assert got == [(1, 1, 0), (1, 2, 2), (1, 3, 4), (2, 1, 1), (2, 2, 3), (2, 3, 5)]


def test_candidates_are_never_sent_whole_by_the_planner(spark):
    from pelagia.plans import spatial

    cand = spark.createDataFrame([(0, 0, *row, None, None, None, None) for row in shapes(1, 4)],
                                 f"ix INT, iy INT, {SEG}, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE")
    plan = spatial._prune(cand, 1.25, 5, None, False)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_a_hot_cell_is_dealt_out(spark, monkeypatch):
    from pelagia.plans import spatial

    monkeypatch.setattr(spatial, "GROUP_POINTS", 10)
    rows = shapes(7, 40, 3.0)
    points = [(i, -8.5, 61.5) for i in range(75)] + [(75 + i, -9.0 + i / 20, 61.0) for i in range(20)]
    near = nearest_features(spark.createDataFrame(points, "pid INT, lat DOUBLE, lon DOUBLE"), spark.createDataFrame(rows, SEG), k=2, broadcast_rows=0)
    found = {(r.pid, r.layer, r.rank): (r.fkey, round(r.distance_nm, 6), r.inside) for r in near.collect()}
    want = brute(points, rows, 2)
    assert found.keys() == want.keys() and all(found[k][0] == want[k][0] and found[k][2] == want[k][2] for k in want)
    assert near.rdd.getNumPartitions() > 5


def test_spread_tasks_grow_with_the_table(spark, monkeypatch):
    from pelagia.workload import views

    monkeypatch.setattr(views, "ROWS_PER_TASK", 100)
    assert views.Views(spark, "").spread(spark.range(0, 5000, 1, 1)).rdd.getNumPartitions() == 50


def test_regions_are_sent_to_every_task_only_where_counted_few(spark, monkeypatch):
    from pelagia.operators import joins

    places = spark.createDataFrame([(n, 8.0 + n / 10, 78.0 + n % 7 / 10, n % 3) for n in range(30)], "place int, lat double, lon double, zone int")
    asked = spark.createDataFrame([(n, 8.05 + n / 9, 78.03, n % 5) for n in range(20)], "id int, lat double, lon double, zone int")
    told = lambda: sorted(tuple(r) for r in joins.nearest_in_region(asked, places, "zone", "place").select("id", "place", "widened", "rank").collect())
    few = told()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    assert few == told() and len(few) == 60 and {r[2] for r in few} == {True, False}
