"""Tracks against features of many pieces: every step against every segment."""

import math
import random

import numpy as np
import pytest

from pelagia.functions import geo
from pelagia.operators import fences
from pelagia.plans import tracks

SEG = "layer string, fkey int, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double, is_polygon boolean"


def ring(r, cx, cy, size, n):
    pts = [(cx + size * (1 + 0.4 * r.random()) * math.cos(2 * math.pi * k / n), cy + size * (1 + 0.4 * r.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return list(zip(pts, pts[1:] + pts[:1]))


def shapes(seed):
    r = random.Random(seed)
    out = []
    for fkey, (n, size) in enumerate([(4, 0.05), (150, 0.3), (400, 0.9), (40, 0.2)]):
        for part in range(1 + fkey % 2):
            for hole, scale in enumerate((1, 0.4)[:1 + part]):
                out += [("MPA", fkey, part, hole, k, *a, *b, True) for k, (a, b) in enumerate(ring(r, 79 + part * 0.7, 9 + part * 0.5, size * scale, n))]
    line = [(78.5 + k * 0.02, 9 + 0.3 * math.sin(k)) for k in range(100)]
    out += [("MPA", 9, 0, 0, k, *a, *b, False) for k, (a, b) in enumerate(zip(line, line[1:]))]
    out += [("MPA", 10, 0, 0, k, 79.0 + k % 3, 9.0, 79.1 + k % 3, 9.1, False) for k in range(9)]  # pieces that are not connected
    out.append(("MPA", 11, 0, 0, 0, 79.2, 9.2, 79.2, 9.2, False))  # a point
    return out


def brute(segs, lat, lon, polygon):
    best, crossed = (math.inf, 0, 0), 0
    for _, _, _, _, _, x1, y1, x2, y2, _ in segs:
        size = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = 0.0 if size == 0 else max(0.0, min(1.0, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / size))
        qx, qy = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
        best = min(best, ((lon - qx) ** 2 + (lat - qy) ** 2, qx, qy))
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            crossed += 1
    return 0.0 if polygon and crossed % 2 else float(geo.haversine_nm_array(lat, lon, best[2], best[1]))


@pytest.mark.parametrize("piece", [7, 64, 4096])
def test_every_step_against_every_segment(spark, monkeypatch, piece):
    monkeypatch.setattr(tracks, "PER_TASK", 11)
    monkeypatch.setattr(tracks, "LEAF", 4)
    r, segs = random.Random(piece), shapes(2)
    rows = []
    for n in range(60):
        fkey = r.choice([0, 1, 2, 3, 9, 10, 11])
        mine = [s for s in segs if s[1] == fkey]
        lat, lon = 9 + r.uniform(-1.2, 1.2), 79 + r.uniform(-1.2, 1.2)
        inside = brute(mine, lat, lon, mine[0][9]) == 0
        at = min((((lon - s[5]) ** 2 + (lat - s[6]) ** 2), s[6], s[5]) for s in mine)[1:] if n % 3 else (None, None)  # a place on the feature bounds the search
        rows.append((n, "MPA", fkey, lat, lon, r.uniform(0, 360), r.choice([1.0, 8.0, 30.0]), *((lat, lon) if inside and n % 2 else at)))
    frame = spark.createDataFrame(rows, "event_id int, layer string, fkey int, lat double, lon double, heading_deg double, speed_kn double, closest_lat double, closest_lon double")
    got = {x["event_id"]: x["nm"] for x in tracks.track_distances(frame, spark.createDataFrame(segs, SEG), ["event_id"], 3600.0, 12, piece).collect()}
    assert set(got) == {x[0] for x in rows}
    for n, _, fkey, lat, lon, heading, speed, at_lat, _ in rows:
        mine = [s for s in segs if s[1] == fkey]
        la, lo = tracks.sampled([lat], [lon], [heading], [speed], 3600.0, 12)
        for x, y, d in zip(la[0], lo[0], got[n]):
            want = brute(mine, x, y, mine[0][9])
            if at_lat == lat and want > 0:  # began inside: what is outside is not told further than the start
                assert d == math.inf or d == pytest.approx(want, abs=1e-9)
            else:
                assert d == pytest.approx(want, abs=1e-9)


def test_tracks_over_the_date_line(spark):
    segs = spark.createDataFrame([("MPA", 1, 0, 0, 0, -179.9, 8.9, -179.9, 9.1, False), ("MPA", 1, 1, 0, 0, 10.0, 9.0, 11.0, 9.0, False)], SEG)
    rows = spark.createDataFrame([(1, "MPA", 1, 9.0, 179.9, 90.0, 20.0, None, None)],
                                 "event_id int, layer string, fkey int, lat double, lon double, heading_deg double, speed_kn double, closest_lat double, closest_lon double")
    nm = tracks.track_distances(rows, segs, ["event_id"], 3600.0, 40).first()["nm"]
    assert np.isfinite(nm).all() and min(nm) < 0.3


def test_closing_time_does_not_depend_on_pieces(spark):
    from pelagia.workload.queries_fences import proximities
    from pelagia.workload.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    near = proximities(v).limit(4000)
    key = lambda piece: {(r.event_id, r.layer, r.fkey): r.eta_s for r in fences.closing_eta(near, v.fence_segments, ["event_id"], piece).collect()}
    one, two = key(4096), key(5)
    assert one == two and any(x is not None for x in one.values())


def test_features_at_hand_give_the_distances_of_the_pieces(spark):
    """Every step against every segment, with features of one and of many pieces, measured together and by leaves."""
    import pyarrow as pa

    r, segs = random.Random(5), shapes(3)
    names = [c.split()[0] for c in SEG.split(", ")]
    table = pa.table({c: [s[i] for s in segs] for i, c in enumerate(names)})
    feature = [r.choice([0, 1, 2, 3, 9, 10, 11, 77]) for _ in range(40)]
    lat, lon = (np.array([[c + r.uniform(-1.2, 1.2) for _ in range(6)] for _ in feature]) for c in (9, 79))
    for piece in (7, 4096):
        held = tracks.Features(table, piece)
        place = held.find(pa.table({"layer": ["MPA"] * len(feature), "fkey": feature}))
        assert [p < 0 for p in place] == [f == 77 for f in feature]
        known = np.flatnonzero(place >= 0)
        got = held.distances(place[known], lat[known], lon[known])
        for row, n in enumerate(known):
            mine = [s for s in segs if s[1] == feature[n]]
            for k in range(6):
                assert got[row, k] == pytest.approx(brute(mine, lat[n, k], lon[n, k], mine[0][9]), abs=1e-9)


def test_closing_time_takes_no_row_per_piece_and_repeated_keys_stay_as_they_were(spark, monkeypatch):
    segs = spark.createDataFrame([("MPA", 1, 0, 0, k, *a, *b, True) for k, (a, b) in enumerate([((79.0, 9.0), (79.2, 9.0)), ((79.2, 9.0), (79.2, 9.2)), ((79.2, 9.2), (79.0, 9.2)), ((79.0, 9.2), (79.0, 9.0))])]
                                 + [("MPA", 2, 0, 0, 0, 79.0, 9.3, 79.2, 9.3, False)], SEG)
    rows = [(n, "MPA", 1 + n % 2, 8.9 + n / 100, 78.9, 70.0 + n, 9.0, 6.0 + n / 100, 9.0, 79.0) for n in range(20)]
    rows += [rows[3], (7, "MPA", 2, 9.1, 79.1, 10.0, 0.1, 0.0, 9.1, 79.1), (None, "MPA", 1, 9.0, 78.9, 90.0, 9.0, 6.0, 9.0, 79.0), (99, "MPA", 5, 9.0, 78.9, 90.0, 9.0, 6.0, 9.0, 79.0)]
    near = spark.createDataFrame(rows, "event_id int, layer string, fkey int, lat double, lon double, heading_deg double, speed_kn double, distance_nm double, closest_lat double, closest_lon double")
    told = lambda **of: sorted(((x.event_id, x.fkey, x.speed_kn, x.eta_s) for x in fences.closing_eta(near, segs, ["event_id"], **of).collect()), key=str)
    got = told()
    assert len(got) == len(rows) and got == told(held_rows=0) and any(x[3] for x in got)
    met = []
    monkeypatch.setattr(fences, "track_distances", lambda *a: met.append(a))
    assert fences.closing_eta(near.dropDuplicates(["event_id"]), segs, ["event_id"]).where("eta_s IS NOT NULL").count() and not met
