"""Routes over tile borders against a plain search of the whole lattice."""

import heapq
import math
import random

import pytest

from pelagia.functions import geo
from pelagia.plans import overlay


def lattice(seed, height, width, blocked):
    r = random.Random(seed)
    return [(i, j, 8 + i * 0.01, 78 + j * 0.01, 1 + r.random() * 3 if seed % 2 else 1.0, "land" if r.random() < blocked else None)
            for i in range(height) for j in range(width)]


def around(c):
    return [(c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def settled(open_, start):
    step = lambda u, v: float(geo.haversine_nm_array(*open_[u][:2], *open_[v][:2])) * open_[v][2]
    g, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        for v in around(u):
            if d == g[u] and v in open_ and d + step(u, v) < g.get(v, math.inf):
                g[v] = d + step(u, v)
                heapq.heappush(heap, (g[v], v))
    back = {u: min((round(g[v], 9), v) for v in around(u) if v in g and g[v] + step(v, u) <= g[u] + 1e-9)[1] for u in g if u != start}
    return g, back


@pytest.mark.parametrize("seed,height,width,blocked,tile", [(1, 17, 22, 0.3, 8), (2, 20, 20, 0.2, 10), (4, 9, 9, 0.0, 32)])
def test_costs_and_paths(spark, monkeypatch, seed, height, width, blocked, tile):
    monkeypatch.setattr(overlay, "PER_TASK", 5)
    monkeypatch.setattr(overlay, "TOGETHER", 3)
    monkeypatch.setattr(overlay, "MERGE", 2)
    cells = lattice(seed, height, width, blocked)
    open_ = {(i, j): (lat, lon, cost) for i, j, lat, lon, cost, b in cells if b is None}
    shut = [(c[0], c[1]) for c in cells if c[5]]
    r = random.Random(seed)
    origins = r.sample(sorted(open_), 3)
    pairs = [(*r.choice(origins), *r.choice(sorted(open_))) for _ in range(25)]
    pairs += [(*origins[0], *origins[0]), pairs[0], (None, None, 1, 1), (*origins[1], None, None)] + [(*origins[2], *s) for s in shut[:2]]
    routes = overlay.Routes(spark.createDataFrame(cells, "i int, j int, lat double, lon double, cost double, blocked string"),
                            spark.createDataFrame(pairs, "oi int, oj int, gi int, gj int"), tile)
    best = {tuple(x)[:4]: x["g"] for x in routes.best.collect()}
    paths = {}
    for x in routes.paths().collect():
        paths.setdefault(tuple(x)[:4], []).append((x["hop"], (x["i"], x["j"])))
    known = {o: settled(open_, o) for o in origins}
    want = {p for p in pairs if p[:2] in known and p[2:] in known[p[:2]][0]}
    assert set(best) == want == set(paths)
    for p in want:
        g, back = known[p[:2]]
        assert best[p] == pytest.approx(g[p[2:]], abs=1e-9)
        cells_back = [p[2:]]
        while cells_back[-1] != p[:2]:
            cells_back.append(back[cells_back[-1]])
        assert sorted(paths[p]) == list(enumerate(reversed(cells_back)))


def test_no_pairs(spark):
    cells = spark.createDataFrame(lattice(3, 5, 5, 0.2), "i int, j int, lat double, lon double, cost double, blocked string")
    routes = overlay.Routes(cells, spark.createDataFrame([], "oi int, oj int, gi int, gj int"), 4)
    assert routes.best.count() == 0 and routes.paths().count() == 0
