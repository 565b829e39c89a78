"""Ordered lookups, percentile, components, plan shapes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import observe
from pelagia.plans.asof import nearest_time
from pelagia.plans.components import connected_components, graph_components
from pelagia.plans.ordered import previous_non_null, running_number
from pelagia.plans.percentile import exact_percentile


def test_previous_non_null_over_many_buckets(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.choice([None, rng.randint(0, 9)])) for k in (1, 2) for t in rng.sample(range(400), 120)]
    df = spark.createDataFrame(rows, "k INT, t INT, v INT")
    got = previous_non_null(df, ["k"], ["t"], F.floor(F.col("t") / 7), {"prev": F.col("v")})
    want = {}
    for k in (1, 2):
        last = None
        for _, t, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            want[(k, t)] = last
            last = v if v is not None else last
    assert {(r.k, r.t): r.prev for r in got.collect()} == want
    numbered = running_number(df, ["k"], [F.col("t")], F.floor(F.col("t") / 7), "n").collect()
    assert sorted(r.n for r in numbered if r.k == 1) == list(range(1, 121))


@pytest.mark.parametrize("p", [0.0, 0.5, 0.85, 1.0])
def test_percentile_equals_numpy(spark, p):
    rng = random.Random(3)
    groups = {"a": [rng.gauss(0, 5) for _ in range(3001)], "b": [1.5] * 40, "c": [1.0, 9.0], "d": [float(rng.randint(0, 3)) for _ in range(500)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("e", None)], "g STRING, v DOUBLE")
    got = {r.g: r.t for r in exact_percentile(df, ["g"], "v", p, "t").collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.percentile(vs, p * 100), abs=1e-9)


@pytest.mark.parametrize("p", [0.0, 0.37, 0.5, 0.999, 1.0])
def test_percentile_of_any_distribution(spark, p):
    """Values over 300 powers of ten, neighbours in the last bit, both zeros, a hot group; no key at all."""
    rng = random.Random(9)
    wide = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-300, 300) for _ in range(2000)] + [0.0, -0.0, 5e-324, -5e-324]
    close = [float(np.float64(1.0) + k * np.finfo(float).eps) for k in range(-50, 50)] * 3
    ends = [float("inf")] * 3 + [float("-inf")] * 3 + [1.0]
    groups = {"wide": wide, "close": close, "hot": [7.25] * 9000 + [float(k) for k in range(10)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g STRING, v DOUBLE")
    got = {r.g: r.t for r in exact_percentile(df, ["g"], "v", p, "t").collect()}
    for g, vs in groups.items():
        at = (len(vs) - 1) * p
        low, high = sorted(vs)[int(np.floor(at))], sorted(vs)[int(np.ceil(at))]
        assert got[g] == low + (high - low) * (at - np.floor(at))
    whole = exact_percentile(df.where("g = 'close'"), [], "v", p, "t").collect()
    assert [r.t for r in whole] == [got["close"]]
    extreme = exact_percentile(spark.createDataFrame([(v,) for v in ends], "v DOUBLE"), [], "v", p, "t").first().t
    assert p == 0.37 or extreme == {0.0: float("-inf"), 0.5: 1.0}.get(p, float("inf"))
    assert exact_percentile(df.limit(0), ["g"], "v", p, "t").count() == 0


@pytest.mark.parametrize("tile", [4, 64])
def test_components_cross_tiles(spark, tile):
    rng = random.Random(5)
    height, width = 30, 23
    cells = {(s, i, j) for s in ("x", "y") for i in range(height) for j in range(width) if rng.random() < 0.6}
    cells |= {("x", 0, j) for j in range(width)} | {("x", i, width - 1) for i in range(height)}
    labels = {c: c[1] * width + c[2] for c in cells}
    changed = True
    while changed:
        changed = False
        for s, i, j in cells:
            low = min([labels[(s, i, j)]] + [labels[n] for n in ((s, i + 1, j), (s, i - 1, j), (s, i, j + 1), (s, i, j - 1)) if n in cells])
            if low < labels[(s, i, j)]:
                labels[(s, i, j)] = low
                changed = True
    df = spark.createDataFrame(sorted(cells), "slice STRING, i INT, j INT")
    got = {(r.slice, r.i, r.j): r.label for r in connected_components(df, ["slice"], width, tile).collect()}
    assert got == labels


def test_long_chain_settles(spark):
    edges = spark.range(300).select(F.lit("g").alias("k"), (F.col("id") * 7919 % 301).alias("a"), ((F.col("id") + 1) * 7919 % 301).alias("b"))
    roots = graph_components(edges, ["k"])
    assert roots.select("root").distinct().collect()[0][0] == 0 and roots.count() == 301


def test_nearest_time_tie_goes_to_the_earlier(spark):
    files = spark.sql("SELECT 'p' k, timestamp_ntz'2024-01-01 00:00:00' f UNION ALL SELECT 'p', timestamp_ntz'2024-01-01 06:00:00'")
    asked = spark.sql("SELECT 1 id, 'p' k, timestamp_ntz'2024-01-01 03:00:00' t UNION ALL SELECT 2, 'p', timestamp_ntz'2024-01-01 06:00:00' "
                      "UNION ALL SELECT 3, 'p', timestamp_ntz'2024-01-03 00:00:00'")
    got = {r.id: r.match.match_time.hour if r.match else None for r in nearest_time(asked, files, ["k"], "t", "f", [], 6 * 3600).collect()}
    assert got == {1: 0, 2: 6, 3: None}


def test_plateaus_in_a_tide_series(spark):
    values = [1, 2, 2, 3, 3, 2, 1, 1, None, 4]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "s INT, h INT, v INT").withColumn(
        "t", F.timestamp_add("HOUR", F.col("h"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")))
    for bucket in (3600, 86400):
        got = sorted((r.t.hour, r.v, r.kind) for r in observe.local_extrema(df, ["s"], "t", "v", bucket).collect())
        assert got == [(4, 3, "high"), (7, 1, "low")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_paths_stay_native_and_without_cross_joins(spark):
    from pelagia import workload

    queries = workload.load().QUERIES
    for name in ("flagship_hourly_proximity", "f15_alert_level", "w6_closing_eta", "v7_ceiling_rules", "j2_k_nearest_ports", "g4_gradient_per_km",
                 "x2_alert_transitions", "w1_governing_reading", "n3_intents", "n7_unsourced_numbers"):
        plan = plan_of(queries[name](spark, "/root/testdata/sf0.001"))
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert word not in plan, (name, word)


def test_only_needed_columns_are_read(spark):
    from pelagia import workload

    plan = plan_of(workload.load().QUERIES["x4_latest_position"](spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan
