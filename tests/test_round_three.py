"""Measured rows are never the side of a join that is sent, tables are spread by their rows, groups of a join are bounded."""

from pyspark.sql import functions as F

from pelagia.operators import fences as fence_ops, joins
from pelagia.plans import spatial
from pelagia.workload.views import Views


def _positions(spark, n=300):
    return spark.range(n).select(F.col("id").alias("event_id"), (8 + F.col("id") % 17 / 10).alias("lat"), (78 + F.col("id") % 23 / 10).alias("lon")).repartition(4)


def _fences(spark):
    segments = spark.createDataFrame([("MPA", k, 0, 0, 0, 78.0 + k / 10, 8.0, 78.2 + k / 10, 8.5, False) for k in range(5)],
                                     "layer STRING, fkey INT, part INT, ring INT, seq INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, is_polygon BOOLEAN")
    fences = spark.createDataFrame([("MPA", k, f"fence {k}", None, None) for k in range(5)], "layer STRING, fkey INT, name STRING, own_warn_nm DOUBLE, own_critical_nm DOUBLE")
    return segments, fences


def _run(df):
    """Rows, and the plan as it ran."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_levels_send_the_classes_and_not_the_positions(spark):
    rows, plan = _run(fence_ops.fence_proximities(_positions(spark), *_fences(spark)).select("event_id", "layer", "fkey", "level_rank", "level"))
    assert len(rows) == 300 and len({r.event_id for r in rows}) == 300
    assert "MapInArrow" in plan and "BuildLeft" not in plan


def test_ports_are_looked_up_and_the_points_not_sent(spark):
    # a table of ports that is itself a join, whose size the planner can only overestimate
    names = F.broadcast(spark.createDataFrame([(k, f"district {k}") for k in range(3)], "no INT, district STRING"))
    ports = spark.range(40).select(F.col("id").alias("port_id"), (8 + F.col("id") % 7 / 10).alias("lat"), (78 + F.col("id") % 11 / 10).alias("lon"),
                                   (F.col("id") % 3).cast("int").alias("no"), F.lit("port").alias("name")).join(names, "no")
    rows, plan = _run(joins.nearest_ports(_positions(spark), ports, "event_id", 2).select("event_id", "port_id", "port_district"))
    assert len(rows) == 600
    assert "MapInArrow" in plan and "BuildLeft" not in plan


def test_a_table_of_many_splits_with_rows_in_one_is_spread(spark, tmp_path):
    views = Views(spark, str(tmp_path))
    df = spark.range(0, 6400, numPartitions=64).where("id < 90")
    sizes = [r["count"] for r in views.spread(df).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 90 and len(sizes) > 1
    assert views.spread(df.where("id < 0")).count() == 0


def test_groups_of_points_and_candidates_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(spatial, "GROUP_POINTS", 10)
    monkeypatch.setattr(spatial, "GROUP_CANDIDATES", 8)
    # 60 cells of nine points, one of 95, and up to four candidates in each
    here = spark.range(540).select(F.col("id").alias("event_id"), (F.col("id") % 60).cast("int").alias("ix"), F.lit(1).alias("iy")).union(
        spark.range(540, 635).select("id", F.lit(99), F.lit(1)))
    cells = here.select("ix", "iy").distinct()
    index = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("ix") % 4)).alias("fkey"))
    left, right = spatial._grouped(here, index, index.count(), lambda a, b: (a, b))
    points, held = ({r["_group"]: r["count"] for r in side.count().collect()} for side in (left, right))
    assert sum(points.values()) == 635 and max(points.values()) <= 20
    assert set(points) == set(held) and max(held.values()) <= 12
