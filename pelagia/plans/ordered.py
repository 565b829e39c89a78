"""Order-dependent lookups that never put a whole series into one task.

A plain window over ``partition by series`` sends a series to one task, however long it
is. Here a series is cut into time buckets: a window works inside each bucket, and the
value carried over from earlier buckets comes from a small per-bucket summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def seconds_of(ts) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp (independent of the session zone)."""
    ts = ts if isinstance(ts, Column) else F.col(ts)
    return F.timestamp_diff("SECOND", F.expr(EPOCH), ts)


def micros_of(ts) -> Column:
    ts = ts if isinstance(ts, Column) else F.col(ts)
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)


def time_bucket(ts, seconds: int) -> Column:
    return F.floor(seconds_of(ts) / F.lit(seconds)).cast("long")


def previous_non_null(df: DataFrame, keys: list[str], order: list[str], bucket: Column,
                      values: dict[str, Column]) -> DataFrame:
    """For each name -> expression, the last non-null value strictly before the row.

    ``bucket`` must not decrease along ``order`` within a key.
    """
    part = df.withColumn("_bucket", bucket)
    ordering = F.struct(*order)
    tails = part.groupBy(*keys, "_bucket").agg(
        *[F.max_by(v, F.when(v.isNotNull(), ordering)).alias("_t_" + n) for n, v in values.items()])
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *keys, "_bucket",
        *[F.last("_t_" + n, ignorenulls=True).over(across).alias("_c_" + n) for n in values])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = part.select("*", *[F.last(v, ignorenulls=True).over(inside).alias("_l_" + n) for n, v in values.items()])
    return local.join(carried, [*keys, "_bucket"]).select(
        *df.columns, *[F.coalesce("_l_" + n, "_c_" + n).alias(n) for n in values])


def previous_max(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Maximum of ``value`` over the rows strictly before the row in the key's order."""
    part = df.withColumn("_bucket", bucket)
    tops = part.groupBy(*keys, "_bucket").agg(F.max(value).alias("_top"))
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "_bucket", F.max("_top").over(across).alias("_carry"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = part.select("*", F.max(value).over(inside).alias("_local"))
    return local.join(carried, [*keys, "_bucket"]).select(*df.columns, F.greatest("_local", "_carry").alias(name))


def running_number(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """1-based position within the key, computed per bucket plus the count before it."""
    part = df.withColumn("_bucket", bucket)
    counts = part.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (part.withColumn("_pos", F.row_number().over(inside)).join(offsets, [*keys, "_bucket"])
            .select(*df.columns, (F.col("_pos") + F.col("_off")).alias(name)))


def balanced(df: DataFrame) -> DataFrame:
    """Spread rows evenly: few bytes but much work per row, which coalescing by size would put in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark limits each group before the shuffle, so hot keys stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
