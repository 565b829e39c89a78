"""As-of and nearest-time joins without pairing rows of a group.

Both sides are stacked and each left row looks up the last right row before it (and,
for nearest, the first one after it) with the bucketed carry of ``plans.ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pelagia.plans.ordered import micros_of, previous_non_null


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
         payload: list[str], backward: bool = True, bucket_s: int = 3600) -> DataFrame:
    """Adds struct ``match`` (right_time + payload), null when no right row is on that side.

    A right row at exactly the left time counts on both sides.
    """
    match = F.struct(F.col(right_time).alias("match_time"), *[F.col(c) for c in payload])
    blank = F.lit(None).cast(right.select(match.alias("m")).schema["m"].dataType)
    rest = [c for c in left.columns if c not in keys]
    carried = F.lit(None).cast(left.select(F.struct(*rest).alias("r")).schema["r"].dataType)
    stacked = (
        left.select(*keys, micros_of(left_time).alias("_t"), F.lit(1).alias("_side"),
                    F.struct(*rest).alias("_row"), blank.alias("_m"))
        .unionByName(right.select(*keys, micros_of(right_time).alias("_t"), F.lit(0).alias("_side"),
                                  carried.alias("_row"), match.alias("_m"))))
    if not backward:
        stacked = stacked.withColumn("_t", -F.col("_t"))
    slot = F.floor(F.col("_t") / F.lit(bucket_s * 1_000_000)).cast("long")
    looked = previous_non_null(stacked, keys, ["_t", "_side"], slot, {"match": F.col("_m")})
    return looked.where(F.col("_side") == 1).select(*keys, "_row.*", "match")


def nearest_time(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
                 payload: list[str], within_s: int | None = None, bucket_s: int = 3600) -> DataFrame:
    """Adds ``match``: the right row nearest in time, the earlier one when equally near."""
    before = asof(left, right, keys, left_time, right_time, payload, True, bucket_s).withColumnRenamed("match", "_b")
    both = asof(before, right, keys, left_time, right_time, payload, False, bucket_s).withColumnRenamed("match", "_a")
    gap = lambda m: F.abs(micros_of(F.col(left_time)) - micros_of(F.col(m + ".match_time")))
    pick = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")) \
        .when(gap("_b") <= gap("_a"), F.col("_b")).otherwise(F.col("_a"))
    out = both.withColumn("match", pick).drop("_a", "_b")
    if within_s is None:
        return out
    near: Column = F.abs(micros_of(F.col(left_time)) - micros_of(F.col("match.match_time"))) <= within_s * 1_000_000
    return out.withColumn("match", F.when(near, F.col("match")))
