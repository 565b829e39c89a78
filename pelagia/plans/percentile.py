"""Exact percentile with linear interpolation, by radix selection.

The built-in exact ``percentile`` keeps every distinct value of a group in one buffer.
Here a value becomes a 64-bit whole number in the same order, and each of four passes counts the next sixteen bits
among the values that share the wanted rank's bits so far. A pass gives at most 65 536 counts for each rank, whatever the group's
size and however its values are spread; after the last one the value is known. Nothing is ordered but counts.

The input is read once and its numbers are written once; a pass reads those and joins a few rows for each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pelagia.session import cut_lineage

DIGITS = (48, 32, 16, 0)


def ordered_bits(value: Column) -> Column:
    """A double as a long in the same order; both zeros are one, NaN is above all."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def exact_percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str = "threshold") -> DataFrame:
    """One row per key: the ``p`` percentile (0..1) of the non-null values."""
    dummy = not keys
    v = F.col(value).cast("double")
    data = df.where(v.isNotNull()).select(*keys, v.alias("_v"), ordered_bits(v).alias("_bits"))
    if dummy:
        data, keys = data.withColumn("_all", F.lit(1)), ["_all"]
    data = cut_lineage(data)
    head = lambda shift: F.shiftright("_bits", shift)
    counts = cut_lineage(data.groupBy(*keys, head(DIGITS[0]).alias("_head")).agg(F.count(F.lit(1)).alias("_c")))
    at = (F.col("_n") - 1) * F.lit(float(p))
    ranks = counts.groupBy(*keys).agg(F.sum("_c").alias("_n")).select(
        *keys, F.lit(0).cast("long").alias("_before"), at.alias("_at"), F.explode(F.array(F.floor(at), F.ceil(at))).alias("_rank")).distinct()
    within = [*keys, "_rank", "_at"]
    targets = cut_lineage(_holding(counts.join(ranks, keys), within))
    for before, shift in zip(DIGITS, DIGITS[1:]):
        met = data.withColumn("_head", head(before)).join(targets, [*keys, "_head"])
        counts = met.groupBy(*within, "_before", head(shift).alias("_head")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_v"))
        targets = cut_lineage(_holding(counts, within, *(["_v"] if shift == DIGITS[-1] else [])))
    low, high = F.min("_v"), F.max("_v")
    between = F.when(low == high, low).otherwise(low + (high - low) * (F.col("_at") - F.floor("_at")))
    out = targets.groupBy(*keys, "_at").agg(between.alias(name))
    return out.select(*([] if dummy else keys), name)


def _holding(counts: DataFrame, within: list[str], *also: str) -> DataFrame:
    """The count of each target that reaches past the wanted rank: its head and how many values come before it."""
    upto = Window.partitionBy(*within).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    return (counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_c").over(upto), F.lit(0)))
            .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
            .select(*within, "_head", "_before", *also))
