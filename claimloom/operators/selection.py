"""Exact percentiles of large groups: nearest ranks by rounds of counting histograms.

A value is looked for digit by digit, ``BITS`` of its 64-bit order key at a time: a round counts, for each group and
percentile, the rows in each cell of the next digit among those that agree with the digits found so far, and takes the
cell that holds the rank.  Counts are made before the shuffle, so a round moves at most ``2 ** BITS`` rows a group, a percentile and a task; neither
a group's rows nor its distinct values ever meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.scratch import written

BITS = 11
WIDTH = 64


def order_key(value: Column) -> Column:
    """A long in the order of doubles (NaN last, -0 as 0), from their bits."""
    plain = F.when(value == 0, F.lit(0.0)).otherwise(value.cast("double"))
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def from_order_key(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(key)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def nearest_ranks(rows: DataFrame, group: list[str], value: str, percentiles: list[float]) -> DataFrame:
    """``group, p, result``: per group the value at rank ``ceil(p * n)`` (the least for p <= 0, the largest for p >= 1); nulls do not count, groups without a value have no row."""
    keyed = written(rows.filter(F.col(value).isNotNull()).select(*group, order_key(F.col(value)).alias("_key")), "ranks")
    # the sign bit turned, so that digits are in order from the first on
    digits = lambda shift: F.shiftrightunsigned(F.col("_key").bitwiseXOR(F.lit(-(1 << 63))), shift)
    sizes = keyed.groupBy(*group).agg(F.count("*").alias("_n"))
    wanted = sizes.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
    rank = F.least(F.col("_n"), F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("_n") - F.lit(1e-9)))).cast("long")
    at = written(wanted.select(*group, "p", rank.alias("_rank"), F.lit(0).cast("long").alias("_found")), "ranks-at")
    done = WIDTH
    while done:
        shift = max(0, done - BITS)
        # rows that agree with the digits found so far; the first round takes all
        seen = F.lit(0).cast("long") if done == WIDTH else digits(done)
        done = shift
        cells = keyed.select(*group, seen.alias("_seen"), digits(shift).alias("_cell")).groupBy(*group, "_seen", "_cell").agg(F.count("*").alias("_c"))
        met = at.join(cells.withColumnRenamed("_seen", "_found"), [*group, "_found"])
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*group, "p").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = met.withColumn("_before", before).filter((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_c")))
        at = written(met.select(*group, "p", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_cell").alias("_found")), "ranks-at")
    return at.select(*group, "p", from_order_key(F.col("_found").bitwiseXOR(F.lit(-(1 << 63)))).alias("result"))
