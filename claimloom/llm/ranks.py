"""Running totals and ranks that no single task has to see whole.

A group's rows are cut into buckets by the leading bits of a uniform 60-bit key;
bucket sums are small and get a window; a second window runs inside a bucket.
A group that holds all rows is therefore spread over all buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_BITS = 60
#: Rows that a bucket of the largest group has, about.
BUCKET_ROWS = 500


def uniform_key(*parts: Column) -> Column:
    """60 uniform bits (from MD5) of the parts, nulls as empty strings."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15), 16, 10).cast("long")


def bits_for(rows: int) -> int:
    return min(24, max(1, math.ceil(math.log2(max(2, rows / BUCKET_ROWS)))))


def running_total(df: DataFrame, group: list[str], key: str, order: list[str], value: Column, out: str, rows: int, spread: bool = False) -> DataFrame:
    """Add ``out``: the inclusive running total of ``value`` in each group (columns without nulls), in order of ``key`` and then ``order``.

    ``spread``: the rows come from a join by group, whose partitions the windows inside the buckets would else keep.
    """
    b = df.withColumn("_b", F.shiftright(F.col(key), KEY_BITS - bits_for(rows))).withColumn("_v", value)
    keys = [*group, "_b"]
    b = b.repartition(*keys) if spread else b
    sums = b.groupBy(*keys).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys).orderBy(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn(out, F.sum("_v").over(inside)).join(sums, keys).withColumn(out, F.col(out) + F.col("_o")).drop("_b", "_v", "_o")
