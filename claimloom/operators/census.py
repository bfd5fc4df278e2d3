"""Measurement: families, ranks, percentiles, bins, packing and reconciliation."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def families(nodes: DataFrame, kind: str, locus: list[str], top: int = 40) -> DataFrame:
    """Counts by kind of distinct (kind, locus), the ``top`` largest; ties by kind."""
    return nodes.select(kind, *locus).distinct().groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind).limit(top)


def positions(rows: DataFrame, *order, out: str = "position") -> DataFrame:
    """Add the position (from 0) of each row in ``order``, without a task that sees all rows.

    Rows are range-partitioned by the whole order, so ties split too; a partition's rows are numbered apart and moved up by
    the counts of those before (as many rows as partitions).  The tagged rows are checkpointed: both readings see the same ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = tagged.withColumn(out, F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return inside.join(F.broadcast(before), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def ranked(rows: DataFrame, owner: str) -> DataFrame:
    n = rows.groupBy(owner).agg(F.count("*").alias("n"))
    return positions(n, F.desc("n"), F.col(owner), out="rank").withColumn("rank", F.col("rank") + 1)


def bins(rows: DataFrame, cost: str, key: str, n: int) -> DataFrame:
    """Bins of equal count in order of cost: row i of N (from 0) is in bin ``floor(i * n / N)``. With each bin's upper median."""
    total = rows.count()
    b = positions(rows.select(cost, key), F.col(cost), F.col(key), out="_i").withColumn("bin", F.floor(F.col("_i") * n / total).cast("int"))
    # bin b begins at ceil(b * N / n), so the place of its upper median is known
    start = lambda x: F.ceil(x * F.lit(total) / n)
    middle = start(F.col("bin")) + F.floor((start(F.col("bin") + 1) - start(F.col("bin"))) / 2)
    return b.groupBy("bin").agg(F.count("*").alias("rows"), F.max(F.when(F.col("_i") == middle, F.col(cost))).alias("upper_median"))


def stable_zero(rows: DataFrame, group: list[str], counters: list[str], denominator: str) -> DataFrame:
    """True where all counters are zero over a denominator above zero; absence is not zero."""
    ok = F.coalesce(F.bool_and(F.greatest(*[F.coalesce(F.col(c) != 0, F.lit(True)).cast("int") for c in counters], F.lit(0)) == 0), F.lit(False))
    return rows.groupBy(*group).agg((ok & (F.coalesce(F.sum(denominator), F.lit(0)) > 0)).alias("stable_zero"))


def attendance(roster: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Every key of the roster reported exactly once? ``ok, missing, repeated`` or ``unknown``."""
    r = reports.groupBy(key).agg(F.count("*").alias("reports"))
    out = roster.select(key, F.lit(True).alias("_r")).join(r, key, "full_outer")
    return out.select(key, F.when(F.col("_r").isNull(), "unknown").when(F.col("reports").isNull(), "missing").when(F.col("reports") > 1, "repeated").otherwise("ok").alias("state"))


MAX_UNITS = 100_000


def lpt(costs: list[tuple[str, float]], shards: int) -> dict[str, int]:
    """Longest processing time first: by falling cost, then path, into the least loaded shard (lowest index at ties).

    The list of work units is small by nature (files of one suite); it is packed on the driver, and more than ``MAX_UNITS`` are refused.
    """
    if len(costs) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} work units")
    heap = [(0.0, s) for s in range(shards)]
    out = {}
    for path, cost in sorted(costs, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[path] = s
        heapq.heappush(heap, (load + cost, s))
    return out


def round_robin(rows: DataFrame, cost: str, key: str, shards: int) -> DataFrame:
    return positions(rows, F.desc(cost), F.col(key), out="shard").withColumn("shard", F.col("shard") % shards)


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison in which a missing side is missing, not zero."""
    a, b = left.select(key, F.col(value).alias("a")), right.select(key, F.col(value).alias("b"))
    return a.join(b, key, "full_outer").withColumn("state", F.when(F.col("a").isNull(), "missing_left").when(F.col("b").isNull(), "missing_right").when(F.col("a") == F.col("b"), "equal").otherwise("differs"))
