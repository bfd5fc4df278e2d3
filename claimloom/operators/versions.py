"""Predicate layer: closure deltas, contract sets, version walks, policies, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.scratch import written


def closure_delta(pre: DataFrame, post: DataFrame, key: list[str], group: list[str] | None = None) -> DataFrame:
    """Closed, remaining and new result rows, and the shape of the change."""
    group = group or []
    a, b = pre.select(*group, *key).distinct().withColumn("_a", F.lit(1)), post.select(*group, *key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, [*group, *key], "full_outer")
    n = lambda c: F.count_if(c)
    out = both.groupBy(*group).agg(n(F.col("_b").isNull()).alias("closed"), n(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("remaining"), n(F.col("_a").isNull()).alias("new"))
    c, r, w = F.col("closed"), F.col("remaining"), F.col("new")
    shape = F.when((c == 0) & (w == 0), "unchanged").when((r == 0) & (w == 0), "empty").when(w == 0, "strict-subset").when(c == 0, "grew").otherwise("non-monotonic")
    return out.withColumn("shape", shape).withColumn("discharges", shape.isin("empty", "strict-subset"))


def set_bump(old: DataFrame, new: DataFrame, member: str, group: list[str]) -> DataFrame:
    """Equal sets: patch; a superset: minor; else major."""
    return closure_delta(old, new, [member], group).select(*group, "closed", "new", F.when(F.col("closed") > 0, "major").when(F.col("new") > 0, "minor").otherwise("patch").alias("bump"))


def version_walk(releases: DataFrame, base, signers: list[str], channel: str, yanked: DataFrame | None = None) -> DataFrame:
    """Releases reachable from ``base`` by previous-set links over trusted, unyanked releases of a channel, each once with its first step.

    A frontier is joined to the links, and what has been seen leaves it, so cycles end; the walk goes on until the frontier is empty.
    """
    ok = releases.filter(F.col("signer").isin(*signers) & (F.col("channel") == channel))
    if yanked is not None:
        ok = ok.join(yanked.select("set_cid").distinct(), "set_cid", "left_anti")
    # links lie by their previous release, once; a round reads them and writes its frontier
    ok = written(ok.select("set_cid", "previous_set_cid", "declared_at").repartition("previous_set_cid"), "releases")
    once = lambda d, step: written(d.groupBy("set_cid").agg(F.max("declared_at").alias("declared_at")).withColumn("step", F.lit(step)), "walk")
    front, step = once(ok.filter(F.col("set_cid") == F.lit(base)), 0), 0
    seen = front
    while not front.isEmpty():
        step += 1
        reached = ok.join(front.select(F.col("set_cid").alias("previous_set_cid")), "previous_set_cid", "left_semi")
        front = once(reached.join(seen.select("set_cid"), "set_cid", "left_anti"), step)
        seen = seen.unionByName(front) if step % 16 else written(seen.unionByName(front), "walk")
    return seen


def latest_release(walk: DataFrame) -> DataFrame:
    """The release of a walk that was declared last; ties by the larger id."""
    return walk.groupBy().agg(F.max_by(F.struct("set_cid", "declared_at", "step"), F.struct("declared_at", "set_cid")).alias("r")).filter("r is not null").select("r.*")


def quorum(signatures: DataFrame, eligible: list[str], size: int, group: str) -> DataFrame:
    return signatures.groupBy(group).agg(F.countDistinct(F.when(F.col("signer").isin(*eligible), F.col("signer"))).alias("signers")).withColumn("met", F.col("signers") >= size)


def threshold(value: Column, op: str, limit) -> Column:
    return {"eq": value == limit, "gte": value >= limit, "gt": value > limit, "lte": value <= limit, "lt": value < limit}[op]


def witnesses(rows: DataFrame, group: str, least: int) -> DataFrame:
    """At least ``least`` passing witnesses with one schema; else rejected with the axis."""
    p = rows.filter("passed").groupBy(group).agg(F.count("*").alias("witnesses"), F.countDistinct("schema").alias("schemas"))
    return p.withColumn("result", F.when(F.col("witnesses") < least, "too-few").when(F.col("schemas") > 1, "schema").otherwise("agreed"))


def lexicographic(rows: DataFrame, group: list[str], dimensions: list[str], tie: str) -> DataFrame:
    """The best row of each group: by dimension in order no loss first, then the lower value; ties by ``tie``."""
    keys = [c for d in dimensions for c in (F.col(d).isNotNull().cast("int"), F.col(d))]
    w = Window.partitionBy(*group).orderBy(*keys, F.col(tie))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def weighted(rows: DataFrame, group: list[str], weights: dict[str, int], tie: str) -> DataFrame:
    """The row with the least weighted sum of losses; ties by ``tie``."""
    score = sum((F.coalesce(F.col(d), F.lit(0)) * w for d, w in weights.items()), F.lit(0))
    w = Window.partitionBy(*group).orderBy(F.col("score"), F.col(tie))
    return rows.withColumn("score", score).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def disagreements(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.countDistinct("verdict").alias("verdicts")).filter("verdicts > 1")
