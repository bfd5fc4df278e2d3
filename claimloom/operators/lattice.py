"""Losses of composed morphisms along searched paths: the least lossy ways from a sort to all that it reaches.

A loss is a set of modes (bits).  Composition is union, so whatever a path meets stays visible; a loss is better than another
if it is a part of it, and losses that are parts of neither stand side by side.  A fixpoint keeps the undominated losses of every pair;
sets of few modes, so a pair has few of them, however many paths there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.incremental import set_hash
from claimloom.sources.scratch import dropped, written

#: Bits of the modes (fixed values); a label that is none of these is a mode without a known composition.
MODES = {"widening": 1, "narrowing": 2, "saturating": 4, "wrapping": 8, "open": 16}


def mode(label: Column) -> Column:
    """The bits of a label; ``none`` has none, an unknown one counts as open."""
    out = F.when(label == "none", 0)
    for name, bit in MODES.items():
        out = out.when(label == name, bit)
    return out.otherwise(MODES["open"])


def label(bits: Column) -> Column:
    """The composed label: what clamps or wraps stays visible, both or an open mode make a compound."""
    has = lambda *names: bits.bitwiseAND(F.lit(sum(MODES[n] for n in names))) != 0
    out = F.when(has("open"), "compound:open").when(has("saturating") & has("wrapping"), "compound:saturating+wrapping")
    for name in ("wrapping", "saturating", "narrowing", "widening"):
        out = out.when(has(name), name)
    return out.otherwise("none")


def _undominated(sets: Column) -> Column:
    sets = F.array_distinct(sets)
    return F.filter(sets, lambda x: ~F.exists(sets, lambda y: (x.bitwiseAND(y) == y) & (x != y)))


def least_losses(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, target, bits``: for each of ``sources`` (``source``) and each sort reached by ``edges`` (``a, b, bits``) in one step or more, the undominated losses.

    A round follows only labels that the last one found.  Edges with a null end lead nowhere.  Sources with the same ways out reach
    the same, so one of them walks for all that are alike; they are told apart by a hash of their ways.
    """
    ways = edges.filter("a is not null and b is not null").groupBy("a", "b").agg(F.collect_set("bits").alias("ways"))
    ways = written(ways.select("a", "b", F.explode(_undominated(F.col("ways"))).alias("way")).repartition("a"), "ways")
    start = sources.select("source").distinct()
    alike = written(set_hash(start.join(ways, F.col("source") == F.col("a")), ["source"], F.to_json(F.struct("b", "way"))), "alike")
    first = alike.groupBy("evidence").agg(F.min("source").alias("first"))
    members = written(alike.join(first, "evidence").select(F.col("source").alias("member"), "first"), "members")
    start = members.select(F.col("first").alias("source")).distinct()
    found = None
    new = start.select("source", F.col("source").alias("target"), F.lit(0).alias("bits"))
    while True:
        come = new.join(ways, F.col("target") == F.col("a")).select("source", F.col("b").alias("target"), F.col("bits").bitwiseOR(F.col("way")).alias("bits"))
        come = come.groupBy("source", "target").agg(F.collect_set("bits").alias("come"))
        both = come.withColumn("held", F.array().cast("array<int>")) if found is None else come.join(found, ["source", "target"], "full_outer").withColumns({"come": F.coalesce("come", F.array().cast("array<int>")), "held": F.coalesce("held", F.array().cast("array<int>"))})
        now = both.select("source", "target", "held", _undominated(F.concat("held", "come")).alias("best"))
        now = written(now.select("source", "target", F.col("best").alias("held"), F.array_except("best", "held").alias("new")), "losses")
        if found is not None:
            dropped(last)
        last, found = now, now.select("source", "target", "held")
        new = now.select("source", "target", F.explode("new").alias("bits"))
        if new.isEmpty():
            found = found.select(F.col("source").alias("first"), "target", F.explode("held").alias("bits"))
            return members.join(found, "first").select(F.col("member").alias("source"), "target", "bits")
