"""Directed graphs as tables: strongly connected components without a closure, and interval labels of trees.

All steps keep as many rows as there are edges (or nodes); pointers are followed by doubling, so a chain or ring of n nodes
takes log n joins and not n.  Each step's table is written to the shared folder and read again.  Joins of steps are merges by hint: a
step's table is often small enough to be broadcast, but a hundred steps would send all of theirs through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sources.scratch import dropped, written


class _Chains:
    """Nodes with one way on, contracted to where their chain ends.

    ``links`` (``a, b``, no loops).  A chain node has one successor; ``hop`` has the 1st, 2nd, 4th ... of all, up to the chain's end.
    """

    def __init__(self, links: DataFrame):
        ways = links.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("to")).filter("n = 1").select("a", "to")
        inside = ways.select(F.col("a").alias("to"), F.lit(True).alias("on"))
        now = written(ways.hint("merge").join(inside, "to", "left").select("a", "to", F.coalesce("on", F.lit(False)).alias("on"), F.least("a", "to").alias("low")), "chains")
        self.hops, size, n = [now], 1, now.count()
        self.any = n > 0
        # one that goes on after n steps goes round
        while size < n and not now.filter("on").isEmpty():
            there = now.select(F.col("a").alias("to"), F.col("to").alias("next"), F.col("on").alias("more"), F.col("low").alias("low_"))
            step = now.hint("merge").join(there, "to", "left").select("a", F.coalesce("next", "to").alias("to"), F.coalesce("more", F.lit(False)).alias("on"), F.least("low", "low_").alias("low"))
            now, size = written(step, "chains"), 2 * size
            self.hops.append(now)
        self.ends = now.filter("not on").select("a", "to")
        turning = now.filter("on")
        # after n steps all are on their ring, and every node of a ring is where another one is
        ring = turning.select(F.col("to").alias("a")).distinct()
        self.rings = written(turning.hint("merge").join(ring, "a").select(F.col("a").alias("node"), F.col("low").alias("component")), "rings")
        self.entries = written(links.hint("merge").join(now.select("a"), "a", "left_anti").hint("merge").join(self.ends.select(F.col("a").alias("b"), F.col("to").alias("end")), "b").select(F.col("a").alias("u"), F.col("b").alias("v"), "end"), "entries")
        # what is no chain stays, with the chains' ends in their place; what leads to rings only is no part of a larger component
        plain = links.hint("merge").join(now.select("a"), "a", "left_anti").hint("merge").join(now.select(F.col("a").alias("b")), "b", "left_anti")
        self.left = written(plain.select("a", "b").unionByName(self.entries.select(F.col("u").alias("a"), F.col("end").alias("b"))).distinct(), "contracted")

    def expanded(self, found: DataFrame) -> DataFrame:
        """``found`` (``node, component``) with the chain nodes that lie between two nodes of one component."""
        u, end = found.select(F.col("node").alias("u"), F.col("component").alias("cu")), found.select(F.col("node").alias("end"), F.col("component").alias("ce"))
        marked = self.entries.hint("merge").join(u, "u").hint("merge").join(end, "end").filter("cu = ce").select(F.col("v").alias("node"), F.col("ce").alias("component")).distinct()
        for hop in reversed(self.hops):
            on = marked.hint("merge").join(hop.select(F.col("a").alias("node"), "to"), "node").select(F.col("to").alias("node"), "component")
            on = on.hint("merge").join(self.ends.select(F.col("a").alias("node")), "node", "left_semi")
            marked = written(marked.unionByName(on).distinct(), "marked")
        return found.unionByName(marked)

    def drop(self) -> None:
        dropped(*self.hops, self.rings, self.entries)


def _trimmed(links: DataFrame) -> DataFrame:
    """Links between nodes that have a way in and a way out."""
    return links.hint("merge").join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").hint("merge").join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")


def _coloured(links: DataFrame) -> DataFrame:
    """``node, component`` of the components of two nodes or more: colours forward, then back from the nodes that kept their own."""
    out = links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    while not links.isEmpty():
        colour = written(links.select("a").union(links.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("colour")), "colours")
        front = colour
        while not front.isEmpty():
            come = links.hint("merge").join(front.select(F.col("node").alias("a"), "colour"), "a").groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("new"))
            front = written(colour.hint("merge").join(come, "node").filter("new < colour").select("node", F.col("new").alias("colour")), "colours-new")
            colour = written(colour.hint("merge").join(front.select("node", F.col("colour").alias("new")), "node", "left").select("node", F.coalesce("new", "colour").alias("colour")), "colours")
        same = links.hint("merge").join(colour.select(F.col("node").alias("a"), F.col("colour").alias("ca")), "a").hint("merge").join(colour.select(F.col("node").alias("b"), F.col("colour").alias("cb")), "b").filter("ca = cb").select("a", "b", "ca")
        same = written(same, "one-colour")
        front = found = written(colour.filter("node = colour"), "reached")
        while not front.isEmpty():
            back = same.hint("merge").join(front.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node"), F.col("ca").alias("colour")).distinct()
            front = written(back.hint("merge").join(found.select("node"), "node", "left_anti"), "reached-new")
            found = written(found.unionByName(front), "reached")
        large = found.groupBy("colour").agg(F.count("*").alias("n")).filter("n > 1").select("colour")
        out = out.unionByName(found.hint("merge").join(large, "colour").select("node", F.col("colour").alias("component")))
        rest = links.hint("merge").join(found.select(F.col("node").alias("a")), "a", "left_anti").hint("merge").join(found.select(F.col("node").alias("b")), "b", "left_anti")
        links = written(_trimmed(rest), "rest")
    return out


def components(links: DataFrame, source: str, target: str) -> DataFrame:
    """``node, component`` (its least node) of all nodes on a cycle; a node alone is one only with a link to itself.

    Chains are contracted from both ends until none is left, which takes a logarithm of their length; the core, whose nodes all
    have two ways in and out, is coloured, in as many rounds as its paths are long.  Links with a null end are no links.
    """
    links = written(links.select(F.col(source).alias("a"), F.col(target).alias("b")).filter("a is not null and b is not null").distinct(), "links")
    loops = links.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    live, frames, idle, rings = written(_trimmed(links.filter("a <> b")), "links"), [], 0, loops.limit(0)
    selves = loops.limit(0)
    while idle < 2 and not live.isEmpty():
        chains = _Chains(live)
        if chains.any:
            frames.append(chains)
            rings = rings.unionByName(chains.rings)
            # a link to itself is a cycle through chains
            selves = selves.unionByName(chains.left.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")))
            live = written(_trimmed(chains.left.filter("a <> b")), "links")
        idle = 0 if chains.any else idle + 1
        live = live.select(F.col("b").alias("a"), F.col("a").alias("b"))  # the other way round: nodes with one way in
    found = written(_coloured(live).unionByName(rings), "found")
    found = written(found.unionByName(selves.distinct().hint("merge").join(found.select("node"), "node", "left_anti")), "found")
    for chains in reversed(frames):
        found = written(chains.expanded(found).dropDuplicates(["node"]), "found")
        chains.drop()
    found = found.unionByName(loops.hint("merge").join(found.select("node"), "node", "left_anti"))
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.hint("merge").join(least, "component").select("node", F.col("least").alias("component"))


def intervals(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, first, last, depth``: numbers of a walk down the forest, children by id; a node encloses those whose ``first`` lies in its ``first .. last``.

    The walk enters and leaves every node once; each of these steps knows the next one, and sums of what is still to come are
    taken by doubling.  A null or unknown parent makes a root.  Nodes on a cycle of parents, or below one, have null labels.
    """
    from claimloom.operators.census import positions

    known = tree.select(F.col(node).alias("v")).distinct()
    rows = tree.select(F.col(node).alias("v"), F.col(parent).alias("u")).groupBy("v").agg(F.min("u").alias("u"))
    rows = rows.hint("merge").join(known.select(F.col("v").alias("u"), F.lit(True).alias("_in")), "u", "left").select("v", F.when(F.col("_in"), F.col("u")).alias("u"))
    # brothers stand side by side in order of (parent, id); no parent's children meet in one task
    rows = written(positions(rows, F.col("u").asc_nulls_first(), "v", out="at"), "forest")
    right = rows.select(F.col("u").alias("u_"), F.col("v").alias("brother"), (F.col("at") - 1).alias("at"))
    eldest = rows.filter("u is not null").groupBy(F.col("u").alias("v")).agg(F.min("v").alias("child"))
    shape = rows.hint("merge").join(right, "at", "left").withColumn("brother", F.when(F.col("u").eqNullSafe(F.col("u_")), F.col("brother"))).hint("merge").join(eldest, "v", "left")
    step = lambda v, up: F.struct(v.alias("v"), F.lit(up).alias("up"))
    enter = F.coalesce(F.when(F.col("child").isNotNull(), step(F.col("child"), False)), step(F.col("v"), True))
    leave = F.coalesce(F.when(F.col("brother").isNotNull(), step(F.col("brother"), False)), F.when(F.col("u").isNotNull(), step(F.col("u"), True)))
    both = F.array(F.struct(F.lit(False).alias("up"), enter.alias("to"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("d")), F.struct(F.lit(True).alias("up"), leave.alias("to"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d")))
    walk = written(shape.select("v", F.inline(both)), "walk")
    size, steps = 1, 2 * rows.count()
    while size < 2 * steps and not walk.filter("to is not null").isEmpty():
        there = walk.select(F.struct("v", "up").alias("to"), F.col("to").alias("next"), F.col("n").alias("n_"), F.col("d").alias("d_"))
        more = walk.hint("merge").join(there, "to", "left")
        last, walk = walk, written(more.select("v", "up", F.col("next").alias("to"), (F.col("n") + F.coalesce("n_", F.lit(0))).alias("n"), (F.col("d") + F.coalesce("d_", F.lit(0))).alias("d")), "walk")
        dropped(last)
        size *= 2
    ends = walk.groupBy("v").agg(F.max(F.when(~F.col("up"), F.col("n"))).alias("here"), F.max(F.when(F.col("up"), F.col("n"))).alias("behind"), F.max(F.when(~F.col("up"), F.col("d"))).alias("d"), F.bool_or(F.col("to").isNotNull()).alias("lost"))
    # what goes round never ends, and is not among the steps that a walk from the roots takes
    first = F.lit(ends.filter("not lost").count()) - F.col("here")
    label = lambda c, name: F.when(~F.col("lost"), c).alias(name)
    return ends.select(F.col("v").alias("node"), label(first, "first"), label(first + F.col("here") - F.col("behind") - 1, "last"), label(-F.col("d"), "depth"))


def encloses(pairs: DataFrame, labels: DataFrame, outer: str, inner: str) -> DataFrame:
    """``pairs`` with ``encloses``: whether ``outer`` is a proper ancestor of ``inner``; null where one of them has no label."""
    o = labels.select(F.col("node").alias(outer), F.col("first").alias("_a"), F.col("last").alias("_b"))
    i = labels.select(F.col("node").alias(inner), F.col("first").alias("_x"))
    out = pairs.join(o, outer, "left").join(i, inner, "left")
    return out.withColumn("encloses", (F.col("_a") < F.col("_x")) & (F.col("_x") <= F.col("_b"))).select(*pairs.columns, "encloses")
