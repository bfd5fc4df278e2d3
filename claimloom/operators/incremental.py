"""Recomputation of derived values after a change, and of nothing else: a content-addressed cache over a table of dependencies.

Nodes stand in levels; a node's value is what its level's rule makes of its inputs (sources or nodes of lower levels).  A
result is kept under the node and its *evidence*: the hash of all its inputs with the content ids that they had.  After a
change the reverse edges of changed ids give the candidates of the next level; a candidate whose evidence is in the cache is
a hit, others are recomputed, and where the new value has the old id nothing behind it is touched (early cut-off).

A rule sees only the inputs that its evidence names, so wrong dependencies change the key and can only miss.  A node whose
rule reads more than its dependencies say is marked ``complete = false``: its evidence is then the coarse one, of all
sources, so any change of a source is a miss.  Values are texts, null for none; a node without any present input has no
value and is gone; inputs that are gone count as gone in the evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources.scratch import folder, written

Rule = Callable[[DataFrame], DataFrame]


#: Characters up to which a text is its own content id, marked so that it is no other text's.
SHORT = 40
#: Words of 32 bits in the hash of a set.
WORDS = 5
#: Commits after which the cache's parts become one table.
GATHER = 8


def short(text: Column) -> Column:
    """A text that is short as it is, another one as its hash; two texts never have one id."""
    return F.when(F.length(text) <= SHORT, F.concat(F.lit("="), text)).otherwise(F.sha2(text, 256))


def content_id(value: Column) -> Column:
    return F.when(value.isNull(), "null").otherwise(short(value))


def set_hash(rows: DataFrame, key: list[str], item: Column) -> DataFrame:
    """``key, evidence``: the hash of each key's items in any order: the sums of the words of their hashes, and their number.

    Sums are taken where the rows lie, so a large key meets as a row a task.
    """
    # eight hexadecimal digits are a word of 32 bits, of which a long holds the sum of two thousand million
    h = rows.select(*key, F.sha2(short(item), 256).alias("h"))
    words = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(WORDS)]
    sums = h.groupBy(*key).agg(F.count("*").alias("n"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)])
    return sums.filter("n > 0").select(*key, F.sha2(F.concat_ws(",", "n", *[f"w{i}" for i in range(WORDS)]), 256).alias("evidence"))


class Workspace:
    """Values of the last commit and all results ever cached, below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or folder(spark, "workspace")
        self.values = spark.createDataFrame([], "level int, id string, value string, cid string")
        self.deps = spark.createDataFrame([], "node string, level int, input string, complete boolean")
        self.cache = spark.createDataFrame([], "key string, value string")
        self.generation = 0

    def _key(self, candidates: DataFrame, items: DataFrame, context: DataFrame) -> DataFrame:
        """Candidates (``node, complete``) with the key of their evidence."""
        said = set_hash(items.filter("complete"), ["node"], F.concat_ws("\x1f", "input", F.coalesce("cid", F.lit("gone"))))
        out = candidates.join(said, "node", "left").crossJoin(F.broadcast(context))  # one row: the context of all sources
        return out.select("node", F.sha2(F.concat_ws("\x1f", "node", F.when(F.col("complete"), F.col("evidence")).otherwise(F.concat(F.lit("all:"), "context"))), 256).alias("key"))

    def refresh(self, sources: DataFrame, deps: DataFrame, rules: dict[int, Rule], commit: bool = True) -> DataFrame:
        """``level, id, value, status`` of all nodes over ``sources`` (``id, value``) and ``deps`` (``node, level, input, complete``); levels count from 1.

        ``status`` is ``kept`` (no input changed), ``hit`` (found in the cache) or ``recomputed``.  Without ``commit``
        (an edit buffer that is only tried) the workspace stays as it was.
        """
        gen = f"g{self.generation + 1}"
        src = sources.select(F.lit(0).alias("level"), "id", "value", content_id(F.col("value")).alias("cid"))
        now = written(src, f"{gen}-sources")
        deps = deps.select("node", "level", "input", F.coalesce("complete", F.lit(False)).alias("complete"))
        # both sides meet once: each row with where it stands, the old ones too
        sides = deps.withColumn("side", F.lit(1)).unionByName(self.deps.withColumn("side", F.lit(2)))
        sides = written(sides.groupBy("node", "level", "input", "complete").agg(F.bit_or("side").alias("side")), f"{gen}-deps")
        deps = sides.filter("side <> 2").drop("side")
        context = written(set_hash(now, [], F.concat_ws("\x1f", "id", "cid")).select(F.col("evidence").alias("context")), f"{gen}-context") if now.take(1) else self.spark.sql("SELECT '' AS context")
        later = self.generation > 0  # before the first commit all is new, and nothing has to be looked for
        if later:
            moved = self._moved(now, self.values.filter("level = 0"))
            rewired = written(sides.filter("side <> 3").select("node").distinct(), f"{gen}-rewired")
            any_moved = bool(moved.take(1))
        made, cached = [], self.cache
        for level in sorted(rules):
            mine = deps.filter(F.col("level") == level)
            nodes = mine.groupBy("node").agg(F.bool_and("complete").alias("complete"))
            old = self.values.filter(F.col("level") == level)
            if not later:
                candidates, read = nodes, mine
            else:
                touched = mine.join(moved.select(F.col("id").alias("input")), "input", "left_semi").select("node").unionByName(rewired)
                if any_moved:
                    touched = touched.unionByName(nodes.filter("not complete").select("node"))
                candidates = written(nodes.join(touched.distinct(), "node", "left_semi"), f"{gen}-candidates")
                read = mine.join(candidates.select("node"), "node", "left_semi")
            # what candidates read meets its values once, for the evidence and for the rule
            items = written(read.join(now.select(F.col("id").alias("input"), "cid", "value"), "input", "left").select("node", "input", "complete", "cid", "value"), f"{gen}-items")
            keys = self._key(candidates, items, context).join(cached.withColumn("status", F.lit("hit")), "key", "left")
            keys = written(keys, f"{gen}-keys")
            hits, misses = keys.filter("status is not null"), keys.filter("status is null").select("node", "key")
            inputs = items.filter("cid is not null")
            if later or made:
                inputs = inputs.join(misses.select("node"), "node", "left_semi")
            inputs = inputs.select("node", "input", "value")
            got = rules[level](inputs).select("node", F.col("value").cast("string").alias("value"))
            # a node without inputs has no row here, and no value
            fresh = written(hits.select("node", "key", "value", "status").unionByName(misses.join(got, "node").select("node", "key", "value", F.lit("recomputed").alias("status"))), f"{gen}-fresh")
            kept = old.join(nodes.select(F.col("node").alias("id")), "id", "left_semi").join(keys.select(F.col("node").alias("id")), "id", "left_anti")
            rows = kept.select("level", "id", "value", "cid", F.lit("kept").alias("status")).unionByName(fresh.select(F.lit(level).alias("level"), F.col("node").alias("id"), "value", content_id(F.col("value")).alias("cid"), "status"))
            rows = written(rows, f"{gen}-level")
            cached = cached.unionByName(fresh.filter("status = 'recomputed'").select("key", "value"))
            if later:
                moved = moved.unionByName(self._moved(rows.drop("status"), old))
            now = now.unionByName(rows.drop("status"))
            made.append(rows)
        if commit:
            # all parts are written already; the cache's, which grow in number, are put together now and then
            self.values, self.deps, self.generation = now, deps, self.generation + 1
            self.cache = cached if self.generation % GATHER else written(cached, "cache")
        out = made[0]
        for rows in made[1:]:
            out = out.unionByName(rows)
        return out.select("level", "id", "value", "status")

    def _moved(self, now: DataFrame, old: DataFrame) -> DataFrame:
        """Ids whose content is another one than before, or that came or went."""
        both = now.select("id", F.col("cid").alias("_now")).join(old.select("id", F.col("cid").alias("_old")), "id", "full_outer")
        return written(both.filter(~F.col("_now").eqNullSafe(F.col("_old"))).select("id"), "moved")
