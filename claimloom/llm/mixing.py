"""Mixing sources to target weights by weighted fair queueing, DataFrame operations only.

Each source is a queue of its documents in a shuffled order, read up to ``max_repeats`` times: whole readings as long as
its target holds one, then readings in part.  In these a document that would overshoot what is left of the target is passed
over while later ones fit (``ROUNDS`` times along the queue, each over those that still fit), so a long document at the head
does not starve its source; at last the shortest may stand behind the target where that brings the source nearer to it.
A document's virtual finish time is the number of its source's words up to and with it, in this order, divided by the
source's target; the mix is the documents in order of finish time, cut off where the total reaches the budget,
which is the sum of all sizes.  :func:`mixed` range-sorts the mix by finish time.  :func:`planned` (and the query, whose rows have no order) finds
the same cut without sorting all entries: sums by slots of finish time, then an exact running total in the slot where the budget ends.

A round leaves less than the document that ended it, so what is missing shrinks from round to round, down to less than the
shortest document that may be read once more.

Null texts have size 0 and are never taken; a null source is one source, the last;
repeated rows are separate documents; ties in finish time are ordered by source, reading, shuffled key and id; a very long text is one document and only its word count moves (and its row, in :func:`mixed`); null ids and ids of any type pass;
the caller's columns, whatever their names, come back untouched; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.ranks import running_total, uniform_key
from claimloom.llm.store import stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Times that a queue is gone through, in each reading, for documents that still fit in its target.
ROUNDS = 2
SEED = "mix-1"
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``rank, weight, target`` to ``source, source_size`` (one row per source).

    Shares follow the weights; a source above ``max_repeats`` times its size gives
    the excess to the rest, by weight, until none is above.  That ends with
    ``min(cap, level * weight)`` for one level, found by sorting ``cap / weight``.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    t = t.withColumn("weight", F.get(w, F.col("rank") % len(weights))).withColumn("cap", F.col("source_size") * max_repeats)
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("open", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    t = t.withColumn("level", F.min(F.when(F.col("open") <= F.col("ratio"), F.struct("ratio", "rank", "open"))).over(everything)["open"])
    return t.select("source", "source_size", "rank", "weight", F.when(F.col("ratio") < F.col("level"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _queued(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """Rows (``_id, _size, _u, _source`` and others) with their source's figures and ``_upto``, the words of the source up to and with the row."""
    s = sources.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("rank").alias("_rank"), F.col("target").alias("_target"))
    rows = rows.join(s, F.expr("_source <=> _s")).drop("_s")
    return running_total(rows, ["_rank"], "_u", ["_id", "_size"], F.col("_size"), "_upto", n, spread=True)


def _parts(queued: DataFrame, repeats: int, rounds: int, n: int) -> DataFrame:
    """Documents of the partial readings: ``_k, _rank, _pass, _at`` (words of these readings up to and with the document)."""
    fits = F.col("_t") <= F.col("_rest") - F.col("_part")
    found = queued.select("_k", "_rank", F.col("_base").alias("_pass"), F.col("_size").alias("_at")).limit(0)
    for reading in range(repeats):
        part = found.groupBy("_rank").agg(F.max("_at").alias("_part"))
        open_ = queued.filter((F.col("_size") > 0) & (F.col("_base") + reading < repeats)).join(part, "_rank", "left").withColumn("_part", F.coalesce("_part", F.lit(0).cast("long")))
        open_ = open_.select("_k", "_rank", "_u", "_id", "_size", "_base", "_rest", "_part")
        for _ in range(rounds):
            now = stored(running_total(open_.filter(F.col("_size") <= F.col("_rest") - F.col("_part")), ["_rank"], "_u", ["_id", "_size"], F.col("_size"), "_t", n, spread=True), "mix-round")
            if now.isEmpty():
                break
            found = found.unionByName(now.filter(fits).select("_k", "_rank", (F.col("_base") + reading).alias("_pass"), (F.col("_part") + F.col("_t")).alias("_at")))
            more = now.filter(fits).groupBy("_rank").agg(F.max("_t").alias("_more"))
            open_ = now.filter(~fits).drop("_t").join(more, "_rank", "left").withColumn("_part", F.col("_part") + F.coalesce("_more", F.lit(0))).drop("_more")
        found = stored(found, "mix-parts")
    return found


def _entries(queued: DataFrame, parts: DataFrame, repeats: int) -> DataFrame:
    """One row per document and reading that may be taken, with its virtual finish time."""
    rows = queued.filter("_size > 0")
    whole = rows.filter("_base > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("_base") - 1))).withColumn("_done", F.col("_upto") + F.col("_pass") * F.col("_source_size"))
    part = rows.join(parts.drop("_rank"), "_k").withColumn("_done", F.col("_at") + F.col("_base") * F.col("_source_size")).drop("_at")
    # behind the target: the shortest document that may be read again, if it overshoots by less than is missing
    read = parts.groupBy("_k").agg(F.count("*").cast("int").alias("_read"))
    next_ = rows.join(read, "_k", "left").withColumn("_pass", F.col("_base") + F.coalesce("_read", F.lit(0))).filter(F.col("_pass") < repeats)
    next_ = next_.groupBy("_rank").agg(F.min(F.struct("_size", "_u", "_id", "_k", "_pass", "_base", "_rest", "_source_size", "_target")).alias("x")).select("_rank", "x.*")
    next_ = next_.join(parts.groupBy("_rank").agg(F.max("_at").alias("_part")), "_rank", "left").withColumn("_part", F.coalesce("_part", F.lit(0)))
    next_ = next_.filter(F.col("_size") < 2 * (F.col("_rest") - F.col("_part"))).withColumn("_done", F.col("_part") + F.col("_size") + F.col("_base") * F.col("_source_size"))
    names = ["_k", "_rank", "_pass", "_u", "_id", "_size", "_done", "_target"]
    out = whole.select(*names).unionByName(part.select(*names)).unionByName(next_.select(*names))
    return out.withColumn("_finish", F.col("_done") / F.col("_target")).select("_k", *_ORDER)


_ORDER = ["_finish", "_rank", "_pass", "_u", "_id", "_size"]


def _cut(entries: DataFrame, budget: int, n: int):
    """The last entry, in order of finish time, with which the total is within the budget: one row, or None."""
    slots = max(1, min(1 << 16, n // 1000))
    e = entries.withColumn("_slot", F.floor(F.col("_finish") * slots).cast("long"))
    sums = e.groupBy("_slot").agg(F.sum("_size").alias("s"))
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = sums.filter(F.col("before") < budget).orderBy(F.desc("_slot")).first()
    if last is None:
        return None
    inside = e.filter(F.col("_slot") == last["_slot"]).withColumn("_t", F.lit(last["before"]) + F.sum("_size").over(Window.partitionBy("_slot").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)))
    got = inside.filter(F.col("_t") <= budget).agg(F.max(F.struct(*_ORDER)).alias("m")).first()["m"]
    if got is not None:
        return got
    return e.filter(F.col("_slot") < last["_slot"]).agg(F.max(F.struct(*_ORDER)).alias("m")).first()["m"]


def planned(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", carry: bool = True, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, rounds: int = ROUNDS) -> DataFrame:
    """Per row ``_id, _size, _source_size, _target, _taken`` (finish times and readings with which the mix takes the row), and with ``carry`` the row itself as ``_row``."""
    added = {"_k": F.monotonically_increasing_id(), "_size": n_words(F.col(text)), "_u": uniform_key(F.col(id_col), F.lit(seed)), "_source": F.col(source), "_id": F.col(id_col)}
    whole = stored(docs.select(*([F.struct("*").alias("_row")] if carry else []), *[c.alias(k) for k, c in added.items()]), "mix-rows")
    small = whole.drop("_row")
    n = small.count()
    sources = stored(targets(small.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")), weights, max_repeats), "mix-sources")
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    base = F.coalesce(F.floor(F.col("_target") / F.when(F.col("_source_size") > 0, F.col("_source_size"))), F.lit(0)).cast("int")
    queued = _queued(small, sources, n).withColumn("_base", base).withColumn("_rest", F.col("_target") - F.col("_base") * F.col("_source_size"))
    queued = stored(queued, "mix-queues")
    entries = stored(_entries(queued, _parts(queued, max_repeats, rounds, n), max_repeats), "mix-entries")
    cut = _cut(entries, budget, n)
    if cut is None:
        taken = entries.limit(0)
    else:
        limit = F.struct(*[F.lit(cut[c]).cast(entries.schema[c].dataType).alias(c) for c in _ORDER])
        taken = entries.filter(F.struct(*_ORDER) <= limit)
    taken = taken.groupBy("_k").agg(F.collect_list(F.struct("_finish", "_pass")).alias("_taken"))
    rows = queued.join(taken, "_k", "left").withColumn("_taken", F.coalesce("_taken", F.array().cast(taken.schema["_taken"].dataType)))
    return rows.join(whole.select("_k", "_row"), "_k") if carry else rows


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, as often as taken, in order of virtual finish time."""
    rows = planned(docs, **options).withColumn("_one", F.explode("_taken")).select("*", "_one.*")
    return rows.orderBy(*_ORDER).select("_row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    rows = planned(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=False)
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.size("_taken") * F.col("_size")).cast("long").alias("taken"))


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix-1'), 1, 15))::BIGINT AS u FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + rk % 3] AS w, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, cap / w AS ratio FROM s1),
s3 AS (SELECT *, ((SELECT sum(source_size) FROM s2) - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2),
s4 AS (SELECT (SELECT lvl FROM s3 WHERE lvl <= ratio ORDER BY ratio, rk LIMIT 1) AS l),
s AS (SELECT source, source_size, rk, CASE WHEN ratio < l THEN cap::DOUBLE ELSE l * w END AS target FROM s3, s4),
q AS (SELECT d.*, s.rk, s.source_size, s.target, CASE WHEN s.source_size > 0 THEN floor(s.target / s.source_size) ELSE 0 END::BIGINT AS base,
             sum(size) OVER (PARTITION BY s.rk ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
n AS (SELECT NULL::BIGINT AS k, NULL::BIGINT AS rk, NULL::BIGINT AS p, NULL::BIGINT AS done WHERE false),
""" + "".join(
    f"""o{p}_0 AS (SELECT k, rk, u, doc_id, size, base, target - base * source_size AS rest, coalesce(part, 0) AS part
        FROM q LEFT JOIN (SELECT rk, max(done) AS part FROM {f"a{p - 1}" if p else "n"} GROUP BY rk) USING (rk) WHERE size > 0 AND base + {p} < {MAX_REPEATS}),
"""
    + "".join(
        f"""c{p}_{r} AS (SELECT *, sum(size) OVER (PARTITION BY rk ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS t FROM o{p}_{r} WHERE size <= rest - part),
o{p}_{r + 1} AS (SELECT k, rk, u, doc_id, size, base, rest, part + m AS part FROM (SELECT *, coalesce(max(CASE WHEN t <= rest - part THEN t END) OVER (PARTITION BY rk), 0) AS m FROM c{p}_{r}) WHERE t > rest - part),
"""
        for r in range(ROUNDS)
    )
    + f"a{p} AS (SELECT * FROM {f'a{p - 1}' if p else 'n'}"
    + "".join(f" UNION ALL SELECT k, rk, base + {p}, part + t FROM c{p}_{r} WHERE t <= rest - part" for r in range(ROUNDS))
    + "),\n"
    for p in range(MAX_REPEATS)
) + f"""a AS (SELECT * FROM a{MAX_REPEATS - 1}),
b AS (SELECT q.*, base + coalesce(x.n, 0) AS p, target - base * source_size - coalesce(y.part, 0) AS missing, coalesce(y.part, 0) AS part
      FROM q LEFT JOIN (SELECT k, count(*) AS n FROM a GROUP BY k) x USING (k) LEFT JOIN (SELECT rk, max(done) AS part FROM a GROUP BY rk) y USING (rk)
      WHERE size > 0 AND base + coalesce(x.n, 0) < {MAX_REPEATS} QUALIFY row_number() OVER (PARTITION BY rk ORDER BY size, u, doc_id, k) = 1),
e AS (SELECT k, rk, p, u, doc_id, size, (upto + p * source_size) / target AS finish FROM (SELECT *, unnest(range(base)) AS p FROM q WHERE size > 0)
      UNION ALL SELECT k, q.rk, a.p, u, doc_id, size, (done + base * source_size) / target FROM a JOIN q USING (k)
      UNION ALL SELECT k, rk, p, u, doc_id, size, (part + size + base * source_size) / target FROM b WHERE size < 2 * missing),
t AS (SELECT *, sum(size) OVER (ORDER BY finish, rk, p, u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM e),
g AS (SELECT k, sum(size)::BIGINT AS taken FROM t WHERE total <= (SELECT sum(source_size) FROM s) GROUP BY k)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0)::BIGINT AS taken FROM q LEFT JOIN g USING (k)
"""
