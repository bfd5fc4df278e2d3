"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample (``SAMPLE`` vectors); every vector is put
into one leaf of each tree.  A query's walk keeps one priority queue for all
trees, ordered by the sum of the margins of the splits that were crossed on the way, and visits
leaves until they hold ``VISITS / sqrt(depth)`` times as many vectors as there are (a vector counts once for each
tree that it is met in; deeper trees order their leaves better).  The vectors of visited leaves are ranked exactly, in double precision, leaf by leaf.
The rule is the same at every size.

Rows are numbered in order of id.  Equal vectors are one point with the ``top + 1`` first of its rows: no more of them can be
among ``top`` results, as ties go to the smaller id.  So a very common vector loads no leaf.  Components stay what they are,
float or double; products are taken in double precision.

Null, zero or non-finite vectors, and those with a null or non-finite component, take no part, and neither do null
ids.  A vector that is shorter than the longest one counts as padded with zeros.  Every row is a candidate and, where its id
says so, a query, repeated rows and several vectors of one id too; only a row itself is not its own neighbour.  Ties in score go to the smaller id.
Very long vectors only cost memory in proportion.  An empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.store import small_batches, stored
from claimloom.llm.textcore import mix64

TREES = 8
SAMPLE = 16_384
#: Vectors that a leaf has, about, and sample vectors that it has at least.
LEAF, SAMPLE_LEAF = 32, 8
#: Vectors that a query meets in leaves, by the number of all vectors, times the root of the trees' depth (see the README for the recall at this value).
VISITS = 2.8
TOP = 20
#: Candidates that a bin gathers before it drops all but each query's best.
GATHERED = 200_000
BINS, BIN_ROWS = 48, 50_000


class Forest:
    """Balanced trees of equal depth: node i has children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, self.trees, inner = depth, trees, (1 << depth) - 1
        # vectors of doubles may not fit in floats
        self.normal = rng.standard_normal((trees, inner, sample.shape[1])).astype(sample.dtype)
        self.normal /= np.linalg.norm(self.normal, axis=2, keepdims=True)
        self.split = np.zeros((trees, inner), sample.dtype)
        for t in range(trees):
            groups = {0: np.arange(len(sample))}
            for node in range(inner):
                at = groups.pop(node)
                x = sample[at] @ self.normal[t, node]
                self.split[t, node] = m = np.median(x) if len(x) else 0.0
                groups[2 * node + 1], groups[2 * node + 2] = at[x < m], at[x >= m]

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree (vectors x trees)."""
        out = np.zeros((len(v), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(v), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", v, self.normal[t, node]) >= self.split[t, node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def walk(self, v: np.ndarray, sizes: np.ndarray, budget: float) -> list[int]:
        """Cells (tree * leaves + leaf) that one query visits; sizes: vectors of each cell."""
        margin = np.nan_to_num((self.normal.reshape(-1, self.normal.shape[2]) @ v).reshape(self.split.shape) - self.split)
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        margins = margin.tolist()
        heap = [(0.0, t, 0) for t in range(self.trees)]
        heapq.heapify(heap)
        got, out = 0, []
        while heap and got < budget:
            p, t, node = heapq.heappop(heap)
            while node < inner:
                m = margins[t][node]
                near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(heap, (p + abs(m), t, far))
                node = near
            cell = t * leaves + node - inner
            if sizes[cell]:
                out.append(cell)
                got += int(sizes[cell])
        return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _bin(cells: np.ndarray, bins: int, depth: int) -> np.ndarray:
    """A bin holds cells of one tree only, so no vector twice; ``bins`` is a multiple of ``TREES``."""
    each = np.uint64(bins // TREES)
    return (cells >> depth) * (bins // TREES) + (mix64(cells.astype(np.uint64)) % each).astype(np.int64)


def _assign(forest, bins: int):
    def run(batches):
        f = forest.value
        for b in batches:
            v = _matrix(b.column(1))
            if not len(v):
                continue
            cells = (f.leaves(v) + (np.arange(f.trees) << f.depth)).ravel()
            at = pa.array(np.repeat(np.arange(len(v)), f.trees))
            yield pa.record_batch([pa.array(_bin(cells, bins, f.depth)), pa.array(cells), b.column(0).take(at), b.column(1).take(at)], names=["bin", "cell", "pid", "v"])

    return run


def _walk(forest, sizes, budget, bins: int):
    """One row per query and bin, with the vector and the cells that the query visits there."""

    def run(batches):
        for b in batches:
            v = _matrix(b.column(1))
            if not len(v):
                continue
            cells = [np.array(forest.value.walk(x, sizes.value, budget), np.int64) for x in v]
            owner, flat = np.repeat(np.arange(len(v)), [len(c) for c in cells]), np.concatenate(cells)
            where = _bin(flat, bins, forest.value.depth)
            order = np.lexsort((where, owner))
            owner, flat, where = owner[order], flat[order], where[order]
            new = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(where) != 0))[: len(flat)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(flat)).astype(np.int32)), pa.array(flat))
            at = pa.array(owner[new])
            yield pa.record_batch([pa.array(where[new]), lists, b.column(0).take(at), b.column(1).take(at)], names=["bin", "cells", "qid", "v"])

    return run


def _rank(top: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", pa.int64()), ("pid", pa.int64()), ("score", pa.float64())])
        if not len(points) or not len(queries):
            return schema.empty_table()
        p, pid, pc = _matrix(points.column("v")).astype(np.float64), points.column("pid").to_numpy(), points.column("cell").to_numpy()
        q, qid, cells = _matrix(queries.column("v")).astype(np.float64), queries.column("qid").to_numpy(), queries.column("cells").combine_chunks()
        asks, qc = np.repeat(np.arange(len(q)), np.diff(cells.offsets.to_numpy())), cells.flatten().to_numpy()
        order, ask = np.lexsort((pid, pc)), np.argsort(qc, kind="stable")
        p, pid, pc, asks, qc = p[order], pid[order], pc[order], asks[ask], qc[ask]
        floor, held, n = np.full(len(q), -np.inf), [], 0

        def best() -> tuple:
            """Each query's best so far; what is below them need not be gathered."""
            who, what, score = (np.concatenate(x) for x in zip(*held))
            o = np.lexsort((what, -score, who))
            who, what, score = who[o], what[o], score[o]
            nth = np.arange(len(who)) - np.searchsorted(who, who)
            floor[who[nth == top]] = score[nth == top]
            return who[nth <= top], what[nth <= top], score[nth <= top]

        for c in np.unique(qc):
            lo, hi = np.searchsorted(pc, [c, c + 1])
            a, b = np.searchsorted(qc, [c, c + 1])
            for i in range(a, b if hi > lo else a, 256):
                ask = asks[i : min(i + 256, b)]
                s = q[ask] @ p[lo:hi].T
                x, y = np.nonzero(s >= floor[ask][:, None])
                held.append((ask[x], pid[lo + y], s[x, y]))
                n += len(x)
            if n > GATHERED:
                held = [best()]
                n = 0
        if not held:
            return schema.empty_table()
        who, what, score = best()
        return pa.table([pa.array(qid[who]), pa.array(what), pa.array(score)], schema=schema)

    return run


def neighbours(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", query_every: int = 20, top: int = TOP, visits: float = VISITS) -> DataFrame:
    """``query_id, rank, id, score``: of rows whose id is divisible by ``query_every``, the nearest others."""
    spark = table.sparkSession
    small_batches(spark)
    part = "double" if isinstance(table.schema[vector].dataType.elementType, T.DoubleType) else "float"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(f"array<{part}>").alias("v")).filter("id is not null and v is not null")
    rows = rows.filter(f"forall(v, x -> x is not null and not isnan(x) and abs(x) < cast('infinity' as {part})) and exists(v, x -> x <> 0)")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    # -0 and 0 are one component, so that equal vectors hash alike
    rows = rows.withColumn("v", F.transform(F.concat("v", F.array_repeat(F.lit(0.0).cast(part), F.lit(width) - F.size("v"))), lambda x: F.when(x == 0, F.lit(0.0).cast(part)).otherwise(x)))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.reverse("v"))})
    # the numbers are in order of id, over partitions too; rows of one id are spread by their vector
    rows = rows.repartitionByRange("id", "h1", "h2").sortWithinPartitions("id", "h1", "h2").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "ann-rows")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("row"))).filter(F.col("_n") <= top + 1)
    points = stored(first.groupBy("h1", "h2").agg(F.min("row").alias("pid"), F.array_sort(F.collect_list(F.struct("row", "id"))).alias("ids"), F.first("v").alias("v")), "ann-points")
    asking = stored(rows.filter(F.col("id") % query_every == 0).select(F.col("id").alias("query_id"), F.col("row").alias("query_row"), "h1", "h2").join(points.select("h1", "h2", F.col("pid").alias("qid")), ["h1", "h2"]).select("query_id", "query_row", "qid"), "ann-queries")
    n = points.count()
    sample = points.select("v", F.xxhash64("h1", "h2").alias("o")).orderBy("o", "pid").limit(SAMPLE).collect()
    depth = max(0, min(int(math.log2(max(1, n / LEAF))), int(math.log2(max(1, len(sample) / SAMPLE_LEAF)))))
    forest = spark.sparkContext.broadcast(Forest(np.array([r["v"] for r in sample], np.float64 if part == "double" else np.float32).reshape(len(sample), len(sample[0]["v"]) if sample else 1), depth))
    # cells are ranked in bins, each of which gives a query's best once: at least BINS, and BIN_ROWS vectors in each, about
    bins = TREES * max(BINS // TREES, -(-n // BIN_ROWS))
    cells = stored(points.select("pid", "v").mapInArrow(_assign(forest, bins), f"bin long, cell long, pid long, v array<{part}>"), "ann-cells")
    counts = np.zeros(TREES << depth, np.int64)
    for r in cells.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ask = points.select("pid", "v").join(asking.select(F.col("qid").alias("pid")).distinct(), "pid", "left_semi").repartition(parts, "pid")
    walks = ask.mapInArrow(_walk(forest, spark.sparkContext.broadcast(counts), visits / math.sqrt(max(1, depth)) * n, bins), f"bin long, cells array<long>, qid long, v array<{part}>")
    found = cells.groupBy("bin").cogroup(walks.groupBy("bin")).applyInArrow(_rank(top), "qid long, pid long, score double")
    found = found.groupBy("qid", "pid").agg(F.max("score").alias("score"))
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pid"))).filter(F.col("_n") <= top + 1)
    found = found.join(points.select("pid", "ids"), "pid").select("qid", "score", F.inline("ids"))
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "row"))).filter(F.col("_n") <= top + 1)
    # a query of a point of more than top + 1 equal rows need not be among them: then the first top are its neighbours
    out = asking.join(found.select("qid", "row", "id", "score"), "qid").filter("row <> query_row")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "row"))).filter(F.col("rank") <= top)
    return out.select("query_id", "rank", "id", "score")


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
