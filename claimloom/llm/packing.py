"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is one queue of token ids, with a target weight (its own number of ids, or one that the caller
gives).  Every window takes from each queue its share by the targets; what a queue could not send in whole
grains stays its deficit and is carried to the next window.

The queues are dealt to blocks of about ``BLOCK_TOKENS``, and blocks are packed apart, so that no task sees more than one.
In the fluid schedule, in which every queue sends at its weight until it is empty, block b begins at time
``level(b)``; before that a queue has sent ``weight * level(b)`` ids, in whole grains.  The rest, below a grain, is the deficit that
the queue brings into the block: deficits go over blocks as over windows, without a sequential task.
The rest of a block below a full window goes into sequences of lengths that are powers of two, which need no padding.

Null texts count as empty and still give their end id; a null source is one queue; repeated rows are
packed apart, ties have no meaning here; a very long text is cut into blocks (its ids are one value of an Arrow batch, two bytes each); an
empty table gives no pieces; null ids and ids of any type pass; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.store import small_batches, stored
from claimloom.llm.tokens import byte_pairs

WINDOW = 1024
GRAIN = 64
BLOCK_TOKENS = 1 << 20
END_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part, chunk = byte_pairs(path), np.array([END_ID], np.uint16).tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            queue = batch.column(1).to_pylist()
            for a, ids, bound in enc.batch(batch.column(2)):
                n = len(bound) - 1
                sent: dict[str, int] = {}
                at, size, out = [], [], []
                for i in range(n):
                    k = int(bound[i + 1] - bound[i]) + 1
                    q = queue[a + i]
                    at.append(sent.get(q, 0))
                    sent[q] = at[-1] + k
                    size.append(k)
                    out.append(ids[bound[i] : bound[i + 1]].tobytes() + end)
                yield pa.record_batch([batch.column(0).slice(a, n), pa.array(queue[a : a + n], pa.string()), pa.array([part << 32 | chunk] * n, pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(out, pa.binary())], names=["id", "queue", "chunk", "at", "size", "ids"])
                chunk += 1

    return run


def window_sizes(total: int, window: int) -> list[int]:
    rest = total % window
    return [window] * (total // window) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def deal(counts: np.ndarray, sizes: list[int], grain: int, opening: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """Ids that each window takes from each queue, by deficit round-robin (windows x queues).

    ``opening``: deficits brought in; ``weights``: targets of the queues, those of empty ones going to the rest (by default their counts).
    """
    left = counts.astype(np.int64)
    deficit = np.zeros(len(counts)) if opening is None else opening.astype(np.float64).copy()
    weights = counts.astype(np.float64) if weights is None else weights
    take = np.zeros((len(sizes), len(counts)), np.int64)
    for w, room in enumerate(sizes):
        share = weights * (left > 0)
        deficit += share / share.sum() * room
        while room:
            q = int(np.argmax(np.where(left > 0, deficit, -np.inf)))
            k = min(grain, room, int(left[q]))
            take[w, q] += k
            left[q] -= k
            deficit[q] -= k
            room -= k
    return take


def _packer(window: int, grain: int, stride: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("queue", "ascending"), ("upto", "ascending")])
        ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), np.uint16).astype("<u4")
        size = t.column("part").to_numpy()
        _, head, queue = np.unique(np.array(t.column("queue").to_pylist(), dtype=object).astype(str), return_index=True, return_inverse=True)
        counts = np.bincount(queue, weights=size).astype(np.int64)
        sizes = window_sizes(int(size.sum()), window)
        take = deal(counts, sizes, grain, t.column("opening").to_numpy()[head], t.column("weight").to_numpy()[head])
        base = np.concatenate([[0], np.cumsum(counts)])[:-1]
        sent = np.cumsum(take, axis=0) - take + base  # where a window's share of a queue begins, in ids
        inside = np.cumsum(take, axis=1) - take  # and in the window
        some = np.flatnonzero(take.T.ravel() > 0)  # in order of queue, then window
        seg_at, seg_off, seg_w = sent.T.ravel()[some], inside.T.ravel()[some], some % max(1, len(sizes))
        doc_at = np.cumsum(size) - size
        at = np.union1d(seg_at, doc_at[size > 0])
        end = np.append(at[1:], len(ids))
        s, d = np.searchsorted(seg_at, at, "right") - 1, np.searchsorted(doc_at, at, "right") - 1
        view = memoryview(ids).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), end.tolist())]
        pick = lambda name: t.column(name).combine_chunks().take(pa.array(d))
        first = t.column("block")[0].as_py()
        return pa.table({"id": pick("id"), "start": pa.array(t.column("start").to_numpy()[d] + at - doc_at[d], pa.int64()), "length": pa.array(end - at, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pick("size"), "sequence_id": pa.array(first * stride + seg_w[s], pa.int64()), "offset": pa.array(seg_off[s] + at - seg_at[s], pa.int64()), "queue": pick("queue")})

    return run


def _schedule(sizes: dict[str, int], weights: dict[str, float]):
    """Of the fluid schedule: the ids sent by a time, and the time of that many ids (both as Columns)."""
    ends = sorted({sizes[q] / weights[q] for q in sizes})
    sent = lambda at: sum(min(sizes[q], weights[q] * at) for q in sizes)
    corners = [(0.0, 0.0), *((e, sent(e)) for e in ends)]

    def line(x, axis: int):
        out = F.lit(corners[-1][1 - axis])
        for lo, hi in reversed(list(zip(corners, corners[1:]))):
            if hi[axis] > lo[axis]:
                out = F.when(x <= hi[axis], lo[1 - axis] + (x - lo[axis]) * ((hi[1 - axis] - lo[1 - axis]) / (hi[axis] - lo[axis]))).otherwise(out)
        return out

    return lambda time: line(time, 0), lambda ids: line(ids, 1)


def _opened(sums: DataFrame) -> DataFrame:
    """``queue, chunk, n, before``: the ids of a queue before each chunk.

    A chunk's number has its partition's in the upper bits: one window runs over a queue's partitions, one over a partition's chunks.
    """
    sums = sums.withColumn("part", F.shiftright("chunk", 32))
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("queue", "part").agg(F.sum("n").alias("all"))
    parts = parts.select("queue", "part", F.coalesce(F.sum("all").over(upto("queue", "part")), F.lit(0)).alias("opening"))
    inside = sums.repartition("queue", "part").withColumn("within", F.coalesce(F.sum("n").over(upto("queue", "part", "chunk")), F.lit(0)))
    return inside.join(parts, ["queue", "part"]).select("queue", "chunk", (F.col("opening") + F.col("within")).alias("before"), "n")


def packed(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", tokenizer: str | None = None, window: int = WINDOW, grain: int = GRAIN, block_tokens: int = BLOCK_TOKENS, weights: dict[str | None, float] | None = None) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue`` (the source after an ``s``, or ``n`` for null).

    ``weights``: target proportion of every source (None for a null one); by default each source's share of all ids.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    name = lambda c: F.when(c.isNull(), "n").otherwise(F.concat(F.lit("s"), c.cast("string")))
    rows = docs.select(F.col(id_col).alias("id"), name(F.col(source)).alias("queue"), F.col(text).alias("text"))
    ids = rows.mapInArrow(_encoder(tokenizer or default_tokenizer()), f"id {kind}, queue string, chunk long, at long, size long, ids binary")
    ids = stored(ids, "pack-ids")
    sums = stored(_opened(ids.groupBy("queue", "chunk").agg(F.sum("size").alias("n"))), "pack-sums")
    queues = sums.groupBy("queue").agg(F.sum("n").alias("all"))
    found = queues.agg(F.sum("all").alias("total"), F.count("*").alias("queues")).first()
    total, blocks = found["total"] or 0, max(1, -(-(found["total"] or 0) // block_tokens))
    if weights is None:
        weight, sent_by, level = F.col("all").cast("double"), lambda time: time * float(total), lambda sent: sent / float(max(1, total))
    else:
        named = {"n" if k is None else f"s{k}": float(v) for k, v in weights.items()}
        sizes = {r["queue"]: r["all"] for r in queues.filter(F.col("queue").isin(*named)).collect()}  # as many as the caller named, at most
        if len(sizes) < found["queues"] or min(named.values()) <= 0:
            raise ValueError("every source needs a weight above zero")
        weight = F.lit(None).cast("double")
        for q in sizes:
            weight = F.when(F.col("queue") == q, F.lit(named[q])).otherwise(weight)
        sent_by, level = _schedule(sizes, named)
    rows = ids.join(sums.select("queue", "chunk", "before").join(queues, "queue"), ["queue", "chunk"])
    rows = rows.withColumn("at", F.col("at") + F.col("before")).withColumn("weight", weight)
    # the fluid position of a queue at a block's start, and how much of it has been sent in whole grains
    fluid = lambda b: F.least(F.col("weight") * level(b * (total / blocks)), F.col("all").cast("double"))
    edge = lambda b: F.when((b >= blocks) | (fluid(b) >= F.col("all")), F.col("all")).otherwise(F.floor(fluid(b) / grain) * grain).cast("long")
    block_of = lambda x: F.floor(sent_by(x / F.col("weight")) * (blocks / max(1, total))).cast("long")
    # the blocks that a row can touch: one more on either side, by the rounding to grains
    lo, hi = F.greatest(block_of(F.col("at")) - 1, F.lit(0)), F.least(block_of(F.col("at") + F.col("size") + grain) + 1, F.lit(blocks - 1))
    rows = rows.withColumn("block", F.explode(F.sequence(F.least(lo, F.lit(blocks - 1)).cast("long"), hi.cast("long"))))
    rows = rows.withColumn("from", F.greatest("at", edge(F.col("block")))).withColumn("to", F.least(F.col("at") + F.col("size"), edge(F.col("block") + 1))).filter("`from` < `to`")
    opening = (fluid(F.col("block")) - edge(F.col("block"))).alias("opening")
    rows = rows.select("block", "queue", F.col("from").alias("upto"), "id", "size", (F.col("from") - F.col("at")).alias("start"), (F.col("to") - F.col("from")).alias("part"), opening, "weight", F.expr("substring(ids, cast(2 * (`from` - at) + 1 as int), cast(2 * (`to` - `from`) as int))").alias("ids"))
    # more sequences than any block has: a block's ids differ from the mean by less than two grains a queue
    stride = (total // blocks + 2 * (grain + 1) * found["queues"]) // window + window.bit_length() + 1
    return rows.groupBy("block").applyInArrow(_packer(window, grain, stride), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    out = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
