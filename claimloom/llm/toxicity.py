"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives, all else is unlabelled.  A linear classifier over
hashed words (and pairs of words) is fitted in numpy on the non-negative risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with logistic loss; where the second term falls below zero, its gradient is
ascended instead.  The class prior is the toxic share among labelled training rows.
Every feature of enough positives stays in the fit; how easily its weight leaves zero depends on its
evidence (see ``EVIDENCE``), so risk and weight decay decide on it, not a cut.

1. Over the whole table outside the held-out fold it is counted how many texts hold each feature, and how many positives do: those of
   enough positives are the vocabulary, and their two rates are the evidence.  No text is shuffled but that of positives.
2. The descent sees a sample of whole texts (``max_positive`` positives and ``max_unlabelled`` others at most, by hash), as features of the vocabulary only:
   the driver gets ``max_positive + max_unlabelled`` lists of at most the vocabulary's size, whatever the texts' length.
3. Every text is scored in one narrow pass.

Labels, language, source and id are no inputs of a score.  Null and empty texts get the score of a text without
words; null ids are held in no fold and never trained on; repeated labels of one
id count once, toxic if any is; without positives the score is the prior.  Repeated rows are trained on and scored each for
itself; a tie at the sample's edge goes to the smaller id; a very long text is read whole; an empty table gives an empty result and, as training data, the prior;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.bitset import maybe_in
from claimloom.llm.store import small_batches
from claimloom.llm.textcore import gram_hashes, hash_spans, text_chunks, word_spans

#: Defaults of ``max_positive`` and ``max_unlabelled``: texts of each kind in the descent, at most.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
BUCKETS = 1 << 20
#: Buckets whose counts make one row.
BLOCK = 1 << 12
#: A feature must occur in so many positives of the sample (in 1 of fewer than ``FEW``, one more for each further ``FEW``, up to this).
MIN_POSITIVES, FEW = 4, 20
#: A feature counts ``z * z / (z * z + EVIDENCE)`` in the fit, where its rates in positives and unlabelled texts differ by ``z`` standard errors.
EVIDENCE = 9.0
EPOCHS, BATCHES, RATE, DECAY = 60, 12, 0.05, 3e-4
THRESHOLD = 0.3

#: Bytes that are neither letters, digits nor part of another character part words.
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def features(texts: pa.Array):
    """(first row, distinct feature buckets of consecutive texts, their bounds)."""
    for a, _, data, off in text_chunks(texts):
        data = _CLEAN[data]
        starts, ends, first = word_spans(data, off)
        h = hash_spans(data, starts, ends, lower=True)
        pair, at = gram_hashes(h, first, 2)
        n = len(off) - 1
        text = np.repeat(np.arange(n), np.diff(first))
        keys = np.concatenate([text.astype(np.uint64) << np.uint64(32) | h % np.uint64(BUCKETS), text[at].astype(np.uint64) << np.uint64(32) | pair % np.uint64(BUCKETS)])
        keys = np.unique(keys)
        yield a, (keys & np.uint64(0xFFFFFFFF)).astype(np.int32), np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))


def vocabulary(seen: np.ndarray, n: np.ndarray, positives: int) -> np.ndarray:
    """Of features ``seen`` in ``n`` of the positives, those of enough positives (flags)."""
    return n >= min(MIN_POSITIVES, 1 + positives // FEW)


def fit(rows: list[tuple[bool, np.ndarray]], prior: float, seed: int = 5, counted: tuple | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature buckets (sorted), their weights, and the intercept.

    ``counted``: the vocabulary, how many positives and unlabelled texts hold each feature of it, and the numbers of both, where they are known; else the rows are counted.
    """
    pos = [x for y, x in rows if y]
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not pos:
        return np.zeros(0, np.int32), np.zeros(0), base
    if counted is None:
        seen, n = np.unique(np.concatenate(pos), return_counts=True)
        other = [x for y, x in rows if not y]
        some = vocabulary(seen, n, len(pos))
        held = np.bincount(np.concatenate([*other, np.zeros(0, np.int32)]), minlength=BUCKETS)[seen[some]]
        counted = seen[some], n[some], held, len(pos), len(other)
    vocab, n, held, n_pos, n_other = counted
    back = held / max(1, n_other)
    rate = (n + back * n_pos) / (2 * n_pos)
    lift = (n / n_pos - back) / np.sqrt(rate * (1 - rate) * (1 / n_pos + 1 / max(1, n_other)) + 1e-12)
    scale = np.append(lift**2 / (lift**2 + EVIDENCE), 1.0)

    def known(x):
        i = np.searchsorted(vocab, x)
        i[i == len(vocab)] = 0
        return i[vocab[i] == x] if len(vocab) else i[:0]

    parts = [[known(x) for y, x in rows if y == kind] for kind in (True, False)]
    w = np.zeros(len(vocab) + 1)
    w[-1] = base
    # steps in w / scale; all features share one second moment, the intercept has its own
    m, v, step = np.zeros_like(w), np.zeros(2), 0
    rng = np.random.default_rng(seed)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def side(part):
        """Margins of texts, and a function from their derivatives to the gradient."""
        at, owner = np.concatenate([*part, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(part)), [len(x) for x in part])
        z = np.bincount(owner, weights=(w * scale)[at], minlength=len(part)) + w[-1]

        def back(d):
            g = np.bincount(at, weights=d[owner], minlength=len(w))
            g[-1] = d.sum()
            return g * scale

        return z, back

    for _ in range(EPOCHS):
        ps, us = np.array_split(rng.permutation(len(parts[0])), BATCHES), np.array_split(rng.permutation(len(parts[1])), BATCHES)
        for p, u in zip(ps, us):
            if not len(p) or not len(u):
                continue
            zp, back_p = side([parts[0][i] for i in p])
            zu, back_u = side([parts[1][i] for i in u])
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g_neg = back_u(sig(zu) / len(u)) - prior * back_p(sig(zp) / len(p))
            g = prior * back_p((sig(zp) - 1) / len(p)) + g_neg if negative >= 0 else -g_neg
            g[:-1] += DECAY * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * np.array([np.square(g[:-1]).max(initial=0.0), g[-1] ** 2])
            size = np.sqrt(v / (1 - 0.999**step)) + 1e-8
            w -= RATE * (m / (1 - 0.9**step)) / np.append(np.full(len(vocab), size[0]), size[1])
    return vocab, (w * scale)[:-1], float(w[-1])


def _featurise(vocab):
    """Features of the vocabulary in each text."""

    def run(batches):
        known = np.zeros(BUCKETS, bool)
        known[vocab.value] = True
        for batch in batches:
            for a, f, bound in features(batch.column(1)):
                use = known[f]
                bound = np.concatenate([[0], np.cumsum(use)])[bound]
                yield pa.record_batch([batch.column(0).slice(a, len(bound) - 1), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(f[use]))], names=["positive", "f"])

    return run


def _counter(vocab):
    """How many texts of a partition hold each bucket (of the vocabulary, if there is one), in blocks; as block -1 the number of texts."""

    def run(batches):
        total, n = np.zeros(BUCKETS, np.int32), 0
        for batch in batches:
            for _, f, bound in features(batch.column(0)):
                total += np.bincount(f, minlength=BUCKETS).astype(np.int32)
                n += len(bound) - 1
        held = total if vocab is None else total[vocab.value]
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([[n]], pa.list_(pa.int32()))], names=["block", "counts"])
        for lo in range(0, len(held), BLOCK):
            if (part := held[lo : lo + BLOCK]).any():
                yield pa.record_batch([pa.array([lo // BLOCK], pa.int32()), pa.array([part], pa.list_(pa.int32()))], names=["block", "counts"])

    return run


def _adder(batches):
    """Blocks of counts, added up; a task holds its blocks only, however many partitions sent them."""
    sums = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = counts.values.to_numpy().astype(np.int64)
            sums[block] = sums[block] + x if block in sums else x
    for block, x in sums.items():
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([x], pa.list_(pa.int64()))], names=["block", "counts"])


def _counts(texts: DataFrame, vocab=None) -> tuple[np.ndarray, int]:
    """How many texts hold each bucket, and how many there are; at most ``BUCKETS + 1`` counts reach the driver."""
    rows = texts.mapInArrow(_counter(vocab), "block int, counts array<int>").repartition("block").mapInArrow(_adder, "block int, counts array<long>").toArrow()
    at, out, n = np.arange(BUCKETS) if vocab is None else vocab.value, np.zeros(BUCKETS, np.int64), 0
    for block, counts in zip(rows.column("block").to_pylist(), rows.column("counts").to_pylist()):
        if block < 0:
            n = counts[0]
        else:
            out[at[block * BLOCK : block * BLOCK + len(counts)]] = counts
    return out, n


def _scorer(model):
    def run(batches):
        vocab, w, b = model.value
        dense = np.zeros(BUCKETS, np.float32)
        dense[vocab] = w
        for batch in batches:
            for a, f, bound in features(batch.column(1)):
                total = np.concatenate([[0], np.cumsum(dense[f], dtype=np.float64)])
                z = total[bound[1:]] - total[bound[:-1]] + b
                yield pa.record_batch([batch.column(0).slice(a, len(z)), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["id", "score"])

    return run


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED):
    """The model (broadcast) from rows outside the held-out fold."""
    spark = docs.sparkSession
    small_batches(spark)
    told = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    prior = float(told.agg(F.avg("toxic")).first()[0] or 0.0)
    order = F.xxhash64(F.col("id"), F.lit(11))
    toxic = told.filter("toxic = 1").select("id")
    pos = toxic.select("id", order.alias("o")).orderBy("o", "id").limit(max_positive).select("id", F.lit(True).alias("positive"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    # a bit set tells most other rows from positives, so that only positives meet the labels
    near = maybe_in(F.xxhash64("id"), toxic.select(F.xxhash64("id").alias("h")))
    n, n_pos = _counts(rows.filter(near).join(toxic, "id").select("text"))
    seen = np.flatnonzero(n).astype(np.int32)
    vocab = seen[vocabulary(seen, n[seen], n_pos)]
    known = spark.sparkContext.broadcast(vocab)
    every, n_every = _counts(rows.select("text"), known)
    unl = rows.select("id").join(toxic, "id", "left_anti").select("id", order.alias("o")).orderBy("o", "id").limit(max_unlabelled).select("id", F.lit(False).alias("positive"))
    sample = F.broadcast(pos.union(unl).distinct())  # max_positive + max_unlabelled rows at most
    got = rows.join(sample, "id").select("positive", "text").mapInArrow(_featurise(known), "positive boolean, f array<int>").toArrow()
    flags = got.column("positive").to_pylist()
    lists = got.column("f").combine_chunks()
    bound, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return spark.sparkContext.broadcast(fit([(y, flat[bound[i] : bound[i + 1]]) for i, y in enumerate(flags)], prior, counted=(vocab, n[vocab], (every - n)[vocab], n_pos, n_every - n_pos)))


def scored(docs: DataFrame, model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(_scorer(model), f"id {kind}, score double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs, train(docs, labels))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
