"""Near-duplicate classes by b-bit MinHash, banding and exact confirmation.

A document's set holds its distinct shingles of words (A-Z lower-cased), as
64-bit hashes.  ``N_HASHES`` minima are taken; bands of ``ROWS`` full minima give candidates, and
``B_BITS`` low bits of each (mixed) minimum are packed in bit planes, from which a
bit count gives the similarity, corrected for the chance agreement ``2 ** -b``.
Candidates whose estimate is over ``threshold - slack`` are confirmed on the full sets.

Equal sets form one node first, so copies are never paired.  In a bucket, members are
paired with the bucket's leader only (the member that shares buckets with most
others); confirmed links are contracted to components, and only buckets that still
hold more than one component go on: some more rounds of leaders, and at last all pairs of members of
different components whose estimate passes (the join condition drops the rest).
So no link that passes bands and estimate can join two components unseen.
With 32 bands of 6 minima a link of similarity 0.85 is missed with
probability 3e-7, by an error of the estimate of 0.115 (4.3 sigma) with 1e-5.

The distance 1 - similarity is a metric, and each member's exact distance from one leader is
known after the first round: two members with one leader whose distances from it differ by
more than a link's distance cannot be linked, and are not paired at last.

A node is a set (63 bits of a hash of its size and sums), not an id: texts under one id are judged apart, and rows without
an id are linked as others are.  A class is named by its smallest id (null if it has none), and its row of the
smallest id, null last, and then of the smallest hash of the text stays.

Null and empty texts have an empty set and are linked with nothing; rows that agree in id
and text stay or go together; ids are integers; a very long text is read whole (a set of one 64-bit hash for each distinct shingle); ties do not arise, as links are symmetric;
other columns, whatever their names, are untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.bitset import maybe_in
from claimloom.llm.store import discard, fresh, small_batches, stored
from claimloom.llm.textcore import gram_hashes, hash_spans, mix64, text_chunks, word_spans

BANDS, ROWS = 32, 6
N_HASHES = BANDS * ROWS
B_BITS = 4
WORDS = N_HASHES // 64
#: How far below the threshold an estimate may be and still be checked.
SLACK = 0.115
LEADER_ROUNDS = 4
SHINGLE_WORDS, THRESHOLD = 5, 0.8

_seed = mix64(np.arange(1, 2 * N_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A = (_seed[:N_HASHES].astype(np.uint32) | np.uint32(1))[None, :]
_B = _seed[N_HASHES:].astype(np.uint32)[None, :]
_BAND = mix64(np.arange(11, 11 + BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of consecutive texts)."""
    for a, _, data, off in text_chunks(texts):
        starts, ends, first = word_spans(data, off)
        h = hash_spans(data, starts, ends, lower=True)
        g, pos = gram_hashes(h, first, k)
        at = np.searchsorted(pos, first)
        out = []
        for i in range(len(off) - 1):
            w0, w1 = first[i], first[i + 1]
            if w1 - w0 >= k:
                out.append(np.unique(g[at[i] : at[i + 1]]))
            elif w1 > w0:
                acc = np.uint64(w1 - w0)
                for x in h[w0:w1]:
                    acc = mix64(np.array([acc]) * np.uint64(0xC2B2AE3D27D4EB4F) + x)[0]
                out.append(np.array([acc], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        yield a, out


def minima(s: np.ndarray) -> np.ndarray:
    """The minima of a set that is not empty under ``N_HASHES`` hash functions."""
    x = s.astype(np.uint32)[:, None]
    best = np.full(N_HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 256):
        np.minimum(best, (x[a : a + 256] * _A + _B).min(axis=0), out=best)
    return best


def planes(m: np.ndarray) -> np.ndarray:
    """The low ``B_BITS`` bits of minima (rows), packed: plane after plane, as int64."""
    x = m ^ (m >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x = x ^ (x >> np.uint32(13))
    bits = [np.packbits((x >> np.uint32(b) & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little") for b in range(B_BITS)]
    return np.ascontiguousarray(np.concatenate(bits, axis=1)).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    acc = np.broadcast_to(_BAND, (len(m), BANDS)).copy()
    rows = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        acc = mix64(acc * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, :, r])
    return acc.view(np.int64)


def _signer(k: int):
    def run(batches):
        for batch in batches:
            for a, sets in shingle_sets(batch.column(1), k):
                n = len(sets)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                m = np.stack([minima(sets[i]) for i in full]) if len(full) else np.zeros((0, N_HASHES), np.uint32)
                one = np.array([int(s.sum()) & (2**63 - 1) if len(s) else 0 for s in sets], np.int64)
                two = np.array([int(np.bitwise_xor.reduce(mix64(s)) >> np.uint64(1)) if len(s) else 0 for s in sets], np.int64)
                mask = size == 0
                p, b = np.zeros((n, B_BITS * WORDS), np.int64), np.zeros((n, BANDS), np.int64)
                if len(full):
                    p[full], b[full] = planes(m), band_keys(m)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()), mask=pa.array(mask) if mask.any() else None)
                yield pa.record_batch([batch.column(0).slice(a, n), pa.array(size), pa.array(one), pa.array(two), lists(p), lists(b)], names=["id", "n", "s1", "s2", "planes", "bands"])

    return run


def _set_maker(k: int):
    def run(batches):
        for batch in batches:
            for a, sets in shingle_sets(batch.column(1), k):
                yield pa.record_batch([batch.column(0).slice(a, len(sets)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "set"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """``id, comp`` (the smallest id reachable) of all ids in the edges ``a, b``: least labels and pointer jumping, by joins."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    label = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "cc-label")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = label.join(near, "id").select("id", F.least("comp", "c").alias("comp"), F.col("comp").alias("old"))
        jump = label.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        old, step = label, stored(step.join(jump, "comp", "left").select("id", F.least(F.col("comp"), F.coalesce(F.col("up"), F.col("comp"))).alias("comp"), "old"), "cc-label")
        moved = step.filter("comp <> old").count()
        discard(old)
        label = step.select("id", "comp")
        label._stored_path = step._stored_path
        if not moved:
            discard(both)
            return label


def _similar(floor: float):
    """On ``planes_a`` and ``planes_b``: the estimate, corrected for chance agreement, is at least ``floor``."""
    differ = " + ".join("bit_count(" + " | ".join(f"(planes_a[{b * WORDS + w}] ^ planes_b[{b * WORDS + w}])" for b in range(B_BITS)) + ")" for w in range(WORDS))
    c = 2.0**-B_BITS
    return f"({1 - c} * {N_HASHES} - ({differ})) >= {floor * (1 - c) * N_HASHES - 1e-9}"


def _text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def judged(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = SHINGLE_WORDS, percent: int = round(100 * THRESHOLD)) -> DataFrame:
    """``classes`` and, per row, ``of`` (hash of its text) and ``kept`` (the row that its class keeps)."""
    small_batches(docs.sparkSession)
    row = F.struct(F.col(id_col).cast("long").alias("id"), _text_hash(text).alias("of"))
    signed = docs.select(row.alias("row"), F.col(text).alias("text")).mapInArrow(_signer(k), "id struct<id: long, of: long>, n long, s1 long, s2 long, planes array<long>, bands array<long>")
    node = F.shiftrightunsigned(F.xxhash64("n", "s1", "s2"), 1)
    signed = stored(signed.select("id.id", "id.of", "n", node.alias("node"), "planes", "bands"), "near-signatures")
    use = signed.filter("n > 0")
    least = F.struct(F.col("id").isNull().alias("none"), "id", "of")
    reps = stored(use.groupBy("node").agg(F.min(least).alias("least")), "near-sets")
    nodes = use.select(F.col("node").alias("id"), "planes", "bands").dropDuplicates(["id"])
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    bucket = stored(keyed.join(shared, "key"), "near-buckets")
    ids = stored(bucket.groupBy("id").agg(F.sum("members").alias("score")), "near-nodes")
    sign = stored(nodes.select("id", "planes", "bands").join(ids, "id"), "near-planes")
    at = reps.join(ids.select(F.col("id").alias("node")), "node", "left_semi").select("node", "least.none", F.coalesce("least.id", F.lit(0)).alias("at"), "least.of")
    place = ["none", "at", "of"]
    texts = docs.select(row.alias("row"), F.col(text).alias("text")).select(F.col("row.id").isNull().alias("none"), F.coalesce("row.id", F.lit(0)).alias("at"), "row.of", "text")
    texts = texts.filter(maybe_in(F.xxhash64(*place), at.select(F.xxhash64(*place).alias("h"))))
    sets = stored(texts.join(at, place).select(F.col("node").alias("id"), "text").dropDuplicates(["id"]).mapInArrow(_set_maker(k), "id long, set array<long>"), "near-full-sets")
    likely = _similar(percent / 100 - SLACK)

    def measured(pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` with the similarity of their full sets, and whether that makes a link."""
        pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        pairs = pairs.withColumn("both", F.size(F.array_intersect("sa", "sb"))).withColumn("any", F.size("sa") + F.size("sb") - F.col("both"))
        return pairs.select("a", "b", (1 - F.col("both") / F.col("any")).alias("far"), (100 * F.col("both") >= percent * F.col("any")).alias("link"))

    def by_leader(b: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members paired with their bucket's leader; the leaders."""
        lead = stored(b.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("m"))).alias("x")).select("key", (-F.col("x.m")).alias("a"), F.col("x.score").alias("lead_score")), "near-leaders")
        pairs = b.select("key", F.col("id").alias("b"), F.col("comp").alias("cb")).join(lead, "key").filter("a <> b").select("a", "b", "cb", "lead_score").distinct()
        return pairs, lead

    def estimated(pairs: DataFrame) -> DataFrame:
        return pairs.join(sign.select(F.col("id").alias("a"), F.col("planes").alias("planes_a")), "a").join(sign.select(F.col("id").alias("b"), F.col("planes").alias("planes_b")), "b").filter(likely).select("a", "b")

    comp = ids.select("id", F.col("id").alias("comp"))
    open_ = bucket.join(ids, "id").select("key", "id", "score", F.col("id").alias("comp"))
    links = 0
    for turn in range(LEADER_ROUNDS + 1):
        if turn < LEADER_ROUNDS:
            pairs, lead = by_leader(open_)
            if turn == 0:  # one leader for each member: most buckets of a group have the same members
                pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("lead_score", -F.col("a"))).alias("a"))
            else:
                ca = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
                pairs = estimated(pairs.join(ca, "a").filter("ca <> cb").select("a", "b").distinct())
        else:
            # all pairs left, each once (at its first common key); the condition confirms them on the full sets, so only links leave the join
            rest = open_.join(pivot, "id", "left").join(sign.select("id", "planes", "bands"), "id").join(sets, "id")
            side = lambda x: rest.select(F.col("key").alias(f"key_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("id", "comp", "pivot", "far", "planes", "bands", "set")])
            near = f"coalesce(pivot_a <> pivot_b, true) or coalesce(abs(far_a - far_b), 0) <= {1 - percent / 100 + 1e-9}"
            same = f"size(array_intersect(set_a, set_b)) * {100 + percent} >= {percent} * (size(set_a) + size(set_b))"
            pairs = side("a").join(side("b"), F.expr(f"key_a = key_b and id_a < id_b and comp_a <> comp_b and ({near}) and {likely} and get(array_intersect(bands_a, bands_b), 0) = key_a and {same}"))
            found = stored(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit(True).alias("link")), "near-links")
        if turn < LEADER_ROUNDS:
            found = stored(measured(pairs), "near-links")
        if turn == 0:
            pivot = found.select(F.col("b").alias("id"), F.col("a").alias("pivot"), "far")
        found = found.filter("link")
        if n := found.count():
            links += n
            ca, cb = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
            label = components(found.join(ca, "a").join(cb, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b"))
            merged = label.select(F.col("id").alias("comp"), F.col("comp").alias("new"))
            last, comp = comp, stored(comp.join(merged, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp")), "near-components")
            discard(label, last)
        # a leader of a later turn has met all members of its bucket; buckets of one component are done
        if turn == LEADER_ROUNDS:
            break
        rest = open_.drop("comp").join(comp, "id")
        if turn:
            rest = rest.join(lead.select("key", F.col("a").alias("id")), ["key", "id"], "left_anti")
        live = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        last, open_ = open_, stored(rest.join(live, "key", "left_semi").select("key", "id", "score", "comp"), "near-open")
        discard(last, lead)
        if open_.isEmpty():
            break
    named = stored(reps.join(comp.select(F.col("id").alias("node"), "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "near-named")
    final = named.join(named.groupBy("comp").agg(F.min("least").alias("first")), "comp").select("node", "least", "first")
    out = signed.select("id", "of", "n", "node").join(final, "node", "left")
    empty = F.col("n") == 0
    kept = empty | (F.col("id").eqNullSafe(F.col("first.id")) & F.col("of").eqNullSafe(F.col("first.of")))
    return out.select("id", "of", "n", F.when(empty, F.col("id")).otherwise(F.col("first.id")).alias("component_id"), F.when(empty, F.col("id")).otherwise(F.col("least.id")).alias("set_id"), kept.alias("kept"))


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """Per row ``id, n`` (set size), ``component_id`` and ``set_id`` (smallest id with an equal set). ids are integers."""
    return judged(docs, text, id_col, **options).select("id", "n", "component_id", "set_id")


def deduplicated(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each class."""
    who, of = fresh(docs, "_id", "_of")
    gone = judged(docs, text, id_col, **options).filter("not kept").select(F.col("id").alias(who), F.col("of").alias(of)).distinct()
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(who)) & (_text_hash(text) == F.col(of)), "left_anti")


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
