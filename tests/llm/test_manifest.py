"""The Merkle manifest against a plain recursion over whole groups, and its proofs against changed leaves."""

import collections
import hashlib
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from claimloom.llm import manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root, and for each node its siblings level by level."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(a, min(a + 16, len(nodes)))) for a in range(0, len(nodes), 16)]
        for run in runs:
            for i in run:
                for x in under[i]:
                    paths[x].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        nodes, under = [h("".join(nodes[j] for j in run)) for run in runs], [[x for j in run for x in under[j]] for run in runs]
    return (nodes or [None])[0], paths


def brute(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: (sorted(groups[g], key=lambda x: x[:3]), *climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])])) for g in order}
    root, above = climb([inner[g][1] for g in order])
    out = []
    for g, up in zip(order, above):
        for (_, _, node, r), path in zip(inner[g][0], inner[g][2]):
            now = node
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path + up:
                now = h(left + now + right)
            out.append((r[0], node, inner[g][1], root, h("".join(a + b for a, b in path + up)), now, now == root))
    return collections.Counter(out)


def answer(got):
    return collections.Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, table):
    t = pq.read_table(f"/root/testdata/{table}/documents.parquet").to_pylist()
    got = manifest.op12_manifest(spark, f"/root/testdata/{table}").collect()
    assert answer(got) == brute([tuple(r[c] for c in FIELDS) for r in t])
    assert 0 < sum(not r.verified for r in got) < len(got)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
ODD = [
    (1, None, None, None, None), (2, None, "en", 3, "ABC"), (None, "", "en", 0, ""), (None, "", "en", 0, ""), (3, "=", "é", 5, "Ünï"), (5, "a", "en", 2, "x" * 300_000),
    *[(7, "hot", "en", 1, "Same")] * 700, *[(i, f"s{i % 90}", "en", i, f"Text {i}") for i in range(400)], *[(i, "hot", "de", i, f"T{i}") for i in range(900)],
]


@pytest.mark.parametrize("rows", [ODD, ODD[4:5], []])
def test_odd_rows(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("g", "node", "p", "i", "kind", "_row", "root"):
        df = df.withColumn(c, F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert answer(manifest.op12_manifest(spark, str(tmp_path)).collect()) == brute(rows)


@pytest.mark.parametrize("per_partition", [3, 20, 170])
def test_groups_over_partitions(spark, per_partition):
    """Groups that begin, go on and end in many partitions; the returned proofs lead to the root from their own leaf only."""
    rows = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    out = manifest.manifest(rows, per_partition=per_partition).cache()
    want = collections.Counter({k[:4]: 0 for k in brute(ODD)})
    for k, n in brute(ODD).items():
        want[k[:4]] += n
    assert collections.Counter((r.id, r.leaf, r.subroot, r.root) for r in out.collect()) == want
    assert out.filter(manifest.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert out.filter(manifest.folded(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).count() == 0
    siblings = collections.Counter(h("".join(s["left"] + s["right"] for s in r.proof)) for r in out.collect())
    assert siblings == collections.Counter(x for k, n in brute(ODD).items() for x in [k[4]] * n)
