"""Strong components against a plain depth-first search, rings of many nodes, interval labels against a recursion."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import graphs


def tarjan(links):
    """Components of nodes on cycles, by reachability from every node."""
    out = collections.defaultdict(set)
    for a, b in links:
        out[a].add(b)

    def reach(v):
        seen, todo = set(), list(out[v])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        return seen

    nodes = {x for e in links for x in e}
    far = {v: reach(v) for v in nodes}
    return {v: min(w for w in nodes if w in far[v] and v in far[w]) for v in nodes if v in far[v]}


def answer(spark, links):
    got = graphs.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert len({r.node for r in got}) == len(got)
    return {r.node: r.component for r in got}


def random_links(seed):
    rng = random.Random(seed)
    n = rng.randrange(5, 40)
    kind = seed % 3
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(n // 2, int(n * (1.2, 1.7, 3)[kind])))]
    for k in range(rng.randrange(3)):  # rings with tails, joined to the rest
        ring = [1000 * (k + 1) + i for i in range(rng.randrange(2, 9))]
        links += list(zip(ring, ring[1:] + ring[:1])) + [(rng.randrange(n), ring[0]), (ring[-1], rng.randrange(n))][: rng.randrange(3)]
    return links


@pytest.mark.parametrize("seed", range(6))
def test_components(spark, seed):
    links = random_links(seed)
    assert answer(spark, links) == tarjan(links)


def test_components_by_hand(spark):
    # two rings that share a chain; a chain into a ring; a loop; a diamond; null ends
    links = [(1, 2), (2, 3), (3, 4), (4, 1), (3, 5), (5, 6), (6, 2), (7, 8), (8, 1), (9, 9), (9, 10), (11, 12), (11, 13), (12, 14), (13, 14), (20, 21), (21, 20), (21, 22), (22, 21), (30, None), (None, 30)]
    assert answer(spark, links) == {**dict.fromkeys(range(1, 7), 1), 9: 9, 20: 20, 21: 20, 22: 20}
    assert answer(spark, []) == {}


def test_long_ring(spark):
    """A ring of 100,000 nodes, with a chain of 1,000 into it and one out of it: linear rows, a logarithm of joins."""
    n = 100_000
    ring = spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b"))
    tails = spark.range(n, n + 1000).select(F.col("id").alias("a"), F.when(F.col("id") == n + 999, 5).otherwise(F.col("id") + 1).alias("b"))
    tails = tails.union(spark.range(2 * n, 2 * n + 1000).select(F.when(F.col("id") == 2 * n, 7).otherwise(F.col("id") - 1).alias("a"), F.col("id").alias("b")))
    got = graphs.components(ring.union(tails), "a", "b")
    assert got.agg(F.count("*"), F.countDistinct("component"), F.min("node"), F.max("node")).first() == (n, 1, 0, n - 1)


def labelled(rows):
    kids, out, count = collections.defaultdict(list), {}, [0]
    nodes = {v for v, _ in rows}
    for v, u in rows:
        kids[u if u in nodes else None].append(v)

    def go(v, depth):
        first = count[0]
        count[0] += 1
        for w in sorted(kids[v]):
            go(w, depth + 1)
        out[v] = (first, count[0] - 1, depth)

    for v in sorted(kids[None]):
        go(v, 0)
    return out


def test_intervals(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(max(0, i - 9), i) if i % 50 else None) for i in range(300)] + [(1000 + i, 299) for i in range(200)] + [(5000, 9999)]
    labels = graphs.intervals(spark.createDataFrame(rows, "v long, u long"), "v", "u")
    want = labelled(rows)
    assert {r.node: (r.first, r.last, r.depth) for r in labels.collect()} == want
    pairs = [(rng.choice(rows)[0], rng.choice(rows)[0]) for _ in range(400)] + [(1, 77777)]
    up = dict(rows)

    def above(a, b):
        while b is not None:
            b = up.get(b)
            if a == b:
                return True
        return False

    got = graphs.encloses(spark.createDataFrame(pairs, "outer long, inner long"), labels, "outer", "inner").collect()
    assert collections.Counter((r.outer, r.inner, r.encloses) for r in got) == collections.Counter((a, b, above(a, b) if b != 77777 else None) for a, b in pairs)


def test_intervals_of_odd_forests(spark):
    assert graphs.intervals(spark.createDataFrame([], "v long, u long"), "v", "u").count() == 0
    got = {r.node: (r.first, r.last, r.depth) for r in graphs.intervals(spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3), (5, 4), (6, None)], "v long, u long"), "v", "u").collect()}
    assert got == {1: (0, 1, 0), 2: (1, 1, 1), 6: (2, 2, 0), 3: (None,) * 3, 4: (None,) * 3, 5: (None,) * 3}


def test_nothing_through_the_driver(spark, monkeypatch):
    """No step of components or labels broadcasts a side of a join."""
    plans = []
    monkeypatch.setattr(graphs, "written", lambda d, name, own=graphs.written: plans.append((name, d._jdf.queryExecution().executedPlan().toString())) or own(d, name))
    rows = [(i, i + 1 if i % 7 < 6 else i - 6) for i in range(21)] + [(3, 10), (10, 3), (4, 4), (30, 31)]
    got = graphs.components(spark.createDataFrame(rows, "a long, b long"), "a", "b")
    assert {(r.node, r.component) for r in got.collect()} == {(i, 0 if i < 14 else 14) for i in range(21)}
    tree = graphs.intervals(spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2)], "v long, u long"), "v", "u")
    assert {(r.node, r.first, r["last"]) for r in tree.collect()} == {(1, 0, 3), (2, 1, 2), (4, 2, 2), (3, 3, 3)}
    plans.append(("components", got._jdf.queryExecution().executedPlan().toString()))
    # the forest's places are offsets of partitions, a row each
    assert any("Join" in p for _, p in plans) and {n for n, p in plans if "Broadcast" in p} <= {"forest"}
