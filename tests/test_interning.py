"""Interned terms against a recursion over whole trees."""

import collections
import hashlib
import random

from claimloom.operators.interning import PART, TermGraph

SCHEMA = "id string, parent string, pos int, kind string, label string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def recursive(nodes):
    kids, out = collections.defaultdict(list), {}
    for i, parent, pos, _, _ in nodes:
        kids[parent].append((pos, i))
    by = {n[0]: n for n in nodes}

    def go(i):
        below = [go(k) for _, k in sorted(kids[i])]
        parts = collections.defaultdict(str)
        for (pos, k) in sorted(kids[i]):
            parts[pos // PART] += out[k][0]
        children = "".join(sha(parts[p]) for p in sorted(parts)) if parts else sha("")
        cid = sha("\x1f".join([by[i][3], "\x00" if by[i][4] is None else by[i][4], str(len(below)), children]))
        out[i] = (cid, 1 + max(below) if below else 0)
        return out[i][1]

    for _, i in kids[None]:
        go(i)
    return out


def forest(seed, n):
    rng, nodes = random.Random(seed), [("0", None, 0, "root", None)]
    wide = collections.Counter()
    for i in range(1, n):
        parent = str(rng.randrange(max(0, i - 12), i)) if rng.random() < 0.95 else None
        nodes.append((str(i), parent, wide[parent], rng.choice("ab"), rng.choice(["x", None])))
        wide[parent] += 1
    return nodes


def test_forests(spark):
    nodes = forest(1, 300) + [("w", None, 0, "list", "wide"), *[(f"w{i}", "w", i, "const", str(i % 3)) for i in range(2500)]]
    g, want = TermGraph(spark.createDataFrame(nodes, SCHEMA)), recursive(nodes)
    assert {r.id: (r.cid, r.height) for r in g.ids.collect()} == want
    uses = collections.Counter(c for c, _ in want.values())
    assert {r.cid: r.uses for r in g.terms().collect()} == uses and len(uses) < len(nodes)
    edges = collections.Counter((want[n[1]][0], n[2], want[n[0]][0]) for n in nodes if n[1] is not None)
    assert {(r.cid, r.pos, r.child): r.uses for r in g.edges().collect()} == edges
    assert {r.id: r.cid for r in g.roots().collect()} == {n[0]: want[n[0]][0] for n in nodes if n[1] is None}
    assert g.unfinished().count() == 0


def test_odd_forests(spark):
    assert TermGraph(spark.createDataFrame([], SCHEMA)).terms().count() == 0
    ring = [("a", "b", 0, "k", "x"), ("b", "a", 0, "k", "x"), ("c", "a", 1, "k", "y"), ("d", None, 0, "k", "y")]
    g = TermGraph(spark.createDataFrame(ring, SCHEMA))
    assert {r.id for r in g.unfinished().collect()} == {"a", "b"} and {r.id for r in g.ids.collect()} == {"c", "d"}
    assert g.terms().count() == 1
