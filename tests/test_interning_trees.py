"""Interned terms of nodes that name their trees: whole trees in tasks and large ones by level."""

import collections

from test_interning import SCHEMA, forest, recursive

from claimloom.operators import interning
from claimloom.operators.interning import TermGraph


def test_trees(spark):
    nodes, top = forest(3, 24), {}
    for i, parent, *_ in nodes:
        top[i] = i if parent is None else top[parent]
    nodes += [("w", None, 0, "list", "wide"), *[(f"w{i}", "w", i, "const", str(i % 3)) for i in range(1500)], ("x", "y", 0, None, "x"), ("y", "x", 0, "k", "x"), ("z", "y", 1, "k", None), ("u", "nowhere", 0, "k", "x")]
    top |= {n[0]: {"w": "w", "x": "x", "y": "x", "z": "x", "u": None}[n[0][0]] for n in nodes if n[0][0] in "wxyzu"}
    want = recursive([n for n in nodes if n[0] not in "xyzu"])
    rows = spark.createDataFrame([(top[n[0]], *n) for n in nodes], "t string, " + SCHEMA).repartition(3)
    plain = TermGraph(rows.drop("t"))
    for most in (10_000, 12):
        g = TermGraph(rows, "t", most)
        ids = {r.id: (r.cid, r.height) for r in g.ids.collect()}
        assert {k: v for k, v in ids.items() if k not in ("z", "u")} == want and {"z", "u"} < set(ids)
        for part in ("terms", "edges", "roots", "unfinished"):
            a, b = (collections.Counter(map(tuple, getattr(x, part)().select(sorted(getattr(x, part)().columns)).collect())) for x in (g, plain))
            assert a == b, (most, part)


def test_one_shuffle(spark, sf):
    """The nodes of a tree lie side by side already: one exchange by order, one to count terms."""
    from claimloom.plans import upkeep

    plan = upkeep.term_edges(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    made = upkeep.term_edges(spark, sf)
    made.count()
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and text.count("Exchange hashpartitioning(") == 2


def test_counts_leave_the_tasks(spark, monkeypatch):
    """Terms are hashed once a task and counted there: a hundred equal trees in a task leave as many rows as one, and no node is made to learn the trees' sizes."""
    one = [("r", None, 0, "list", None), ("a", "r", 0, "const", "1"), ("b", "r", 1, "const", "2"), ("c", "b", 0, "const", "1")]
    rows = [(t, f"{t}{i}", p and f"{t}{p}", pos, kind, label) for t in range(100) for i, p, pos, kind, label in one]
    sizes = spark.createDataFrame([(4,)], "n long")
    g = TermGraph(spark.createDataFrame(rows, "t int, " + SCHEMA).coalesce(1), "t", sizes=sizes)
    assert {(r.label, r.height): r.uses for r in g.terms().collect()} == {("1", 0): 200, ("2", 1): 100, (None, 2): 100}
    assert sorted((r.pos, r.uses) for r in g.edges().collect()) == [(0, 100), (0, 100), (1, 100)]
    side_by_side = g.sized.coalesce(1).sortWithinPartitions("tree")
    batches = side_by_side.toArrow().to_batches(max_chunksize=7)
    assert sum(b.num_rows for b in interning._counted_terms(iter(batches))) == 3
    assert sum(b.num_rows for b in interning._counted_edges(iter(batches))) == 3
    met = []
    monkeypatch.setattr(interning, "_sha", lambda text, own=interning._sha: met.append(text) or own(text))
    assert sum(b.num_rows for b in interning._trees(iter(batches))) == 400 and len(met) == 5  # a leaf one hash, others two
    monkeypatch.setattr(interning, "KNOWN", 1)  # given out again and again: the same sums
    parts = [b.to_pylist() for b in interning._counted_terms(iter(batches))]
    assert len(parts) > 20 and sum(r["uses"] for p in parts for r in p) == 400
