"""Percentiles by counting, losses along searched paths, and the analysis of stored queries."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import determinism, lattice, selection


def test_nearest_ranks(spark):
    rng = random.Random(9)
    odd = [0.0, -0.0, 1e300, -1e300, 5e-324, float("inf"), float("-inf"), 1.0, 1.0, 1.0, -1.5]
    rows = [(g, rng.choice([rng.gauss(0, 1), rng.choice(odd), rng.randrange(5) / 2])) for g in "abc" for _ in range(rng.randrange(1, 300))] + [("one", 3.25), ("none", None), ("hot", None)] + [("hot", 7.0)] * 900
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.g, r.p): r.result for r in selection.nearest_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", ps).collect()}
    groups = collections.defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    want = {(g, p): sorted(v)[min(len(v) - 1, max(0, math.ceil(p * len(v) - 1e-9) - 1))] for g, v in groups.items() for p in ps}
    assert got == want
    assert selection.nearest_ranks(spark.createDataFrame([], "g string, v double"), ["g"], "v", ps).count() == 0


def test_least_losses(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice(["none", "widening", "narrowing", "saturating", "wrapping", "other"])) for _ in range(24)] + [(None, "n1", "none"), ("n1", None, "none"), ("n0", "end", "widening"), ("n0", "end", "saturating"), ("n0", "end", "wrapping")]
    bits = {"none": 0, "widening": 1, "narrowing": 2, "saturating": 4, "wrapping": 8, "other": 16}
    found = collections.defaultdict(set)
    work = [(s, s, 0) for s in ("n0", "n3", "nowhere")]
    while work:
        s, at, m = work.pop()
        for a, b, x in edges:
            if a == at and b is not None and (m | bits[x]) not in found[s, b]:
                found[s, b].add(m | bits[x])
                work.append((s, b, m | bits[x]))
    want = {(s, t, m) for (s, t), ms in found.items() for m in ms if not any(x != m and x & m == x for x in ms)}
    frame = spark.createDataFrame(edges, "a string, b string, loss string").withColumn("bits", lattice.mode(F.col("loss")))
    got = lattice.least_losses(frame, spark.createDataFrame([("n0",), ("n3",), ("nowhere",)], "source string"))
    assert {(r.source, r.target, r.bits) for r in got.collect()} == want
    assert any(len({m for x, y, m in want if (x, y) == k[:2]}) > 1 for k in want)
    said = {r.bits: r.loss for r in spark.createDataFrame([(m,) for m in range(32)], "bits int").select("bits", lattice.label(F.col("bits")).alias("loss")).collect()}
    assert said[0] == "none" and said[12] == "compound:saturating+wrapping" and said[3] == "narrowing" and said[9] == "wrapping" and said[17] == "compound:open"


STORED = {
    "select k, v from t order by k limit 3": "",
    "select v from t order by v limit 3": "limit,order",
    "select v from t order by v, k": "",
    "select k from t limit 3": "limit,order",
    "select a.k from t a join u b on a.k = b.id order by a.k, b.id": "",
    "select t.k from t join u on t.k = u.id order by t.k": "order",
    "select t.k, id from t join u on t.k = u.id order by t.k, id": "",
    "select k from t left join u on k = id order by k": "order",
    "select k from t where exists (select 1 from u where id = k) order by k": "",
    "select k from t where k in (select id from u limit 2) order by k": "limit",
    "select uuid() as x from t order by k": "random",
    "select max(v) as m from t where rand() < 0.5": "random",
    "select max(v) as m from t where d < now()": "clock",
    "select k from t tablesample (10 percent) order by k": "sample",
    "select collect_list(v) as c from t": "arrival",
    "select sum(v) over (order by v rows between 1 preceding and current row) as s, k from t order by k": "window",
    "select sum(v) over (partition by d) as s, k from t order by k": "",
    "select rank() over (order by v) as s, k from t order by k": "",
    "select reflect('java.lang.System', 'getProperty', 'user.name') as x": "outside",
    "select current_user() as x": "outside",
    "select distinct v from t order by v": "",
    "select v, count(*) as n from t group by v order by v": "",
    "select v + 1 as w, count(*) as n from t group by v + 1 order by w": "",
    "select id from range(5) order by id": "foreign,order",
    "selec k": "unknown",
    "": "unknown",
    "select missing from t": "unknown",
    "select 1 as one": "",
}


def test_stored_queries(spark):
    t = spark.createDataFrame([(1, 2.0, None)], "k long, v double, d timestamp")
    u = spark.createDataFrame([(1,)], "id long")
    rows = [(i, q) for i, q in enumerate(STORED)]
    got = {r.id: r for r in determinism.judged(spark.createDataFrame(rows, "id int, text string"), {"t": (t, ["k"]), "u": (u, ["id"])}).collect()}
    for i, (q, want) in enumerate(STORED.items()):
        assert got[i].faults == want and got[i].runs == (not want), (q, got[i].faults)
    assert not [x.name for x in spark.catalog.listTables() if x.name in ("t", "u")]
    with pytest.raises(ValueError):
        determinism.judged(spark.range(determinism.MAX_QUERIES + 1).select("id", F.lit("select 1").alias("text")), {})
