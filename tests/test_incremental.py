"""Recomputation after a change: only dependants, early cut-off, wrong dependencies, edit buffers."""

import pytest
from pyspark.sql import functions as F

from claimloom.operators import incremental
from claimloom.operators.incremental import Workspace, content_id, set_hash

RULES = {
    1: lambda d: d.groupBy("node").agg((F.sum(F.col("value").cast("long")) / 10).cast("long").cast("string").alias("value")),
    2: lambda d: d.groupBy("node").agg(F.max(F.col("value").cast("long")).cast("string").alias("value")),
}
DEPS = [("a", 1, "x", True), ("a", 1, "y", True), ("b", 1, "z", True), ("c", 1, "z", False), ("top", 2, "a", True), ("top", 2, "b", True)]


@pytest.fixture(scope="module")
def frames(spark):
    src = lambda rows: spark.createDataFrame(rows, "id string, value string")
    dep = lambda rows: spark.createDataFrame(rows, "node string, level int, input string, complete boolean")
    return src, dep


def told(df):
    return {r.id: (r.value, r.status) for r in df.collect()}


def test_only_dependants_and_cut_off(spark, frames):
    src, dep = frames
    w = Workspace(spark)
    one = [("x", "10"), ("y", "25"), ("z", "7")]
    assert told(w.refresh(src(one), dep(DEPS), RULES)) == {"a": ("3", "recomputed"), "b": ("0", "recomputed"), "c": ("0", "recomputed"), "top": ("3", "recomputed")}
    # nothing changed
    assert {s for _, s in told(w.refresh(src(one), dep(DEPS), RULES)).values()} == {"kept"}
    # y moves within a's bracket: a is computed again, comes out the same, and top is not touched; c does not know what it reads
    two = [("x", "10"), ("y", "26"), ("z", "7")]
    assert told(w.refresh(src(two), dep(DEPS), RULES)) == {"a": ("3", "recomputed"), "b": ("0", "kept"), "c": ("0", "recomputed"), "top": ("3", "kept")}
    # an edit buffer is tried and leaves nothing behind
    buffer = [("x", "99"), ("y", "26"), ("z", "7")]
    assert told(w.refresh(src(buffer), dep(DEPS), RULES, commit=False))["top"] == ("12", "recomputed")
    assert {s for _, s in told(w.refresh(src(two), dep(DEPS), RULES)).values()} == {"kept"}
    # back to the first sources: all from the cache, the coarse context too
    assert told(w.refresh(src(one), dep(DEPS), RULES)) == {"a": ("3", "hit"), "b": ("0", "kept"), "c": ("0", "hit"), "top": ("3", "kept")}


def test_wrong_dependencies_only_miss(spark, frames):
    """Dependencies that are dropped, added or swapped give what a full run over them gives; none is answered from another's entry."""
    src, dep = frames
    w = Workspace(spark)
    rows = [("x", "10"), ("y", "25"), ("z", "70")]
    w.refresh(src(rows), dep(DEPS), RULES)
    for wrong in (DEPS[1:], [*DEPS, ("b", 1, "x", True)], [("a", 1, "z", True), *DEPS[2:]], [*DEPS, ("a", 1, "nowhere", True)]):
        got, full = told(w.refresh(src(rows), dep(wrong), RULES)), told(Workspace(spark).refresh(src(rows), dep(wrong), RULES))
        assert {k: v for k, (v, _) in got.items()} == {k: v for k, (v, _) in full.items()}


def test_sources_and_nodes_that_go(spark, frames):
    src, dep = frames
    w = Workspace(spark)
    w.refresh(src([("x", "10"), ("y", "25"), ("z", None)]), dep(DEPS), RULES)
    got = told(w.refresh(src([("x", "10"), ("y", "25")]), dep(DEPS), RULES))
    assert "b" not in got and got["a"][1] == "kept" and got["top"] == ("3", "recomputed")
    assert told(w.refresh(src([]), dep([]), RULES)) == {}


def test_set_hash(spark):
    rows = [(i % 3, f"v{i}") for i in range(3000)] + [(0, "v0")] * 5
    a = {r.k: r.evidence for r in set_hash(spark.createDataFrame(rows, "k int, v string"), ["k"], F.col("v")).collect()}
    b = {r.k: r.evidence for r in set_hash(spark.createDataFrame(rows[::-1], "k int, v string").repartition(3), ["k"], F.col("v")).collect()}
    c = {r.k: r.evidence for r in set_hash(spark.createDataFrame(rows[1:3000], "k int, v string"), ["k"], F.col("v")).collect()}
    assert a == b and len(set(a.values())) == 3 and a[1] == c[1] and a[0] != c[0]
    assert spark.range(1).select(content_id(F.lit(None)).alias("c")).first().c == "null"


def test_sums_where_rows_lie(spark, frames, monkeypatch):
    """A set's hash needs a row a task and key: no list of items, and for the context of all sources one exchange of single rows."""
    rows = spark.range(0, 20_000, 1, 4).select((F.col("id") % 2).alias("k"), F.format_string("v%d", "id").alias("v"))
    for key in (["k"], []):
        made = set_hash(rows, key, F.col("v"))
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "collect_" not in plan and plan.count("partial_sum") and plan.split("Final Plan")[-1].split("Initial Plan")[0].count("Exchange") == 1, key
    # the first commit looks for nothing that moved, and inputs meet their values once a level
    src, dep = frames
    names = []
    monkeypatch.setattr(incremental, "written", lambda d, name, own=incremental.written: names.append(name) or own(d, name))
    Workspace(spark).refresh(src([("x", "10"), ("y", "25"), ("z", "7")]), dep(DEPS), RULES)
    assert "moved" not in names and names.count("g1-items") == 2 and names.count("g1-context") == 1
