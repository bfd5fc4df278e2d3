"""Linking and mapping operators on empty, null and repeated rows."""

from pyspark.sql import functions as F

from claimloom.functions import mappings as M
from claimloom.operators import linking


def test_empty_and_null_inputs(spark):
    none = spark.createDataFrame([], "claim long, nodes array<string>")
    bridges = spark.createDataFrame([("a", 1), (None, 2)], "source_symbol string, target_cid long")
    assert linking.callsites(none, bridges).count() == 0
    sites = linking.callsites(spark.createDataFrame([(1, ["a", None, "a"]), (2, None), (3, [])], "claim long, nodes array<string>"), bridges).collect()
    assert sorted((r.claim, r.pos, r.resolved) for r in sites) == [(1, 0, True), (1, 1, False), (1, 2, True)]


def test_yank_policies(spark):
    rel = spark.createDataFrame([("x", "me"), ("y", "me"), ("z", "me")], "set_cid string, signer string")
    yanks = spark.createDataFrame([("x", "me"), ("x", "me"), ("y", "audit"), ("z", "other")], "set_cid string, signer string")
    kept = lambda p: sorted((r.set_cid, r.warned) for r in linking.apply_yanks(rel, yanks, p, ["audit"]).collect())
    assert kept("strict") == [("y", False), ("z", False)]
    assert kept("audit") == [("x", False), ("z", False)]
    assert kept("permissive") == [("x", True), ("y", True), ("z", True)]


def test_unknown_costs_without_evidence(spark):
    rows = spark.createDataFrame([("g", "a", 5, None), ("g", "b", -1, None)], "g string, path string, size_bytes long, cost_s double")
    assert [r.estimate for r in linking.estimate_costs(rows, ["g"]).collect()] == [1.0, 1.0]


def test_constraints_at_top(spark):
    r = spark.sql("select array(1, 2) a, array(2, 3) b, cast(null as array<int>) t").select(linking.sequential(F.col("a"), F.col("b")), linking.branched(F.col("a"), F.col("b")), linking.branched(F.col("a"), F.col("t")), linking.sequential(F.col("t"), F.col("b"))).first()
    assert tuple(r) == ([1, 2, 3], [2], None, None)


def test_mappings(spark):
    d = spark.sql("select map('a', 1, 'b', 2) d, map('b', 3) e, cast(map() as map<string, int>) z, 'x' as bad, '{\"a\": [1]}' as good")
    r = d.select(M.map_text(M.merge("d", "e")), M.map_text(M.merge("z", "e")), M.pop("d", F.lit("q"))["value"], M.map_text(M.set_default("z", F.lit("k"), F.lit(7))), M.json_valid(F.col("bad")), M.json_type(F.col("good")), M.json_type(F.lit("[]"))).first()
    assert tuple(r) == ("a=1,b=3", "b=3", None, "k=7", False, "object", "array")


def test_first_failure(spark):
    r = spark.range(1).select(M.try_map(F.array(F.lit(1), F.lit(0), F.lit(-1)), lambda x: F.when(x > 0, x))["err"], M.try_map(F.array().cast("array<int>"), lambda x: x)["ok"], M.membership(F.array().cast("array<int>"), F.lit(1)), M.char_range(F.lit(0xD7FF), F.lit(0xE001))).first()
    assert tuple(r) == (1, [], "out", "\ud7ff\ue000")
