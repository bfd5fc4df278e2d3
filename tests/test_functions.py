"""Good and lying twins of operators, and the edge cases that tables do not hold."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import canonical, scalars, sequences as S
from claimloom.functions.status import outcome
from claimloom.operators import census, claims, linking, versions
from claimloom.sources import pool
from claimloom.streaming.upsert import tumbling, upsert


def one(spark, col, **values):
    kinds = {k: v[1] for k, v in values.items()}
    df = spark.createDataFrame([tuple(v[0] for v in values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


ARR = lambda *x: (list(x), "array<int>")


def test_sequences_on_edges(spark):
    a = F.col("a")
    for values in ([], [1], [1, 2, 2, 9], [1, 3, 2], [5, None, 7]):
        v = ARR(*values)
        assert one(spark, S.take(a, 0), a=v) == []
        assert one(spark, S.take(a, 9), a=v) == values
        assert one(spark, S.skip(a, 9), a=v) == []
        assert one(spark, S.rev(a), a=v) == values[::-1]
        assert one(spark, S.chunks(a, 2), a=v) == [values[i : i + 2] for i in range(0, len(values), 2)]
        assert one(spark, S.windows(a, 2), a=v) == [values[i : i + 2] for i in range(len(values) - 1)]
        assert one(spark, S.rchunks(a, 2), a=v) == [values[max(0, e - 2) : e] for e in range(len(values), 0, -2)]
        assert one(spark, S.cycle_take(a, 3), a=v) == [values[i % len(values)] for i in range(3)] if values else True
    assert one(spark, S.is_sorted(a), a=ARR(1, 2, 2, 9)) is True
    assert one(spark, S.is_sorted(a), a=ARR(1, 3, 2)) is False
    assert one(spark, S.partition_point(a, lambda x: x < 3), a=ARR(1, 2, 3, 4, 5)) == 2
    assert one(spark, S.partition_point(a, lambda x: x < 3), a=ARR(1, 4, 2)) is None
    assert one(spark, S.int_range(3, 3)) == []
    with pytest.raises(ValueError):
        S.chunks(a, 0)


def test_scalars(spark):
    assert one(spark, scalars.trim(F.col("s")), s=(" \t hi ", "string")) == "hi"
    assert one(spark, scalars.ascii_upper(F.col("s")), s=("straße", "string")) == "STRAßE"
    assert one(spark, scalars.to_upper(F.col("s")), s=("straße", "string"))["status"] == "INCOMPLETE"
    assert one(spark, scalars.midpoint(F.lit(-3), F.lit(0)).cast("int")) == -1
    assert one(spark, scalars.wrapping_cast(F.lit(300), "i8").cast("int")) == 44
    assert one(spark, scalars.checked("div", F.lit(1), F.lit(0)))["reason"] == "DivisionByZero"
    assert one(spark, scalars.int_pow(F.lit(10).cast("long"), 19))["status"] == "REFUSED"
    assert one(spark, scalars.int_pow(F.lit(10).cast("long"), 18))["value"] == 10**18
    assert [one(spark, scalars.isqrt(F.lit(x).cast("long"))) for x in (0, 1, 15, 16, 10**16 - 1)] == [0, 1, 3, 4, 99999999]
    assert one(spark, outcome(F.lit(None).cast("int")))["status"] == "INCOMPLETE"


def test_canonical_text(spark):
    text = '{"b": [1, null, true], "a": "\\u0001\\"é", "c": 12345678901234567890}'
    assert one(spark, canonical.canonical(F.col("s")), s=(text, "string")) == '{"a":"\\u0001\\"é","b":[1,null,true],"c":12345678901234567890}'
    assert one(spark, canonical.canonical(F.col("s")), s=("[1.5]", "string")) is None
    f = lambda n: {"kind": "forall", "name": n, "body": {"kind": "atomic", "args": [{"kind": "var", "name": n}, {"kind": "var", "name": "p"}]}}
    assert canonical.alpha(f("x"), formals=("p",)) == canonical.alpha(f("y"), formals=("p",))
    assert json.dumps(canonical.alpha({"kind": "let", "name": "z", "value": {"kind": "var", "name": "p"}, "body": {"kind": "var", "name": "z"}}, formals=("p",))).count("$arg0") == 1


def test_lets_capture_nothing():
    var, lam = lambda n: {"kind": "var", "name": n}, lambda n, b: {"kind": "forall", "name": n, "body": b}
    let = lambda n, v, b: {"kind": "let", "name": n, "value": v, "body": b}
    assert canonical.alpha(let("z", var("x"), lam("x", var("z")))) == lam("$b0", var("x"))
    two = {"kind": "let", "bindings": [{"name": "a", "boundTerm": var("p")}, {"name": "b", "boundTerm": var("a")}], "body": {"kind": "ctor", "name": "f", "args": [var("a"), var("b")]}}
    assert canonical.alpha(two, formals=("p",))["args"] == [var("$arg0"), var("$arg0")]
    assert canonical.alpha(var("out")) == var("out") and canonical.alpha(var("r"), result="r") == var("$out")
    assert canonical.substitute(lam("x", {"kind": "ctor", "name": "f", "args": [var("x"), var("z")]}), "z", var("x"))["body"]["args"] == [var("x'"), var("x")]
    assert canonical.instantiate(lam("x", lam("y", {"kind": "ctor", "name": "f", "args": [var("x"), var("y")]})), [var("y"), var("q")])["args"] == [var("y"), var("q")]
    assert canonical.instantiate({"kind": "ctor", "name": "f", "args": [var("a"), var("b")]}, [var("b"), var("a")], ["a", "b"])["args"] == [var("b"), var("a")]


def test_ground_bitwise_terms():
    const = lambda v: {"kind": "const", "value": v, "sort": {"kind": "primitive", "name": "Int"}}
    op = lambda n, x, y: canonical.alpha({"kind": "ctor", "name": n, "args": [const(x), const(y)]})
    assert op("&", 12, 10) == const(8) and op("^", -1, 1) == const(-2) and op("<<", 1, 127) == const(-(2**127)) and op(">>", -8, 1) == const(-4)
    assert op("<<", 1, 128)["kind"] == "ctor" and op("+", 1, 2)["kind"] == "ctor"
    nested = {"kind": "ctor", "name": "|", "args": [{"kind": "ctor", "name": "<<", "args": [const(1), const(4)]}, const(1)]}
    assert canonical.alpha(nested) == const(17) and canonical.rendered(nested) == "((1 << 4) | 1)"


def test_numbers_and_texts_have_different_ids(spark):
    got = [one(spark, canonical.canonical(F.col("s")), s=(t, "string")) for t in ("1000000000000000000", '"1000000000000000000"')]
    assert got[0] != got[1]


def test_integer_edges(spark):
    lo, hi = -(2**63), 2**63 - 1
    big = lambda x: F.lit(x).cast("long")
    assert one(spark, scalars.floor_div(big(9007199254740993), big(1))) == 9007199254740993
    assert [one(spark, scalars.floor_div(big(a), big(b))) for a, b in ((-7, 2), (7, -2), (-6, 3), (lo, -1), (5, 0))] == [-4, -4, -2, None, None]
    assert [one(spark, scalars.floor_mod(big(a), big(b))) for a, b in ((-7, 2), (7, -2), (lo, -1), (5, 0))] == [1, -1, 0, None]
    assert [one(spark, scalars.isqrt(big(x))) for x in (hi, 3037000499**2, 3037000499**2 - 1, -1)] == [3037000499, 3037000499, 3037000498, None]
    assert one(spark, scalars.checked("div", big(lo), big(-1)))["status"] == one(spark, scalars.checked("rem", big(lo), big(-1)))["status"] == "REFUSED"
    assert one(spark, scalars.wrapping_neg(big(lo), "i64")) == lo and one(spark, scalars.wrapping_cast(F.lit(-1), "u64")) == 2**64 - 1
    assert one(spark, scalars.checked("add", F.lit(str(2**64 - 1)).cast("decimal(38,0)"), F.lit(1), "u64"))["status"] == "REFUSED"


def test_float_bits_of_nulls(spark):
    null, nan = F.lit(None).cast("double"), F.lit(float("nan"))
    assert one(spark, scalars.float_bits(null)) is None and one(spark, scalars.from_bits(F.lit(None).cast("long"))) is None and one(spark, scalars.integer_decode(null)) is None
    assert one(spark, scalars.from_bits(scalars.float_bits(F.lit(-0.0)))).hex() == "-0x0.0p+0" and one(spark, scalars.float_bits(nan)) == 0x7FF8 << 48
    d = one(spark, scalars.integer_decode(F.lit(-0.75)))
    assert d["sign"] * d["mantissa"] * 2.0 ** d["exponent"] == -0.75


def test_containers_on_edges(spark):
    a = F.col("a")
    for values in ([], [1], [1, 2, 3, 4, 5]):
        v = ARR(*values)
        for lo, hi, step in ((None, None, 1), (-3, None, 1), (1, -1, 2), (None, None, -1), (4, 0, -2), (-9, 9, 3), (9, -9, -1)):
            assert one(spark, S.stepped(a, lo, hi, step), a=v) == values[lo:hi:step], (values, lo, hi, step)
        assert one(spark, S.insert(a, -1, F.lit(9)), a=v) == (values[:-1] + [9] + values[-1:])
        assert one(spark, S.unpack(a, 1, 1), a=v) == ((values[:1], values[1:-1], values[-1:]) if len(values) > 1 else None)
    assert one(spark, S.pop(a), a=ARR()) is None and one(spark, S.set_item(a, 1, F.lit(0)), a=ARR(1)) is None
    assert one(spark, S.capped(a, lambda x: F.size(x), 2), a=ARR(1, 2, 3))["reason"] == "LengthCap"
    assert one(spark, S.scan(a, F.lit(0), lambda s, x: s + x), a=ARR()) == [] and one(spark, S.scan(a, F.lit(1), lambda s, x: s * x), a=ARR(2, 3)) == [2, 6]


def test_walks_end_on_cycles(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rel = spark.createDataFrame([("b", "a", 1), ("c", "b", 5), ("a", "c", 2), ("a", None, 2), ("d", "b", 4)], "set_cid string, previous_set_cid string, declared_at int").withColumns({"signer": F.lit("s"), "channel": F.lit("m")})
    walk = versions.version_walk(rel, "a", ["s"], "m")
    assert sorted((r.set_cid, r.step) for r in walk.collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]
    assert versions.latest_release(walk).first()["set_cid"] == "c" and versions.version_walk(rel, "zz", ["s"], "m").count() == 0
    chain = spark.createDataFrame([(f"r{i}", f"r{i - 1}", i) for i in range(20)], "set_cid string, previous_set_cid string, declared_at int").withColumns({"signer": F.lit("s"), "channel": F.lit("m")})
    assert sorted(r.step for r in versions.version_walk(chain, "r0", ["s"], "m").collect()) == list(range(20))  # as far as it goes
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 4), (5, 1), (6, 7)], "a int, b int")
    assert sorted(r.a for r in linking.on_cycles(e, "a", "b").collect()) == [1, 2, 4]
    assert sorted(r.node for r in claims.reaching(e, "a", "b", spark.createDataFrame([(3,)], "node int")).collect()) == [1, 2, 5]
    ranked = census.positions(spark.createDataFrame([(i % 3, i) for i in range(50)], "c int, k int"), F.desc("c"), F.col("k")).collect()
    assert [(r.c, r.k) for r in sorted(ranked, key=lambda r: r.position)] == sorted(((i % 3, i) for i in range(50)), key=lambda x: (-x[0], x[1])) and {r.position for r in ranked} == set(range(50))


def test_links_by_id_and_smallest_name(spark):
    pool_ = spark.createDataFrame([("c2", "f"), ("c1", "f"), ("c1", "f"), ("c3", "g")], "cid string, name string")
    edges = spark.createDataFrame([(1, "zz", "k:f"), (2, None, "k:f"), (3, None, "h"), (4, None, None)], "i int, target_cid string, target_symbol string")
    assert sorted((r.i, r.linked_cid) for r in claims.link_edges(edges, pool_).collect()) == [(1, "zz"), (2, "c1"), (3, None), (4, None)]


def test_registry_orders_and_refuses():
    from claimloom.plans.records import operators

    r = operators()
    names = [n for n, _, _ in r.roster()]
    assert names.index("twice") < names.index("sum")
    with pytest.raises(ValueError):
        r.add(r.operators["sum"])
    with pytest.raises(ValueError):
        r.build({"kind": "unknown"})


PLANS = [  # seats' verdicts in order, consensus, first definitive verdict
    (["Discharged", "Discharged"], "Discharged", "Discharged"),
    (["Discharged", "Unsatisfied"], "Disagreement", "Discharged"),
    (["Undecidable", "Unsatisfied"], "Unsatisfied", "Unsatisfied"),
    (["Undecidable", "SolverTimeout"], "Undecidable", "Undecidable"),
]


def test_portfolios(spark):
    rows = [(i, k, v) for i, (seats, _, _) in enumerate(PLANS) for k, v in enumerate(seats)]
    got = claims.portfolio(spark.createDataFrame(rows, "g int, seat int, verdict string"), ["g"]).collect()
    assert sorted((r.g, r.consensus, r.first_wins) for r in got) == [(i, c, f) for i, (_, c, f) in enumerate(PLANS)]


def test_superposition_drops_unlicensed(spark):
    v = spark.createDataFrame([("a", "p1", "Discharged"), ("a", "p2", "Disagreement"), ("b", "p1", "Unsatisfied"), ("c", "p1", "Discharged"), ("c", "p1", "Discharged")], "symbol string, pin string, verdict string")
    got = {r.symbol: (r.licensing, r.findings, r.strength) for r in claims.superposition(v).collect()}
    assert got == {"a": (["p1"], ["p2"], "Weak"), "c": (["p1"], [], "Strong")}


def test_closure_ends_on_cycles(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a int, b int")
    assert {tuple(r) for r in claims.closure(e, "a", "b").collect()} == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)} | {(4, 5)}


def test_closure_shapes(spark):
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    shape = lambda a, b: versions.closure_delta(rows(*a), rows(*b), ["k"]).first()["shape"]
    assert shape([1, 2], [1, 2]) == "unchanged" and shape([1], []) == "empty" and shape([1, 2], [1]) == "strict-subset"
    assert shape([1], [1, 2]) == "grew" and shape([1, 2], [2, 3]) == "non-monotonic"


def test_lpt():
    assert census.lpt([("a", 3.0), ("b", 3.0), ("c", 2.0), ("d", 1.0)], 2) == {"a": 0, "b": 1, "c": 0, "d": 1}


def test_pool_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([('{"name":"f","x":1}', "f"), ('{"x":1, "name":"f"}', "f"), ('{"name":"g"', "g")], "value string, name string")
    m = pool.members(lines)
    assert m.filter("cid is null").count() == 1
    pool.seal(m, str(tmp_path / "p"))
    good, bad = pool.load(spark, str(tmp_path / "p"))
    assert good.count() == 1 and bad.count() == 0
    edge = {"edges": [{"sourceContractCid": "a", "targetSymbol": "k:f", "callSiteLocus": {"file": "x", "line": 1, "col": 2}}]}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "m.call-edges.json").write_text(json.dumps(edge))
    assert pool.call_edges(spark, str(tmp_path / "e")).first()["target_symbol"] == "k:f"
    ok, err = pool.decode(spark.createDataFrame([('{"line":1}',), ('{"line":"x"}',), ("{}",)], "t string"), "t", pool.LOCUS)
    assert ok.count() == 2 and err.count() == 1


def test_streams(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "cid string, v int").write.parquet(str(tmp_path / "in"), mode="overwrite")
    for k in range(2):
        s = spark.readStream.schema("cid string, v int").parquet(str(tmp_path / "in"))
        upsert(s, str(tmp_path / "out"), str(tmp_path / f"c{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert tumbling(spark.read.parquet(f"{sf}/events.parquet")).agg(F.sum("n")).first()[0] > 0


def test_sort_names(spark):
    from claimloom.functions.sorts import sort_name

    want = {
        "&str": "Ref<Str>", "&'a str": "Ref<Str>", "&'a mut u32": "RefMut<Int>", "i128": "Int", "String": "String", "Vec<u32>": "Vec<Int>", "Thing": "Thing", "crate::a::Thing": "Thing", "()": "Unit", "(u8,)": "Tuple<Int>", "(A<B>, C<D>)": "Tuple<A<B>,C<D>>",
        "[[u8; 4]]": "Slice<Array<Int>>", "*mut T": "PtrMut<T>", "impl Iterator": "Opaque", "&dyn Send": "Ref<Opaque>", "fn()": "FnPtr", "fn(u8) -> (u8, bool)": "FnPtr", "Option<fn(u8)>": "Option<FnPtr>", "!": "Never", "_": "Infer", "Cow<'a, str>": "Cow<Str>", "Foo<'a>": "Foo",
        "": "Unknown", "&": "Unknown", "(u8": "Unknown", "u8 u8": "Unknown", None: None,
    }
    got = {r.t: r.s for r in spark.createDataFrame([(k,) for k in want], "t string").select("t", sort_name(F.col("t")).alias("s")).collect()}
    assert got == want
