"""What must not grow with the tables: rows that hold a group, tasks that make a key's pairs, columns of states, rounds over equals."""

import json
import time
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from claimloom.functions import canonical, utf8
from claimloom.functions.sorts import sort_name
from claimloom.operators import incremental, lattice, linking
from claimloom.plans import catalogue, kernel  # noqa: F401  (adds its queries to the catalogue)
from claimloom.sources import pool


def test_manifest_in_parts(spark, tmp_path):
    path, n = str(tmp_path / "p"), 20_000
    lines = spark.range(n).select(F.format_string('{"x":%d}', "id").alias("value"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("name"))
    pool.seal(pool.members(lines.unionByName(lines.withColumn("name", F.lit("all")))), path)
    m = spark.read.parquet(f"{path}/manifest")
    told = {r["name"]: (r.n, r.most, r.groups) for r in m.groupBy("name").agg(F.sum(F.size("member_cids")).alias("n"), F.max(F.size("member_cids")).alias("most"), F.countDistinct("group_cid").alias("groups")).collect()}
    assert {k: v[0] for k, v in told.items()} == {"even": n // 2, "odd": n // 2, "all": n}
    assert max(v[1] for v in told.values()) < 50 and {v[2] for v in told.values()} == {1}
    assert pool.manifest_gaps(spark, path).count() == 0
    # one id less in one part: the group's id is not its set's, and the member is unnamed
    part = m.filter("name = 'odd'").agg(F.min("part")).first()[0]
    less = m.withColumn("member_cids", F.when((F.col("name") == "odd") & (F.col("part") == part), F.slice("member_cids", 2, 1000)).otherwise(F.col("member_cids")))
    less.write.parquet(f"{path}/less")
    spark.read.parquet(f"{path}/less").write.mode("overwrite").parquet(f"{path}/manifest")
    assert {tuple(r) for r in pool.manifest_gaps(spark, path).collect()} == {("odd", "GroupCidMismatch"), ("odd", "MemberUnnamed")}


def test_floats_at_the_edges(spark, tmp_path):
    """Values of zero, without a value, tiny and not finite: the same as SQL."""
    values = [0.0, -0.0, None, 1e-310, float("inf"), float("-inf"), float("nan"), -3.5, 7.25] * 11
    pd.DataFrame({"event_id": range(len(values)), "value": pd.array(values, dtype="Float64")}).to_parquet(tmp_path / "events.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW events AS FROM '{tmp_path}/events.parquet'")
    for name in ("float_normal", "float_infinity_equal"):
        mine = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted((r.event_id, r.out) for r in mine) == sorted(duckdb.sql(catalogue.SQL[name]).fetchall()), name


def test_a_key_with_many_pairs(spark):
    a = spark.range(3000).select("id", F.lit(1).alias("domain"), (F.col("id") % 2).alias("to"))
    b = spark.range(40).select("id", F.lit(1).alias("domain"), F.array(F.col("id") % 2, F.col("id") % 3, F.lit(None)).alias("from"))
    got = linking.compose_endpoints(a, b, 500)
    want = [(i, j) for i in range(3000) for j in range(40) if i % 2 in (j % 2, j % 3)]
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == want and set(got.columns) == {"domain", "to", "a_id", "b_id"}
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < len(want) / 8  # two keys of 39,000 and 51,000 pairs
    assert linking.compose_endpoints(a.limit(0), b).count() == 0


def test_states_of_a_block_only():
    data = np.tile(np.frombuffer("aé€\U0001f600".encode() + b"\xe2\x82\xff\xf0\x9f\x98", np.uint8), 1000)
    off = np.array([0, 3, 3, 7000, 7001, len(data)])
    start, size, fine = utf8.runs(data, off)
    for block in (1, 2, 3, 5, 64, 1 << 20):
        at, n = utf8.broken(data, off, block)
        assert (at == start[~fine]).all() and (n == size[~fine]).all()
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(64)), pa.array([b"plain text " * 50_000] * 64)], names=["id", "data"])
    tracemalloc.start()
    assert sum(b.num_rows for b in utf8._chunked(iter([batch]))) == 64
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * batch.nbytes


def test_slices():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(7)), pa.array([b"x" * n if n is not None else None for n in (3, 0, 9, None, 2, 2, 1)])], names=["id", "data"])
    assert [s.column(0).to_pylist() for s in utf8._slices(batch, 5)] == [[0, 1], [2], [3, 4, 5, 6]]


def test_sorts_stop_at_an_atom(spark):
    d = spark.range(0, 3000, 1, 1).select(F.format_string("&mut Vec<S%d>", "id").alias("t"))

    def took(depth):
        t = time.time()
        assert d.select(sort_name(F.col("t"), depth).alias("s")).filter("s = 'RefMut<Vec<S7>>'").count() == 1
        return time.time() - t

    took(2)
    assert took(400) < 10 * took(6)


def test_forms_by_the_standard_encoder(monkeypatch):
    odd = ['{"b":[1,"é",null,true],"a":{"z":1,"y":"\\n\\u001f\\"\\\\/\\u007f"}}', '{"a":1.5}', '{"a":1.5,"a":1}', "[NaN]", "[-0, 1e2]", "﻿1", '"\\ud83d\\ude00"', "{", None, str(10**40), '{"B":1,"a":2,"\\u00e9":3}']
    want = ['{"a":{"y":"\\u000a\\u001f\\"\\\\/\x7f","z":1},"b":[1,"é",null,true]}', None, '{"a":1}', None, None, None, '"\U0001f600"', None, None, str(10**40), '{"B":1,"a":2,"é":3}']
    assert list(canonical.canonical.func(pd.Series(odd))) == want
    monkeypatch.setattr(canonical, "encode", None)
    plain = ['{"kind":"exists","name":"x","body":{"kind":"var","name":"x"}}']
    assert list(canonical.alpha_form.func(pd.Series(plain))) == ['{"body":{"kind":"var","name":"$b0"},"kind":"exists","name":"$b0"}']


def test_folds_by_the_standard_encoder(monkeypatch):
    monkeypatch.setattr(canonical, "encode", None)
    plain = ['{"kind":"ctor","name":"<<","args":[{"kind":"const","value":3},{"kind":"const","value":4}]}']
    assert list(canonical.alpha_form.func(pd.Series(plain))) == ['{"kind":"const","sort":{"kind":"primitive","name":"Int"},"value":48}']


def test_constants_as_they_are(monkeypatch):
    """A plain constant is not copied, a folded term needs no encoder; other texts come out as before."""
    const = {"kind": "const", "value": 3}
    assert canonical.alpha(const) is const
    deep = '{"kind":"const","value":[{"kind":"ctor","name":"^","args":[{"kind":"const","value":6},{"value":3,"kind":"const"}]}]}'
    ctor = '{"kind":"ctor","name":"%s","args":[{"kind":"const","value":%s},{"kind":"const","value":%s}]}'
    odd = [ctor % x for x in [("&", "true", "1"), ("|", '"1"', "1"), ("<<", "1", "128"), (">>", "1", "-1"), ("&", "1.5", "1"), ("+", "1", "2"), ("[]", "1", "2")]]
    plain = [json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")) for x in odd]
    plain[4] = None
    assert list(canonical.alpha_form.func(pd.Series([deep, " " + deep + "\n", deep + "}", "", None, *odd]))) == [f'{{"kind":"const","value":[{canonical._FOLDED}5}}]}}'] * 2 + [None] * 3 + plain
    monkeypatch.setattr(canonical, "_ENCODER", None)
    assert list(canonical.alpha_form.func(pd.Series([ctor % ("<<", -1, 127), ctor % ("|", 5, 2)]))) == [f"{canonical._FOLDED}{-(2**127)}}}", f"{canonical._FOLDED}7}}"]


def test_alike_sources_walk_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(lattice, "written", lambda d, name, own=lattice.written: made.append((name, t := own(d, name))) or t)
    edges = spark.range(2000).select(F.format_string("s%d", "id").alias("a"), F.format_string("h%d", F.col("id") % 3).alias("b"), (F.col("id") % 2).cast("int").alias("bits"))
    edges = edges.unionByName(spark.createDataFrame([("h0", "h1", 2), ("h1", "h2", 4), ("h2", "h0", 0), ("h1", "s5", 8)], "a string, b string, bits int"))
    got = {(r.source, r.target, r.bits) for r in lattice.least_losses(edges, spark.range(2000).select(F.format_string("s%d", "id").alias("source"))).collect()}
    first = {(i % 3, i % 2): i for i in range(6)}
    assert got == {(f"s{i}", t, b) for i in range(2000) for s, t, b in got if s == f"s{first[i % 3, i % 2]}"} and len({s for s, _, _ in got}) == 2000
    assert ("s0", "h0", 0) in got and ("s0", "h2", 6) in got and ("s0", "s5", 10) in got
    assert made[-1][1].select("source").distinct().count() == 6


def test_short_texts_are_their_own_ids(spark):
    texts = ["", "5", "x" * 40, "x" * 41, "null", "=5", None]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(incremental.content_id(F.col("t")).alias("c")).collect()]
    assert got[0] == "=" and got[1] == "=5" and got[2] == "=" + "x" * 40 and len(got[3]) == 64 and got[6] == "null" and len(set(got)) == len(texts)
    # items that make one text when they are put together are two sets
    rows = spark.createDataFrame([(1, "a"), (1, "b=c"), (2, "a=b"), (2, "c")], "k int, v string")
    assert rows.transform(lambda d: incremental.set_hash(d, ["k"], F.col("v"))).select("evidence").distinct().count() == 2
