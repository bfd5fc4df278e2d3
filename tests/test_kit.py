"""Enumeration as a data source: nodes, gaps, seeks, refusals, pushed filters."""

import hashlib
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from claimloom.sources import kit


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    path = tmp_path_factory.mktemp("kit")
    pq.write_table(pa.table({"k": list(range(1000)), "v": [f"é{i % 7}" for i in range(1000)]}), path / "a.parquet", row_group_size=100)
    pq.write_table(pa.table({"k": pa.array([], pa.int64())}), path / "empty.parquet")
    (path / "broken.parquet").write_bytes(b"PAR1 no table")
    (path / "notes.txt").write_text("no source")
    return path


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_levels(spark, workspace):
    got = {r.file: r for r in kit.enumerated(spark, str(workspace), "source_files").collect()}
    assert set(got) == {"a.parquet", "empty.parquet", "broken.parquet"}
    for name, r in got.items():
        data = (workspace / name).read_bytes()
        assert (r.kind, r.cid, json.loads(r.payload)) == ("node", hashlib.sha256(data).hexdigest(), {"bytes": len(data)})
    facts = kit.enumerated(spark, f"file://{workspace}", "facts", at="a.parquet").orderBy("ordinal").collect()
    assert [r.ordinal for r in facts] == list(range(1000)) and json.loads(facts[9].payload) == {"k": 9, "v": "é2"}
    assert facts[9].cid == hashlib.sha256('{"k":9,"v":"é2"}'.encode()).hexdigest()
    assert rows(kit.enumerated(spark, str(workspace), "facts", at="empty.parquet")) == []
    assert rows(kit.enumerated(spark, str(workspace / "nowhere"), "source_files")) == []


def test_gaps(spark, workspace):
    cid = hashlib.sha256((workspace / "a.parquet").read_bytes()).hexdigest()
    one = lambda **o: rows(kit.enumerated(spark, str(workspace), "facts", **o))
    gap = lambda file, why: [("gap", file, None, None, None, why)]
    assert one() == gap("", "no-file-named") and one(at="b.parquet") == gap("b.parquet", "missing-file") and one(at="../a.parquet") == gap("../a.parquet", "outside-workspace")
    assert one(at="broken.parquet") == gap("broken.parquet", "unreadable") and one(at="a.parquet", cid="0" * 64) == gap("a.parquet", "stale-cid")
    assert len(one(at="a.parquet", cid=cid)) == 1000


def test_seeks_and_refusals(spark, workspace):
    assert [r[2] for r in rows(kit.enumerated(spark, str(workspace), "facts", at="a.parquet", seek="true", ordinal=345))] == [345]
    assert rows(kit.enumerated(spark, str(workspace), "facts", at="a.parquet", seek="true", ordinal=5000)) == []
    for level, options in (("functions", {}), ("source_files", {"seek": "true", "ordinal": 1}), ("facts", {"at": "a.parquet", "seek": "true"})):
        with pytest.raises(Exception, match="Refused"):
            kit.enumerated(spark, str(workspace), level, **options).collect()


def test_filters_are_pushed(spark, workspace):
    facts = kit.enumerated(spark, str(workspace), "facts", at="a.parquet")
    near = facts.filter("ordinal >= 250 and ordinal < 320 and payload like '%é1%'")
    assert sorted(r.ordinal for r in near.collect()) == [i for i in range(250, 320) if i % 7 == 1]
    assert near.rdd.getNumPartitions() == 2  # of ten row groups
    assert facts.filter(F.col("ordinal") == 77).count() == 1 and facts.filter("ordinal > 999").count() == 0 and facts.filter("file = 'b'").count() == 0
    assert kit.enumerated(spark, str(workspace), "source_files").filter("file = 'a.parquet'").count() == 1
    reader = kit.KitReader({"workspace": str(workspace), "level": "facts", "at": "a.parquet"})
    left = list(reader.pushFilters([kit.GreaterThan(("ordinal",), 949), kit.EqualTo(("cid",), "x")]))
    assert left == [kit.EqualTo(("cid",), "x")] and [p.group for p in reader.partitions()] == [9]
