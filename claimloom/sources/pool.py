"""Reading and writing claim pools: members with ids that are derived again, sidecar edges, sealed bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.canonical import canonical, cid, set_cid

LOCUS = T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType())])
EDGE = T.StructType([T.StructField("sourceContractCid", T.StringType()), T.StructField("targetContractCid", T.StringType()), T.StructField("targetSymbol", T.StringType()), T.StructField("callSiteLocus", LOCUS)])


def members(lines: DataFrame, text: str = "value") -> DataFrame:
    """``cid, body`` of one JSON claim per row; broken claims have a null id."""
    return lines.withColumn("body", canonical(F.col(text))).withColumn("cid", F.when(F.col("body").isNotNull(), cid(F.col("body"))))


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A sealed pool's members whose id agrees with their bytes, and the load errors."""
    rows = spark.read.parquet(f"{path}/members").withColumn("_again", cid(F.col("body")))
    bad = F.coalesce(F.col("cid") != F.col("_again"), F.lit(True))
    return rows.filter(~bad).drop("_again").dropDuplicates(["cid", "name"]), rows.filter(bad).select("cid", F.lit("CidMismatch").alias("reason"))


def _group_cids(parts: DataFrame) -> DataFrame:
    """``name, group_cid``: the id of the set of a group's part ids."""
    return parts.groupBy("name").agg(set_cid(F.collect_list("part_cid")).alias("group_cid"))


def seal(claims: DataFrame, path: str) -> None:
    """Members and a manifest of groups (by ``name``); a body under two names is a member of both.

    The manifest has a row for each group and part (of 4,096, by the ids' hash): its sorted ids, the id of their set and the group's id, which is
    that of the set of its parts.  So no row holds a large group.
    """
    rows = claims.filter("cid is not null").dropDuplicates(["cid", "name"])
    rows.write.mode("overwrite").parquet(f"{path}/members")
    again = claims.sparkSession.read.parquet(f"{path}/members")
    parts = again.groupBy("name", F.substring(F.sha2("cid", 256), 1, 3).alias("part")).agg(F.array_sort(F.collect_set("cid")).alias("member_cids"))
    parts.withColumn("part_cid", set_cid(F.col("member_cids"))).write.mode("overwrite").parquet(f"{path}/parts")
    parts = claims.sparkSession.read.parquet(f"{path}/parts")
    parts.join(_group_cids(parts).withColumnRenamed("name", "_name"), F.col("name").eqNullSafe(F.col("_name"))).drop("_name").withColumn("version", F.lit(1)).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest_gaps(spark: SparkSession, path: str) -> DataFrame:
    """``name, reason`` of groups whose manifest does not stand: an id that is not its set's, a member that is missing, a member that it does not name."""
    m = spark.read.parquet(f"{path}/manifest")
    again = _group_cids(m.withColumn("part_cid", set_cid(F.col("member_cids")))).select(F.col("name").alias("_name"), F.col("group_cid").alias("_again"))
    stale = m.join(again, F.col("name").eqNullSafe(F.col("_name"))).filter(~F.col("group_cid").eqNullSafe(F.col("_again"))).select("name", F.lit("GroupCidMismatch").alias("reason")).distinct()
    said = m.select("name", F.explode("member_cids").alias("cid")).withColumn("_said", F.lit(True))
    have = load(spark, path)[0].select("name", "cid").withColumn("_have", F.lit(True))
    both = said.join(have, ["name", "cid"], "full_outer")
    why = F.when(F.col("_have").isNull(), "MemberMissing").when(F.col("_said").isNull(), "MemberUnnamed")
    return stale.unionByName(both.select("name", why.alias("reason")).filter("reason is not null").distinct())


def call_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of all ``*.call-edges.json`` files below ``path``."""
    files = spark.read.schema(T.StructType([T.StructField("edges", T.ArrayType(EDGE))])).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.call-edges.json").json(path)
    e = files.select(F.explode("edges").alias("e"))
    return e.select(F.col("e.sourceContractCid").alias("source_cid"), F.col("e.targetContractCid").alias("target_cid"), F.col("e.targetSymbol").alias("target_symbol"), F.col("e.callSiteLocus").alias("locus"))


def decode(lines: DataFrame, text: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Strict decoding: a missing optional field is null, a field that cannot be decoded makes the row an error."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = lines.withColumn("_r", F.from_json(F.col(text), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt_record").isNotNull()
    return rows.filter(~bad).select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields]), rows.filter(bad).select(F.col(text).alias("raw"), F.lit("Undecodable").alias("reason"))


def file_cids(spark: SparkSession, path: str) -> DataFrame:
    """Content ids of all files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.concat(F.lit("sha2-512:"), F.sha2("content", 512)).alias("cid"))


def enumerated(rows: DataFrame, payload: list[str], broken: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """An enumeration's nodes and its gaps: what cannot be given is a row with a reason, never silence."""
    bad = F.coalesce(broken, F.lit(True))
    return rows.filter(~bad).select(F.struct(*payload).alias("payload")), rows.filter(bad).select(F.struct(*payload).alias("memento"), reason.alias("reason"))


def dump(rows: DataFrame) -> DataFrame:
    """Each member as one line of JSON, keys in order of name, nulls left out."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("line"))


def save_results(rows: DataFrame, path: str, manifest: str, part: str) -> None:
    """Per-part results bound to a manifest: parts of a run that is repeated replace themselves, other parts and manifests stay."""
    rows.withColumn("manifest", F.lit(manifest)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("manifest", part).parquet(path)


def saved_results(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("manifest") == manifest).drop("manifest")
