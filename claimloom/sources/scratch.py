"""Tables that a step leaves for the next one, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder made here on one machine, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver's JVM ends."""
    path = f"{shared(spark)}/claimloom/{name}-{uuid.uuid4().hex}"
    fs, where = _file(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: lineage is cut, and a lost executor costs tasks that read the table anew."""
    path = f"{folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_written", None):
            fs, where = _file(t.sparkSession, path)
            fs.delete(where, True)
