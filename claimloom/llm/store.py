"""Tables in the folder that driver and executors share, and names that no caller's column has."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch between JVM and Python, at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder made here on one machine, and an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB between JVM and Python, whatever the texts' lengths: both sides hold some of them off the heap.

    The plan reads these settings when it runs, after the operator has returned, so they stay lowered; a smaller setting of the session is left alone.
    """
    for key, most in BATCH.items():
        have = spark.conf.get(key, None)
        if not (have and have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(key, str(most))


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again.

    This cuts the lineage: a lost executor costs only tasks that read the table
    anew.  The files are removed when the driver's JVM ends in good order, or by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/claimloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    temporary(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def temporary(spark: SparkSession, path: str) -> None:
    """Have ``path`` removed when the driver's JVM ends, whether it exists by now or not."""
    fs, where = _file(spark, path)
    if not fs.exists(where):
        fs.mkdirs(where)
    fs.deleteOnExit(where)


def discard(*tables: DataFrame) -> None:
    """Remove the files of stored tables that nothing reads any more: all that was made of them is stored itself."""
    for t in tables:
        if path := getattr(t, "_stored_path", None):
            fs, where = _file(t.sparkSession, path)
            fs.delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in the shared folder: lineage is cut, and partitions and their order stay as they are."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them as far as columns of ``df`` have them (in either case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
