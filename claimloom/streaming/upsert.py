"""Streams into the pool: idempotent by content id."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an upserted table; a batch reads only those that its keys fall into.
FOLDERS = 256


def upsert(stream: DataFrame, path: str, checkpoint: str, key: str = "cid"):
    """A query that appends each micro-batch's new keys to a Parquet table; a batch that is run again adds nothing.

    Rows without a key have no identity and are left out.  The table is partitioned by a hash of the key (``_folder``).
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        folder = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(FOLDERS)).cast("int")
        fresh = batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_folder", folder)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            touched = [r["_folder"] for r in fresh.select("_folder").distinct().collect()]  # FOLDERS numbers at most
            have = spark.read.parquet(path).filter(F.col("_folder").isin(*touched)).select(key, "_folder")
            fresh = fresh.join(have, [key, "_folder"], "left_anti")
        fresh.write.mode("append").partitionBy("_folder").parquet(path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an upserted table."""
    return spark.read.parquet(path).drop("_folder")


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums in event-time windows, late rows bounded by a watermark (streaming or batch)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def heartbeat(spark: SparkSession, lines: list[str]):
    """A listener that appends a line for each start, progress and end of the session's stream queries; remove it with ``spark.streams.removeListener``."""
    from pyspark.sql.streaming import StreamingQueryListener

    say = lambda what, q, n="": lines.append(f"{time.time():.3f} {what} {q} {n}".rstrip())

    class Heartbeat(StreamingQueryListener):
        def onQueryStarted(self, event):
            say("started", event.id)

        def onQueryProgress(self, event):
            say("progress", event.progress.id, event.progress.numInputRows)

        def onQueryIdle(self, event):
            say("idle", event.id)

        def onQueryTerminated(self, event):
            say("ended", event.id, event.exception or "")

    listener = Heartbeat()
    spark.streams.addListener(listener)
    return listener
