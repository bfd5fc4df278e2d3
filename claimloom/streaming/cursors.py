"""Consumption state of single-pass iterators: versions, occurrence counters, refusal on re-use.

Each key is an iterator; its operations, in order of event time and then id, are

* ``define``: a new version; its occurrences begin anew;
* ``advance``: takes from the iterator; the first occurrence in a statement is the version itself (``@def<v>``), later ones are ``@adv<n>``;
* ``consume``: takes all that is left; what comes behind it in this version is refused;
* ``reset``: a new statement; occurrences begin anew, versions and consumption stay.

An operation before any definition has no standing and is refused too; refused ones count as no occurrence.  Null and unknown operations are refused.

:func:`batch` is the answer over a table, by windows.  :func:`stream` gives the same rows from a stream whose rows come in any
order within the watermark's delay: they wait in buckets of event time, and a timer of each bucket, which fires when the
watermark has passed it, works its rows off in order.  Up to ``few`` rows of a key wait together, with one timer for the earliest
bucket, as each look at a state or timer is a message between processes; a key that once has more waits in a row a bucket from then on.
State is a counter row a key and what waits; a restart goes on from the checkpoint.  Rows behind the watermark are dropped, as by every stateful operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPERATIONS = ("define", "advance", "consume", "reset")
#: Milliseconds of event time that wait and are worked off together.
BUCKET_MS = 6 * 3_600_000
#: Rows of a key that wait as one row of state with one timer.
FEW = 500
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def batch(rows: DataFrame) -> DataFrame:
    """``key, id, version, occurrence, alias, outcome`` of each row of ``rows`` (``key, ts, id, op``)."""
    order = ["ts", "id"]
    past = Window.partitionBy("key").orderBy(*order)
    out = rows.withColumn("version", F.count_if(F.col("op") == "define").over(past))
    out = out.withColumn("_part", F.count_if(F.col("op").isin("define", "reset")).over(past))
    before = Window.partitionBy("key", "version").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_gone", F.coalesce(F.count_if(F.col("op") == "consume").over(before), F.lit(0)) > 0)
    takes = F.coalesce(F.col("op").isin("advance", "consume"), F.lit(False))
    known = F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False))
    refused = F.when(~known, "refused:unknown").when(takes & (F.col("version") == 0), "refused:undefined").when(takes & F.col("_gone"), "refused:consumed")
    out = out.withColumn("_refused", refused)
    taken = takes & F.col("_refused").isNull()
    inside = Window.partitionBy("key", "_part").orderBy(*order)
    out = out.withColumn("occurrence", F.when(taken, F.count_if(taken).over(inside) - 1))
    alias = F.when(F.col("occurrence") == 0, F.concat(F.lit("@def"), "version")).when(F.col("occurrence") > 0, F.concat(F.lit("@adv"), "occurrence"))
    return out.select("key", "id", "version", "occurrence", alias.alias("alias"), F.coalesce("_refused", "op").alias("outcome"))


OUTPUT = "key string, id long, version long, occurrence long, alias string, outcome string"


class _Cursor(StatefulProcessor):
    def __init__(self, bucket_ms: int, few: int):
        self.bucket_ms, self.few = bucket_ms, few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "version long, occurrence long, gone boolean")
        rows = "rows array<struct<us:long,id:long,op:string>>"
        self.first = handle.getValueState("first", f"many boolean, {rows}")
        self.waiting = handle.getMapState("waiting", "bucket long", rows)

    def _bucket(self, row: tuple) -> int:
        return row[0] // 1000 // self.bucket_ms

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        many, held = self.first.get() if self.first.exists() else (False, [])
        new = ((r.us, r.id, r.op) for r in rows)
        if not many:
            before = min(map(self._bucket, held := [tuple(x) for x in held]), default=None)
            some = [*held, *islice(new, self.few + 1 - len(held))]
            if len(some) <= self.few:
                if some and (before is None or min(map(self._bucket, some)) < before):
                    self.handle.registerTimer((min(map(self._bucket, some)) + 1) * self.bucket_ms)
                self.first.update((False, some))
                return iter(())
            self.first.update((True, []))
            new = chain(some, new)
        come: dict[int, list] = {}
        for r in new:
            come.setdefault(self._bucket(r), []).append(r)
        for bucket, new_ in come.items():
            held = self.waiting.getValue((bucket,)) if self.waiting.containsKey((bucket,)) else None
            if held is None:
                self.handle.registerTimer((bucket + 1) * self.bucket_ms)
            self.waiting.updateValue((bucket,), ([*(tuple(x) for x in (held[0] if held else [])), *new_],))
        return iter(())

    def _due(self, bucket: int, watermark_ms: int) -> list[tuple]:
        """Rows whose bucket has passed, taken out of the state."""
        many, held = self.first.get() if self.first.exists() else (True, [])
        if many:
            if not self.waiting.containsKey((bucket,)):
                return []
            (held,) = self.waiting.getValue((bucket,))
            self.waiting.removeKey((bucket,))
            return [tuple(x) for x in held]
        held = [tuple(x) for x in held]
        passed = max(bucket, watermark_ms // self.bucket_ms - 1)
        later = [x for x in held if self._bucket(x) > passed]
        if len(later) < len(held):
            self.first.update((False, later))
            if later:
                self.handle.registerTimer((min(map(self._bucket, later)) + 1) * self.bucket_ms)
        return [x for x in held if self._bucket(x) <= passed]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        bucket = expiredTimerInfo.getExpiryTimeInMs() // self.bucket_ms - 1
        held = self._due(bucket, timerValues.getCurrentWatermarkInMs())
        if not held:
            return iter(())
        version, occurrence, gone = self.now.get() if self.now.exists() else (0, 0, False)
        out = []
        for _, id_, op in sorted(held, key=lambda x: x[:2]):
            at = alias = None
            outcome = op
            if op == "define":
                version, occurrence, gone = version + 1, 0, False
            elif op == "reset":
                occurrence = 0
            elif op not in OPERATIONS:
                outcome = "refused:unknown"
            elif version == 0:
                outcome = "refused:undefined"
            elif gone:
                outcome = "refused:consumed"
            else:
                at, alias = occurrence, f"@adv{occurrence}" if occurrence else f"@def{version}"
                occurrence, gone = occurrence + 1, op == "consume"
            out.append(Row(key=key[0], id=id_, version=version, occurrence=at, alias=alias, outcome=outcome))
        self.now.update((version, occurrence, gone))
        return iter(out)


def stream(rows: DataFrame, delay: str, bucket_ms: int = BUCKET_MS, few: int = FEW) -> DataFrame:
    """The same rows as :func:`batch` from a stream of ``key, ts, id, op``, each when the watermark (``delay`` behind the latest time seen) has passed its bucket."""
    rows = rows.select(F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("us"), F.col("id").cast("long").alias("id"), "op").withWatermark("ts", delay)
    return rows.groupBy("key").transformWithState(_Cursor(bucket_ms, few), OUTPUT, "append", "eventTime")


def append_to(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there by now, into Parquet files; called again, it goes on from the checkpoint."""
    conf, name = rows.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, _ROCKS)  # the store that holds timers; a query takes its setting when it starts
    try:
        query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)
