"""A bit set of bounded size that keeps rows from a shuffle that cannot meet anything there.

The keys' hashes set bits; a scalar subquery brings the bits to a scan.  At most
``MAX_BITS`` bits (2 MB) are made whatever the input; a full set lets all
rows pass, so it only ever saves work and never decides a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 24


def _bits(keys: DataFrame, n_words: int) -> Column:
    """A scalar subquery: an array of ``n_words`` longs with the bits of ``keys.h`` set."""
    at = F.pmod(F.col("h"), F.lit(64 * n_words))
    words = keys.select(F.floor(at / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(h, {64 * n_words}) % 64 as int))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b"))
    full = keys.sparkSession.range(n_words).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("bits")).scalar()


def maybe_in(h: Column, keys: DataFrame) -> Column:
    """False only where no row of ``keys`` (one long column ``h``) has this hash."""
    n = keys.count()
    if n == 0:
        return F.lit(False)
    words = min(MAX_BITS, 1 << max(10, math.ceil(math.log2(16 * n)))) // 64
    at = F.pmod(h, F.lit(64 * words))
    word = F.get(_bits(keys, words), F.floor(at / 64).cast("int"))
    return F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
