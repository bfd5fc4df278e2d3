"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Texts are equal when identical after deleting the characters 0x20 and
0x09-0x0D.  Only a text whose (length, prefix hash) meets another one is grouped by its full hash.  The pairs that meet are
remembered in a bit set of bounded size (``bitset.MAX_BITS``), which a scalar subquery brings to the next scan; a false hit
costs needless work and nothing else.  Text itself is never shuffled.

Without ``digest`` the content of the other texts is not read beyond the prefix: one scan takes lengths and prefixes, a second one hashes
survivors.  With ``digest`` (every row's full hash is asked for) one scan takes all three, and the levels run on that narrow table.

Null texts count as empty; null ids sort last among equals; ids may have any type that sorts; repeated rows are
separate rows, of which one stays; a tie in length goes to the smaller id; a very long text costs one hash and is never moved; an empty table gives an empty result; other
columns, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.bitset import maybe_in
from claimloom.llm.store import discard, fresh, stored

PREFIX_CHARS = 64
#: A group with more than this part of all rows is joined by broadcast; there are fewer such groups than parts.
HOT_PARTS = 1000
_SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _SPACES, "")


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """One row per input row: ``id, chars, full_hash (null where no other text can be equal), length, prefix_hash, row`` (and ``digest``)."""
    norm = normalised(F.col(text))
    rows = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("chars"), norm.alias("norm"))
    rows = rows.withColumns({"length": F.length("norm").cast("long"), "prefix_hash": F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)), "row": F.monotonically_increasing_id()})
    made = []
    if digest:
        rows = stored(rows.select("id", "chars", "length", "prefix_hash", "row", F.sha2("norm", 256).alias("digest")), "exact-digests")
        made = [rows]
    lengths = stored(rows.groupBy("length", "prefix_hash").agg(F.count("*").alias("n")), "exact-prefix")
    # level 1: lengths that two rows share; level 2: prefixes that two rows of such a length share
    shared = lengths.groupBy("length").agg(F.sum("n").alias("m")).filter("m > 1").select("length")
    alive = lengths.filter("n > 1").join(shared, "length", "left_semi").select(F.xxhash64("length", "prefix_hash").alias("h"))
    hit = maybe_in(F.xxhash64("length", "prefix_hash"), alive)
    # level 3: the full content, of survivors only
    full = F.col("digest") if digest else F.sha2("norm", 256)
    rows = rows.select("id", "chars", "length", "prefix_hash", "row", F.when(hit, full).alias("full_hash"), *(["digest"] if digest else []))
    # later plans read the three levels, none of them repeats the subquery of the bit set
    out = stored(rows, "exact-rows")
    discard(lengths, *made)
    return out


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """Per input row: ``id, keep_id, group_size, kept`` and the columns of :func:`classes`.

    Of equal texts the row with most code points, then the smallest id, stays.
    """
    rows = classes(docs, text, id_col, digest)
    alone = rows.filter("full_hash is null").withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}).drop("row")
    met = rows.filter("full_hash is not null")
    # of repeated rows the first one stored stays
    order = F.struct((-F.col("chars")).alias("fewer"), F.col("id").isNull().alias("none"), "id", "row")
    groups = met.groupBy("full_hash").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
    groups = stored(groups.select(F.col("full_hash").alias("_f"), F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "exact-groups")
    # rows of large groups meet their survivor by broadcast (fewer than HOT_PARTS groups have so many), the others by hash
    hot = F.col("group_size") * HOT_PARTS > rows.count()
    same = F.col("full_hash") == F.col("_f")
    tried = met.join(F.broadcast(groups.filter(hot)), same, "left")
    rest = tried.filter("_f is null").select(*met.columns).join(groups.filter(~hot), same)
    met = tried.filter("_f is not null").unionByName(rest).withColumn("kept", F.col("row") == F.col("keep_row"))
    return alone.unionByName(met.select(*alone.columns))


def _identity(id_: Column, digest: Column, chars: Column) -> Column:
    return F.concat_ws(":", digest, chars, F.when(id_.isNull(), "null").otherwise(F.concat(F.lit("="), id_)))


def deduplicated(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, with all columns of ``docs``.

    Repeated rows are merged by the key that the survivors are joined by, so texts are shuffled once.
    """
    key, theirs = fresh(docs, "_k", "_theirs")
    kept = exact_dedup(docs, text, id_col, digest=True).filter("kept").select(_identity(F.col("id"), F.col("digest"), F.col("chars")).alias(key))
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.struct("*").alias(theirs), _identity(F.col(id_col), F.sha2(normalised(F.col(text)), 256), length).alias(key)).dropDuplicates([key])
    return rows.join(kept, key, "left_semi").select(f"{theirs}.*")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = exact_dedup(docs, digest=True)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
