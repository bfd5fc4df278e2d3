"""Balanced label propagation: documents in shards of even size, linked ones together.

Documents with equal texts are linked (through their text's hash).  A group larger
than ``1 / (8 * shards)`` of all rows is large; there are fewer than ``8 * shards`` of
them, so they are placed first, on the driver, largest first: whole where a shard
has room for all, else (and above a shard's quota always) in parts that fill as few shards as possible.
The other groups then propagate labels: each round counts, by a join, where a group's members are, and they ask to move to the
shard that has most of them among those with room for all; a shard admits whole groups while it has room, documents without links
counting as room because they can go anywhere.  Refused groups count anew; one whose members' shards have no room left asks by the
room of all; the few that remain are placed as the large ones are.  Last, rows without links leave shards
above their quota for the shards below it: row counts differ by one at most.

Rows of large groups meet their places by broadcast and are told apart by bucketed running
totals, so a group of any size spreads over tasks.

Null texts count as empty; null ids and ids of any type are allowed; repeated rows are separate rows of one group;
ties are broken by hashes of group and id, so reruns agree; a very long text is read once and never moved; other columns, whatever their names, are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.ranks import running_total, uniform_key
from claimloom.llm.store import stored

SHARDS = 16
ROUNDS = 3
#: Refused groups that the driver places, at most (more ask in further rounds).
REFUSED = 10_000


def _table(values: list[int]):
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _nth_shard(nth, sizes: list[int]):
    """The shard that row ``nth`` (from 1) falls into where shards take ``sizes`` rows in turn."""
    ends = list(accumulate(sizes))
    to = F.lit(len(sizes) - 1)
    for s in reversed(range(len(sizes) - 1)):
        to = F.when(nth <= ends[s], F.lit(s)).otherwise(to)
    return to


def placed(groups: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """``group, first, last, shard``: where a group's rows go by rank, for ``(group, members)``, largest first; ``room`` is taken down."""
    out = []
    for group, members in sorted(groups, key=lambda g: (-g[1], g[0])):
        done = 0
        while done < members:
            left = members - done
            whole = [s for s in range(len(room)) if room[s] >= left]
            # the tightest shard that holds all, else the roomiest
            s = min(whole, key=lambda s: (room[s], s)) if whole else max(range(len(room)), key=lambda s: (room[s], -s))
            take = min(left, room[s])
            out.append((group, done + 1, done + take, s))
            room[s] -= take
            done += take
    return out


def assigned(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``id, size, text_crc32, linked, shard, slot`` of every row."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.xxhash64(whole, F.octet_length(whole)).alias("group"), uniform_key(F.col(id_col), F.crc32(whole)).alias("u"))
    rows = stored(rows.withColumn("start", (F.col("u") % shards).cast("int")), "shard-rows")
    n = rows.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    room = list(quota)
    at = rows.groupBy("group", "start").agg(F.count("*").alias("here"))
    groups = at.groupBy("group").agg(F.sum("here").alias("members")).filter("members > 1")
    groups = stored(groups, "shard-groups")
    large = F.col("members") > max(1, n // (8 * shards))
    pieces = placed([(r["group"], r["members"]) for r in groups.filter(large).collect()], room)  # fewer than 8 * shards groups
    todo, homes = groups.filter(~large).select("group", "members"), []
    near = stored(at.join(todo.select("group"), "group", "left_semi"), "shard-near")
    left = todo.count()
    for k in range(4 * rounds):
        if not left or (k >= rounds and left <= REFUSED):
            break
        with_room = near.join(todo, "group").filter(F.get(_table(room), F.col("start")) >= F.col("members"))
        most = with_room.groupBy("group").agg(F.max_by("start", F.struct("here", F.xxhash64("group", "start"))).alias("most"))
        open_room = F.pmod(F.xxhash64("group", F.lit(k)), F.lit(max(1, sum(room)))) + 1
        todo = todo.join(most, "group", "left").withColumn("want", F.coalesce("most", _nth_shard(open_room, room)))
        ranked = running_total(todo.withColumn("_key", uniform_key(F.col("group"), F.lit(k))), ["want"], "_key", ["group"], F.col("members"), "_r", left)
        fits = F.col("_r") <= F.get(_table(room), F.col("want"))
        ranked = stored(ranked.withColumn("fits", fits).select("group", "members", "want", "fits"), f"shard-round{k}")
        homes.append(ranked.filter("fits").select("group", F.col("want").alias("home")))
        for r in ranked.filter("fits").groupBy("want").agg(F.sum("members").alias("used")).collect():
            room[r["want"]] -= r["used"]
        todo = ranked.filter("not fits").select("group", "members")
        left = todo.count()
    pieces += placed([(r["group"], r["members"]) for r in todo.collect()] if left else [], room)
    parts = F.broadcast(spark.createDataFrame(pieces, "group long, first long, last long, shard int"))
    keys = F.broadcast(spark.createDataFrame(sorted({(p[0],) for p in pieces}), "group long"))
    cut = running_total(rows.join(keys, "group"), ["group"], "u", ["id"], F.lit(1), "_r", n)
    cut = cut.join(parts, "group").filter("_r between first and last").withColumn("linked", F.lit(True))
    rest = rows.join(keys, "group", "left_anti")
    if homes:
        home = homes[0]
        for more in homes[1:]:
            home = home.unionByName(more)
        rest = rest.join(home, "group", "left")
    else:
        rest = rest.withColumn("home", F.lit(None).cast("int"))
    rest = rest.withColumn("shard", F.coalesce("home", "start")).withColumn("linked", F.col("home").isNotNull())
    cols = ["id", "size", "text_crc32", "u", "linked", "shard"]
    rows = stored(cut.select(*cols).unionByName(rest.select(*cols)), "shard-linked")
    # linked rows are within every quota, so only rows without links leave
    got = {(r["shard"], r["linked"]): r["n"] for r in rows.groupBy("shard", "linked").agg(F.count("*").alias("n")).collect()}
    load = [got.get((s, True), 0) + got.get((s, False), 0) for s in range(shards)]
    out, need = [max(0, a - b) for a, b in zip(load, quota)], [max(0, b - a) for a, b in zip(load, quota)]
    free = running_total(rows.filter("not linked"), ["shard"], "u", ["id"], F.lit(1), "_r", n)
    to = _nth_shard(F.get(_table([0, *accumulate(out)]), F.col("shard")) + F.col("_r"), need)
    free = free.withColumn("shard", F.when(F.col("_r") <= F.get(_table(out), F.col("shard")), to).otherwise(F.col("shard")).cast("int"))
    rows = stored(rows.filter("linked").unionByName(free.select(*rows.columns)), "shard-end")
    return running_total(rows, ["shard"], "u", ["id"], F.lit(1), "slot", n).withColumn("slot", F.col("slot").cast("long") - 1)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    rows = assigned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
