"""Conversation structure repair: A* on the edit lattice.

A conversation's rows, by turn (nulls first, then role and text), are edited so that the initials of their roles read
``(s?(ua)+)?``.  Edits: Keep (0), Rerole to user or assistant (1), Delete (2, required for blank and duplicate rows),
Insert an empty user or assistant row (5); a truncated row that is not deleted adds 5.  Of the cheapest edit lists the
one whose initials come first in ASCII order is taken.

A lattice node is (rows done, state of the pattern).  The heuristic is a suffix sum: 2 for every mandatory deletion and
2 for every truncated row, which costs that much at least whatever is done with it.  It is admissible and consistent, and
the queue is ordered by (cost plus heuristic, audit); edit lists that end at one node with equal cost are never prefixes of
one another (only inserts are no rows, and they cost), so the first arrival at a node is the least in both.

No task holds a conversation: rows are range-sorted and cut into segments of at most ``SEGMENT_ROWS`` rows (and about
``SEGMENT_BYTES``), each searched from every state to every state; a fold over the narrow results picks the chain of
segments, and each segment then writes its own lines.  One task streams a conversation's segment results and one its lines,
which its single audit and digest need; what the fold holds of a conversation is 16 times its audit at most.  Repeated rows
travel as one row with a count.

Null roles and texts are one space; a null conversation is one conversation; an empty role has no initial and cannot be
kept; very long texts are moved as rows and read nowhere but in the JVM and the writer; rows of one turn go by role and
text; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.store import discard, small_batches, stored

#: Rows and bytes of text of a segment.
SEGMENT_ROWS, SEGMENT_BYTES = 512, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED_KEPT = 0, 1, 2, 5, 5
#: Faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of the pattern: nothing yet, after s, after u, after a.
_START, _S, _U, _A = range(4)
_NEXT = {(_START, "s"): _S, **{(q, "u"): _U for q in (_START, _S, _A)}, (_U, "a"): _A}


def _turn(q: int) -> tuple[str, str]:
    """Role and initial of what may be put or reroled behind state ``q``."""
    return ("assistant", "a") if q == _U else ("user", "u")


def search(rows: list[tuple[str, int]], start: int) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) from ``start`` to each state behind all ``rows`` (initial, fault): A*."""
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i][1] != SOUND else 0)
    done: dict[tuple[int, int], bool] = {}
    ends: dict[int, tuple[int, str]] = {}
    queue = [(rest[0], "", 0, start)]
    while queue and len(ends) < 4:
        key, audit, i, q = heapq.heappop(queue)
        if (i, q) in done:
            continue
        done[i, q] = True
        cost = key - rest[i]
        if i == n:
            ends[q] = (cost, audit)
        into = _NEXT[q, _turn(q)[1]]
        if (i, into) not in done:
            heapq.heappush(queue, (key + INSERT, audit + "I", i, into))
        if i == n:
            continue
        initial, fault = rows[i]
        base = cost + rest[i + 1]
        if (i + 1, q) not in done:
            heapq.heappush(queue, (base + DELETE, audit + "D", i + 1, q))
        if fault in (BLANK, DUPLICATE):
            continue
        base += TRUNCATED_KEPT if fault == TRUNCATED else 0
        kept = _NEXT.get((q, initial))
        if kept is not None and (i + 1, kept) not in done:
            heapq.heappush(queue, (base + KEEP, audit + "K", i + 1, kept))
        if (i + 1, into) not in done:
            heapq.heappush(queue, (base + REROLE, audit + "R", i + 1, into))
    return ends


def lines(rows: list[tuple[str, str]], audit: str, q: int) -> list[str]:
    """The repaired ``role:text`` lines of a segment entered in state ``q``."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, initial = _turn(q)
        text = ""
        if edit != "I":
            if edit == "K":
                role, initial = rows[i][0], rows[i][0][:1]
            text = rows[i][1]
            i += 1
        out.append(f"{role}:{text}")
        q = _NEXT[q, initial]
    return out


_EDGE = "array<struct<a:int,b:int,cost:long,audit:string>>"
_STATS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]


class _Segment:
    """Rows of one conversation, as they are gathered."""

    def __init__(self, conv):
        self.conv, self.roles, self.texts, self.shape, self.bytes = conv, [], [], [], 0
        self.low = self.high = self.last = None
        self.stats = dict.fromkeys(_STATS, 0)

    def add(self, turn, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        s = self.stats
        if self.shape:
            s["illegal"] += self.shape[-1][0] + initial not in ("su", "ua", "au")
        if turn is not None:
            s["turns"] += turn != self.last
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
        s["rows"] += 1
        if fault:
            s[("", "blank", "duplicate", "truncated")[fault]] += 1
        self.shape.append((initial, fault))
        # what is deleted in any case writes no line
        self.roles.append(role)
        self.texts.append("" if fault in (BLANK, DUPLICATE) else text)
        self.bytes += len(self.texts[-1]) + len(role)

    def full(self, rows: int) -> bool:
        return len(self.shape) >= rows or self.bytes >= SEGMENT_BYTES

    def row(self, part: int, seq: int) -> dict:
        edges = [{"a": a, "b": b, "cost": c, "audit": t} for a in range(4) for b, (c, t) in sorted(search(self.shape, a).items())]
        ends = {"head": self.shape[0][0], "tail": self.shape[-1][0], "low": self.low, "high": self.high}
        return {"conv": self.conv, "part": part, "seq": seq, "roles": self.roles, "texts": self.texts, "edges": edges, **ends, **self.stats}


def _segments(schema: pa.Schema, most: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, now, out, held = TaskContext.get().partitionId(), 0, None, [], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                same = now is not None and now.conv == r["conv"]
                fault = r["fault"] or (SOUND if r["first"] else DUPLICATE)
                if fault == TRUNCATED and not r["first"]:
                    fault = DUPLICATE
                for k in range(r["n"]):
                    if now is None or not same or now.full(most):
                        if now is not None:
                            out.append(now.row(part, seq))
                            seq, held = seq + 1, held + now.bytes
                        now, same = _Segment(r["conv"]), True
                        if held > SEGMENT_BYTES or len(out) >= 256:
                            yield flushed()
                            out, held = [], 0
                    now.add(r["turn"], r["role"], r["text"], fault if k == 0 or fault == BLANK else DUPLICATE)
        if now is not None:
            out.append(now.row(part, seq))
        if out:
            yield flushed()

    return cut


def _chains(schema: pa.Schema):
    """Folds the segments of each conversation, which come in order, and gives each its part of the audit."""

    def whole(segs: list[dict]) -> list[dict]:
        best = {_START: (0, "")}
        back: list[dict[int, tuple[int, str]]] = []
        for s in segs:
            step: dict[int, tuple[int, str]] = {}
            via: dict[int, tuple[int, str]] = {}
            for e in s["edges"]:
                if e["a"] in best:
                    cost, audit = best[e["a"]]
                    now = (cost + e["cost"], audit + e["audit"])
                    if e["b"] not in step or now < step[e["b"]]:
                        step[e["b"]], via[e["b"]] = now, (e["a"], e["audit"])
            best = step
            back.append(via)
        q = min((q for q in best if q in (_START, _A)), key=lambda q: best[q])
        cost, audit = best[q]
        out = []
        for s, via in zip(reversed(segs), reversed(back)):
            a, piece = via[q]
            out.append({"part": s["part"], "seq": s["seq"], "state": a, "piece": piece, "last": False})
            q = a
        total = {k: sum(s[k] for s in segs) for k in _STATS}
        for a, b in zip(segs, segs[1:]):
            total["illegal"] += a["tail"] + b["head"] not in ("su", "ua", "au")
        low = high = None
        for s in segs:
            if s["low"] is not None:
                total["turns"] -= s["low"] == high
                low, high = s["low"] if low is None else low, s["high"]
        gaps = 0 if low is None else high - low + 1 - total["turns"]
        out[0] |= {"last": True, "gaps": gaps, "cost": cost, "audit": audit, **{k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}}
        return out

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segs: list[dict] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if segs and segs[-1]["conv"] != r["conv"]:
                    out += whole(segs)
                    segs = []
                segs.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if segs:
            yield pa.RecordBatch.from_pylist(whole(segs), schema=schema)

    return fold


def _written(schema: pa.Schema):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                made = lines(list(zip(r.pop("roles"), r.pop("texts"))), r.pop("piece"), r.pop("state"))
                out.append(r | {"lines": len(made), "body": "\n".join(made)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return write


def _digested(schema: pa.Schema):
    """A running digest over the segments of each conversation, which come in order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun = hashlib.sha256(), False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r.pop("lines"):
                    state.update((("\n" if begun else "") + r["body"]).encode("utf-8", "surrogatepass"))
                    begun = True
                del r["body"]
                if r.pop("last"):
                    out.append(r | {"repaired_sha256": state.hexdigest()})
                    state, begun = hashlib.sha256(), False
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return digest


def _streamed(df: DataFrame, make, schema: T.StructType, *how) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    return df.mapInArrow(make(to_arrow_schema(schema), *how), schema)


def _fields(spec: str) -> list[T.StructField]:
    return T._parse_datatype_string(spec).fields


def _marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with their count, first fault apart from duplicates, and whether role and text are met here first."""
    trimmed = F.expr("trim(TRAILING " + "' \\t\\n\\u000b\\f\\r' FROM text)")
    fault = F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    rows = rows.withColumn("h", F.sha2("text", 256))
    # the first turn of each (role, text); null turns come first
    first = rows.groupBy("conv", "role", "h").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none"))
    first = first.select("conv", F.when(~F.col("none"), F.col("least")).alias("turn"), "role", "h", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("first"))
    met = rows.select("conv", "turn", "role", "h", "text", "n", F.lit(False).alias("first")).unionByName(first)
    met = met.groupBy("conv", "turn", "role", "h").agg(F.max("text").alias("text"), F.sum("n").alias("n"), F.max("first").alias("first"))
    return met.select("conv", "turn", "role", "text", "n", "first", fault.alias("fault"))


def repaired(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per conversation of ``rows`` (``conv, turn, role, text, n``: how often the row stands there): faults, cost, audit and digest of the repair."""
    spark = rows.sparkSession
    small_batches(spark)
    conv = T.StructField("conv", rows.schema["conv"].dataType)
    stats = _fields(", ".join(f"{k} long" for k in _STATS))
    seg = T.StructType([conv, *_fields(f"part int, seq long, roles array<string>, texts array<string>, edges {_EDGE}, head string, tail string, low long, high long"), *stats])
    ordered = _marked(rows).withColumn("turn", F.col("turn").cast("long"))
    ordered = ordered.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    segments = stored(_streamed(ordered, _segments, seg, segment_rows), "repair-segments")
    place = ["conv", "part", "seq"]
    told = _fields("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    narrow = segments.drop("roles", "texts").repartition("conv").sortWithinPartitions(*place)
    chains = _streamed(narrow, _chains, T.StructType([*_fields("part int, seq long, state int, piece string, last boolean"), *told]))
    both = segments.select(*place, "roles", "texts").join(chains, ["part", "seq"])
    bodies = _streamed(both, _written, T.StructType([*_fields("part int, seq long"), conv, *_fields("last boolean"), *told, *_fields("lines long, body string")]))
    bodies = bodies.repartition("conv").sortWithinPartitions(*place).drop("part", "seq")
    out = stored(_streamed(bodies, _digested, T.StructType([conv, *told, *_fields("repaired_sha256 string")])), "repair-results")
    discard(segments)
    return out


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, n`` after faults that the checksum of ``conv:turn`` deals out: one row in 20 each is dropped, emptied, loses its stops, stands twice, or becomes a user's."""
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(F.col(conv)), F.lit(":"), space(F.col(turn))).cast("binary")) % 20
    said = space(F.col(text))
    out = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(space(F.col(role))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
    )
    return out.filter("kind <> 0").select("conv", "turn", "role", "text", F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"))


def _or(name: str, least) -> Column:
    return F.coalesce(F.col(name), F.lit(least)).alias(name)


def op13_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    done = repaired(damaged(rows))
    every = rows.select("conv_id").distinct()
    counts = [_or(c, 0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = hashlib.sha256(b"").hexdigest()
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select("conv_id", *counts, _or("audit", ""), _or("repaired_sha256", none))


#: CRC-32 of the text's bytes, bit by bit (ids and turns are ASCII).
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: ord(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
#: Two inserts in one place are enough: two more lead back to where they began.
OP13_SQL = f"""
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
dam AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE kind <> 0),
num AS (
    SELECT *, left(role, 1) AS c, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM dam),
row_ AS (
    SELECT *, CASE WHEN bare = '' THEN 1 WHEN again THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM num),
conv AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
           count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM row_ GROUP BY conv_id),
ins(q, to_, price, edits, lines) AS (
    SELECT * FROM (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:']),
        (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:']), (2, 2, 10, 'II', ['assistant:', 'user:']), (3, 3, 10, 'II', ['user:', 'assistant:']))),
act(q, to_, edit, c, role) AS (
    SELECT * FROM (VALUES (0, 0, 'D', NULL, NULL), (1, 1, 'D', NULL, NULL), (2, 2, 'D', NULL, NULL), (3, 3, 'D', NULL, NULL), (0, 1, 'K', 's', NULL), (0, 2, 'K', 'u', NULL), (1, 2, 'K', 'u', NULL), (3, 2, 'K', 'u', NULL), (2, 3, 'K', 'a', NULL),
        (0, 2, 'R', NULL, 'user'), (1, 2, 'R', NULL, 'user'), (3, 2, 'R', NULL, 'user'), (2, 3, 'R', NULL, 'assistant'))),
st AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'made': []::VARCHAR[]}} AS b FROM conv
    UNION ALL
    SELECT st.conv_id, r.i, act.to_, min({{'cost': b.cost + price + CASE edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN fault = 3 AND edit <> 'D' THEN 5 ELSE 0 END, 'audit': b.audit || edits || edit,
        'made': list_concat(list_concat(b.made, lines), CASE WHEN edit = 'D' THEN [] ELSE [coalesce(act.role, r.role) || ':' || text] END)}})
    FROM st JOIN row_ r ON r.conv_id IS NOT DISTINCT FROM st.conv_id AND r.i = st.i + 1 JOIN ins ON ins.q = st.q JOIN act ON act.q = ins.to_
    WHERE (edit <> 'K' OR act.c = r.c) AND (edit = 'D' OR fault NOT IN (1, 2)) GROUP BY st.conv_id, r.i, act.to_),
best AS (
    SELECT st.conv_id, min({{'cost': b.cost + price, 'audit': b.audit || edits, 'made': list_concat(b.made, lines)}}) AS b
    FROM st JOIN conv ON conv.conv_id IS NOT DISTINCT FROM st.conv_id AND conv.n = st.i JOIN ins ON ins.q = st.q WHERE ins.to_ IN (0, 3) GROUP BY st.conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN conv ON conv.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id
"""
