"""Merkle manifest of a dataset: a tree of fanout 16 for each group, and one over the groups' roots.

Leaves are range-sorted by group and id and checkpointed, so that partitions are fixed.  Each partition tells its first and
last group with their counts; from these the driver derives one offset and two totals for each partition (its only other
groups begin and end in it).  With them a partition builds all complete aligned subtrees by itself; only nodes whose parent
has children elsewhere are shuffled, by the parent's coordinate (group, level, index), and finished level by level.  A
second pass over the same partitions meets the paths of these few nodes and returns every leaf's proof: for each level what
stands left and right of it.  The tree over the groups' roots is built in the same way, so neither groups nor leaves ever
meet in one task; a partition has about ``per_partition`` leaves whatever the table, equal rows included.

Null fields are hashed as ``-``; rows of one id go by leaf, null ids first; repeated rows are leaves of their own; a null
group is a group and comes first; a very long text is hashed in the JVM and never moved; an empty table gives an empty
result; other columns are neither hashed nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.store import checkpointed, discard, small_batches, stored

FANOUT = 16
#: Leaves of a partition, about.
ROWS = 50_000
_PATH = "array<struct<left:string,right:string>>"


def _parents(n: int) -> int:
    return -(-n // FANOUT)


def _digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def _built(nodes: list[str], lo: int, n: int) -> list[tuple[int, list[str], int, int, int]]:
    """Levels of the complete aligned subtrees over the leaves ``lo...`` of ``n``: first index, digests, level's size, complete parents from and to."""
    out = []
    while True:
        hi = lo + len(nodes)
        a, b = _parents(lo), _parents(n) if hi == n else hi // FANOUT
        if n == 1 or a >= b:
            return [*out, (lo, nodes, n, 0, 0)]
        out.append((lo, nodes, n, a, b))
        nodes = [_digest("".join(nodes[FANOUT * j - lo : FANOUT * j + FANOUT - lo])) for j in range(a, b)]
        lo, n = a, _parents(n)


class _Offsets:
    """For each partition: the leaves that its first group has before it, and the totals of its first and last group."""

    def __init__(self, told: list):
        self.at: dict[int, tuple[int, int, int]] = {}
        self.spread = 1  # leaves of the largest group that lies in several partitions
        totals: list[int] = []
        last, before, first = None, 0, []
        for r in sorted(told, key=lambda r: r["p"]):
            if r["head"] != last:
                last, before = r["head"], 0
                totals.append(0)
            first.append((r["p"], before, len(totals) - 1))
            totals[-1] += r["head_n"]
            before += r["head_n"]
            if r["tail"] != r["head"]:
                last, before = r["tail"], r["tail_n"]
                totals.append(r["tail_n"])
            self.at[r["p"]] = (len(totals) - 1, 0, 0)
            self.spread = max(self.spread, totals[-1], totals[first[-1][2]])
        self.at = {p: (before, totals[head], totals[self.at[p][0]]) for p, before, head in first}

    def place(self, p: int, k: int, last: bool, count: int) -> tuple[int, int]:
        """First index and group's size of a partition's group number ``k``."""
        before, head, tail = self.at[p]
        return (before, head) if k == 0 else (0, tail if last else count)


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[str, int, list, bool]]:
    """A partition's groups in order: group, number, its rows, whether it is the last."""
    g, k, rows = None, -1, []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("g", *columns))):
            if r[0] != g:
                if k >= 0:
                    yield g, k, rows, False
                g, k, rows = r[0], k + 1, []
            rows.append(r[1:])
    if k >= 0:
        yield g, k, rows, True


_COUNTED = "p int, head string, head_n long, tail string, tail_n long"


def _counted(schema: pa.Schema):
    """A partition's first and last group, with their rows in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head = None
        for g, _, rows, last in _runs(batches, []):
            head = head or (g, len(rows))
            if last:
                yield pa.RecordBatch.from_pylist([{"p": TaskContext.get().partitionId(), "head": head[0], "head_n": head[1], "tail": g, "tail_n": len(rows)}], schema=schema)

    return run


_RAGGED = "p int, g string, level int, idx long, size long, node string"


def _ragged(offsets: _Offsets, schema: pa.Schema):
    """Nodes of a partition whose parent is not complete in it, and roots of groups that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p, out = TaskContext.get().partitionId(), []
        for g, k, rows, last in _runs(batches, ["node"]):
            for level, (lo, nodes, n, a, b) in enumerate(_built([r[0] for r in rows], *offsets.place(p, k, last, len(rows)))):
                ends = range(lo, lo + len(nodes)) if a >= b else [*range(lo, FANOUT * a), *range(FANOUT * b, lo + len(nodes))]
                out += [{"p": p, "g": g, "level": level, "idx": i, "size": n, "node": nodes[i - lo]} for i in ends]
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _proved(offsets: _Offsets, extra: list[str], schema: pa.Schema):
    """Proofs of a partition's leaves, which come behind the paths of its ragged nodes and groups."""

    def finish(p: int, leaves: list[tuple], paths: dict, roots: dict) -> Iterator[pa.RecordBatch]:
        cuts = [i for i, r in enumerate(leaves) if i == 0 or r[0] != leaves[i - 1][0]] + [len(leaves)]
        out = []
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            g = leaves[x][0]
            root, above = roots[g]
            lo, n = offsets.place(p, k, y == len(leaves), y - x)
            levels = _built([r[1] for r in leaves[x:y]], lo, n)
            joined = [{j: "".join(nodes[FANOUT * j - first : FANOUT * j + FANOUT - first]) for j in range(a, b)} for first, nodes, _, a, b in levels]
            for i, r in enumerate(leaves[x:y], lo):
                level, path = 0, []
                while (all_ := joined[level].get(i // FANOUT)) is not None:
                    at = 64 * (i % FANOUT)
                    path.append({"left": all_[:at], "right": all_[at + 64 :]})
                    level, i = level + 1, i // FANOUT
                path += paths.get((g, level, i), []) + above
                out.append({"g": g, "node": r[1], "root": root, "proof": path, **dict(zip(extra, r[2:]))})
                if len(out) == 512:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, leaves, paths, roots = None, [], {}, {}
        for batch in batches:
            names = ("p", "kind", "g", "node", "level", "idx", "root", "path", *extra)
            for q, kind, g, node, level, idx, root, path, *more in zip(*(batch.column(c).to_pylist() for c in names)):
                if q != p:
                    if leaves:
                        yield from finish(p, leaves, paths, roots)
                    p, leaves, paths, roots = q, [], {}, {}
                if kind == 0:
                    if root is not None:
                        roots[g] = (root, path)
                    else:
                        paths[g, level, idx] = path
                else:
                    leaves.append((g, node, *more))
        if leaves:
            yield from finish(p, leaves, paths, roots)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Forest:
    """A tree for each group ``g`` of ``nodes`` (``g`` not null, ``node``: hex digests, and further columns), its leaves ordered by ``order`` and then ``node``."""

    def __init__(self, nodes: DataFrame, order: list[str], rows: int, per_partition: int = ROWS):
        spark = nodes.sparkSession
        small_batches(spark)
        self.extra = [c for c in nodes.columns if c not in ("g", "node")]
        key = ["g", *order, "node", "_row"]
        # the row number parts equal rows, whose order makes no difference
        made = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-rows // per_partition)), *key)
        self.sorted = checkpointed(made.sortWithinPartitions(*key).drop("_row"))
        schema = T._parse_datatype_string(_COUNTED)
        self.offsets = _Offsets(self.sorted.select("g").mapInArrow(_counted(_arrow(schema)), schema).collect())
        schema = T._parse_datatype_string(_RAGGED)
        self.ragged = stored(self.sorted.select("g", "node").mapInArrow(_ragged(self.offsets, _arrow(schema)), schema), "merkle-ragged")
        self.levels: list[DataFrame] = []
        now, size, level = self.ragged, self.offsets.spread, 0
        tops = self.ragged.filter("size = 1").select("g", F.col("node").alias("root"))
        open_ = self.ragged.filter("size > 1")
        now = open_.filter("level = 0").select("g", "idx", "size", "node")
        while size > 1:
            child = F.array_sort(F.collect_list(F.struct("idx", "node")))
            up = now.groupBy("g", F.shiftright("idx", 4).alias("at")).agg(child.alias("c"), F.max("size").alias("s"))
            joined = F.array_join(F.transform("c", lambda x: x["node"]), "")
            level, size = level + 1, _parents(size)
            up = stored(up.select("g", F.lit(level).alias("level"), F.col("at").alias("idx"), F.expr("(s + 15) div 16").alias("size"), joined.alias("joined")).withColumn("node", F.sha2("joined", 256)), "merkle-level")
            self.levels.append(up)
            tops = tops.unionByName(up.filter("size = 1").select("g", F.col("node").alias("root")))
            now = open_.filter(F.col("level") == level).select("g", "idx", "size", "node").unionByName(up.filter("size > 1").select("g", "idx", "size", "node"))
        self.roots = tops

    def _paths(self) -> DataFrame:
        """What stands left and right of each ragged node and of its ancestors."""
        nodes = self.ragged.filter("size > 1").select("p", "g", "level", "idx")
        if not self.levels:
            return nodes.withColumn("path", F.lit(None).cast(_PATH)).limit(0)
        all_ = self.levels[0]
        for t in self.levels[1:]:
            all_ = all_.unionByName(t)
        all_ = all_.select("g", F.col("level").alias("l"), F.col("idx").alias("x"), "joined")
        steps = nodes.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(len(self.levels) - 1)))).withColumns({"l": F.col("level") + F.col("d") + 1, "x": F.expr("shiftright(idx, 4 * d + 4)"), "at": F.expr("cast(64 * (shiftright(idx, 4 * d) & 15) as int)")})
        met = steps.join(all_, ["g", "l", "x"]).select("p", "g", "level", "idx", F.struct("d", F.expr("substring(joined, 1, at)").alias("left"), F.expr("substring(joined, at + 65)").alias("right")).alias("step"))
        path = F.transform(F.array_sort(F.collect_list("step")), lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")))
        return met.groupBy("p", "g", "level", "idx").agg(path.alias("path"))

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """All nodes with their group's ``root`` and their ``proof``, from the leaf up; ``above`` (``g, path``) continues the proofs."""
        told = self.ragged.select("p", "g").distinct().join(self.roots, "g")
        told = told.join(above, "g") if above is not None else told.withColumn("path", F.array().cast(_PATH))
        right = told.select("p", "g", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("idx"), "root", "path")
        right = right.unionByName(self._paths().select("p", "g", "level", "idx", F.lit(None).cast("string").alias("root"), "path")).withColumns({"kind": F.lit(0), "i": F.lit(0).cast("long")})
        left = self.sorted.withColumns({"p": F.spark_partition_id(), "i": F.monotonically_increasing_id(), "kind": F.lit(1)})
        both = left.unionByName(right, allowMissingColumns=True).repartition("p").sortWithinPartitions("p", "kind", "i")
        fields = self.sorted.schema
        schema = T.StructType([*T._parse_datatype_string(f"g string, node string, root string, proof {_PATH}").fields, *(T.StructField(c, fields[c].dataType) for c in self.extra)])
        return both.mapInArrow(_proved(self.offsets, self.extra, _arrow(schema)), schema)

    def discard(self) -> None:
        discard(self.ragged, *self.levels)


def _said(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    return F.sha2(F.concat(*[_said(f) for f in fields]), 256)


def manifest(rows: DataFrame, group: str = "source", id_col: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), per_partition: int = ROWS, **more: Column) -> DataFrame:
    """Per row: ``id, group, leaf, subroot, root, proof`` (left and right siblings of each level from the leaf to the root), and ``more``."""
    # '=' parts the empty group from the null one and keeps the order of bytes
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(g.alias("g"), F.col(id_col).alias("id"), leaf(*[F.col(c) for c in fields]).alias("node"), *[c.alias(k) for k, c in more.items()])
    # hashed once: the range sort reads its input twice
    leaves = stored(leaves, "merkle-leaves")
    n = leaves.count()
    trees = Forest(leaves, ["id"], n, per_partition)
    discard(leaves)
    subroots = stored(trees.roots, "merkle-roots")
    over = Forest(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("root").alias("node")), ["of"], subroots.count(), per_partition)
    top = stored(over.proofs().select(F.col("of").alias("g"), F.col("root").alias("top"), F.col("proof").alias("path")), "merkle-top")
    over.discard()
    root = top.agg(F.first("top")).scalar() if n else F.lit(None).cast("string")
    out = trees.proofs(top.select("g", "path"))
    return out.select("id", F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias("group"), F.col("node").alias("leaf"), F.col("root").alias("subroot"), root.alias("root"), "proof", *more)


def folded(leaf_: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf_, lambda now, step: F.sha2(F.concat(step["left"], now, step["right"]), 256))


def op12_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.translate("text", upper, lower))
    out = manifest(docs, tampered=F.when(hit, changed))
    siblings = F.aggregate("proof", F.lit(""), lambda said, step: F.concat(said, step["left"], step["right"]))
    out = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of all levels, and each one's siblings to the left and right."""
    return f"""
{name}_n AS (
    SELECT g, 0 AS level, row_number() OVER (PARTITION BY g ORDER BY o NULLS FIRST, node) - 1 AS idx, count(*) OVER (PARTITION BY g) AS size, node FROM ({leaves})
    UNION ALL
    SELECT g, level + 1, idx // 16, (size + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM {name}_n WHERE size > 1 GROUP BY g, level, idx // 16, size),
{name}_s AS (
    SELECT a.g, a.level, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
    FROM {name}_n a JOIN {name}_n b ON b.g = a.g AND b.level = a.level AND b.idx // 16 = a.idx // 16 WHERE a.size > 1 GROUP BY ALL)"""


_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
#: CRC-32 of ASCII digits, bit by bit.
_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"
OP12_SQL = f"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce('=' || source, '') AS g, {_LEAF.format(_FIELD.format("text"))} AS leaf,
           CASE WHEN doc_id IS NOT NULL AND xor({_CRC}, 4294967295) % 5 = 0 THEN {_LEAF.format(_FIELD.format(_LOWERED))} END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
{_tree_sql("t", "SELECT g, doc_id AS o, leaf AS node FROM d")},
u AS (SELECT g, node, row_number() OVER (ORDER BY g) - 1 AS idx FROM t_n WHERE size = 1),
{_tree_sql("r", "SELECT 0 AS g, g AS o, node FROM u")},
y AS (SELECT 0 AS tr, g AS sg, level AS sl, idx AS si, l, r FROM t_s UNION ALL SELECT 1, '', level, idx, l, r FROM r_s),
w AS (
    SELECT k, doc_id, leaf, g, 0 AS tree, 0 AS level, idx, '' AS said, coalesce(tampered, leaf) AS now FROM p
    UNION ALL
    SELECT k, doc_id, leaf, w.g, tree + (l IS NULL)::int, CASE WHEN l IS NULL THEN 0 ELSE level + 1 END, CASE WHEN l IS NULL THEN u.idx ELSE w.idx // 16 END,
           CASE WHEN l IS NULL THEN said ELSE said || l || r END, CASE WHEN l IS NULL THEN now ELSE sha256(l || now || r) END
    FROM w JOIN u ON u.g = w.g LEFT JOIN y ON tr = tree AND sl = level AND si = w.idx AND sg = CASE WHEN tree = 0 THEN w.g ELSE '' END
    WHERE tree = 0 OR l IS NOT NULL),
e AS (SELECT * FROM w WHERE tree = 1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY level DESC) = 1)
SELECT e.doc_id, e.leaf, u.node AS subroot, x.node AS root, sha256(e.said) AS proof_sha256, e.now AS folded_root, e.now = x.node AS verified
FROM e JOIN u ON u.g = e.g, (SELECT node FROM r_n WHERE size = 1) x
"""
