"""Interned terms: trees of nodes become one directed acyclic graph in which equal terms are one.

A term's id is the hash of its kind, its label and its children's ids, so equal subtrees get equal ids without a lookup.  The trees
are relations, not texts: leaves get their ids first, and level by level the ids of finished children are joined into their
parents (a join and an aggregation a level; a level's tables are written and the last one's dropped).  No row holds a subtree; children are hashed
in parts of ``PART`` positions, so a very wide node is no wide row either.

Where nodes name their tree (``tree``), trees of up to ``TREE`` nodes take one shuffle instead: a task gets them one behind another and
hashes each from its leaves on; a term is hashed when the task first meets it, and counts of terms or edges are all that leaves it.
Larger ones go level by level.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.scratch import dropped, written

PART = 1024
#: Nodes of a tree that a task hashes at once.
TREE = 20_000
#: Terms, with their children, that a task knows at a time.
KNOWN = 200_000


def term_id(kind: Column, label: Column, arity: Column, children: Column) -> Column:
    """``children``: the hashes of the parts, in order, as one text."""
    return F.sha2(F.concat_ws("\x1f", kind, F.coalesce(label, F.lit("\x00")), arity.cast("string"), children), 256)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_NONE = _sha("")


class _Known:
    """Terms that a task has met, by number: each is hashed once and counted where it comes again, until so many are known that they are given out."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.kind: list = []
        self.label: list = []
        self.cid: list[str] = []
        self.height: list[int] = []
        self.size = 0

    def add(self, key: tuple) -> int:
        """``key``: kind, label, numbers of the children in order and their parts, where there are several."""
        kind, label, below, parts = key
        n = self.numbers[key] = len(self.cid)
        children, at = _NONE, self.cid
        if below:
            runs = [below] if parts is None else [[c for _, c in run] for _, run in groupby(zip(parts, below), lambda x: x[0])]
            children = "".join([_sha("".join([at[c] for c in run])) for run in runs])
        said = "\x00" if label is None else label
        self.cid.append(_sha("\x1f".join([*([] if kind is None else [kind]), said, str(len(below)), children])))
        self.height.append(1 + max(self.height[c] for c in below) if below else 0)
        self.kind.append(kind)
        self.label.append(label)
        self.size += 1 + len(below)
        return n


def _plain(column: pa.ChunkedArray) -> list:
    """The values of a column; texts that come often are made once."""
    if column.null_count or not pa.types.is_integer(column.type):
        coded = column.combine_chunks().dictionary_encode()
        values, codes = [*coded.dictionary.to_pylist(), None], coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        return [values[c] for c in codes.tolist()]
    return column.to_numpy().tolist()


def _hashed(known: _Known, rows: pa.Table) -> tuple[list, list, list, list]:
    """Row numbers of the nodes of whole trees from the leaves on, and each row's term, parent's row (-1 for none) and position."""
    n = rows.num_rows
    pos, kind, label = (_plain(rows[c]) for c in ("pos", "kind", "label"))
    ids = rows["id"].combine_chunks()
    up = pc.fill_null(pc.index_in(rows["parent"].combine_chunks(), value_set=ids, skip_nulls=True), -1).to_numpy(zero_copy_only=False).tolist()
    kids: dict[int, list[int]] = {}
    for i, j in enumerate(up):
        if j >= 0:
            if j in kids:
                kids[j].append(i)
            else:
                kids[j] = [i]
    left, term, cid = {j: len(k) for j, k in kids.items()}, [None] * n, known.cid
    ready = [i for i in range(n) if i not in left]
    for i in ready:  # grows while it is read
        below, parts = (), None
        if i in kids:
            below = kids[i]
            if len(below) > 1:
                below.sort(key=lambda k: (pos[k], cid[term[k]]))
                if pos[below[0]] // PART != pos[below[-1]] // PART:
                    parts = tuple([pos[k] // PART for k in below])
            below = tuple([term[k] for k in below])
        key = (kind[i], label[i], below, parts)
        term[i] = known.numbers[key] if key in known.numbers else known.add(key)
        if (j := up[i]) >= 0:
            left[j] -= 1
            if not left[j]:
                ready.append(j)
    return ready, term, up, pos


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Nodes of whole trees from batches in order of trees; the last tree of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column(0)
        first, last, before = tree[0].as_py(), tree[-1].as_py(), held[0].column(0)[0].as_py() if held else None
        if held and before != first:
            yield pa.Table.from_batches(held)
            held = []
        # rows of one tree stand together, so its first one cuts the batch
        cut = pc.index(*((tree.is_null(), True) if last is None else (tree, tree[-1]))).as_py()
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node with its term and its parent's."""
    known = _Known()
    for rows in _runs(batches):
        ready, term, up, _ = _hashed(known, rows)
        if ready:
            mine = rows.select(["id", "parent", "pos", "kind", "label"]).take(pa.array(ready))
            over = [None if up[i] < 0 else term[up[i]] for i in ready]
            columns = {"cid": pa.array([known.cid[term[i]] for i in ready], pa.string()), "height": pa.array([known.height[term[i]] for i in ready], pa.int32()), "up": pa.array([None if t is None else known.cid[t] for t in over], pa.string())}
            for name, column in columns.items():
                mine = mine.append_column(name, column)
            yield from mine.combine_chunks().to_batches()
        if known.size > KNOWN:
            known = _Known()


def _counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of nodes with their uses, a few times from each task."""
    known, uses, types = _Known(), Counter(), None

    def out() -> Iterator[pa.RecordBatch]:
        if uses:
            pick = lambda column: [column[t] for t in uses]
            yield pa.record_batch([pa.array(pick(known.cid), pa.string()), pa.array(pick(known.kind), types[0]), pa.array(pick(known.label), types[1]), pa.array(pick(known.height), pa.int32()), pa.array(list(uses.values()), pa.int64())], names=["cid", "kind", "label", "height", "uses"])

    for rows in _runs(batches):
        types = [rows.schema.field(c).type for c in ("kind", "label")]
        ready, term, _, _ = _hashed(known, rows)
        uses.update([term[i] for i in ready])
        if known.size > KNOWN:
            yield from out()
            known, uses = _Known(), Counter()
    yield from out()


def _counted_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between terms with their uses, a few times from each task."""
    known, uses, type_ = _Known(), Counter(), None

    def out() -> Iterator[pa.RecordBatch]:
        if uses:
            up, pos, child = zip(*uses)
            cids = [pa.array([known.cid[t] for t in terms], pa.string()) for terms in (up, child)]
            yield pa.record_batch([cids[0], pa.array(pos, type_), cids[1], pa.array(list(uses.values()), pa.int64())], names=["cid", "pos", "child", "uses"])

    for rows in _runs(batches):
        type_ = rows.schema.field("pos").type
        ready, term, up, pos = _hashed(known, rows)
        uses.update([(term[up[i]], pos[i], term[i]) for i in ready if up[i] >= 0 and term[up[i]] is not None])
        if known.size > KNOWN:
            yield from out()
            known, uses = _Known(), Counter()
    yield from out()


class TermGraph:
    """``nodes`` (``id, parent, pos, kind, label``; a root has no parent) interned.

    ``tree`` names a column with the tree of each node, which is that of its parent too; ``sizes`` (``n``, a row a tree) says how many nodes trees have at most, where that is known without making them.  ``ids``: ``id, cid, height`` of every node; :meth:`terms`, :meth:`edges` are the graph.  Nodes on a cycle of parents, or
    below one, get no id; :meth:`unfinished` has them.
    """

    def __init__(self, nodes: DataFrame, tree: str | None = None, most: int = TREE, sizes: DataFrame | None = None):
        self.nodes = nodes.select("id", "parent", "pos", "kind", "label")
        self.types = {f.name: f.dataType.simpleString() for f in self.nodes.schema}
        self.sized = self.large = None
        if tree is None:
            self._by_level(self.nodes)
            up = self.ids.select(F.col("id").alias("parent"), F.col("cid").alias("up"))
            self.placed = self.nodes.join(self.ids, "id").join(up, "parent", "left")
            return
        rows = nodes.select(F.col(tree).alias("tree"), *self.nodes.columns).filter("id is not null")
        largest = (rows.groupBy("tree").agg(F.count("*").alias("n")) if sizes is None else sizes).agg(F.max("n")).first()[0]
        # a count over trees asks for their nodes side by side, and moves none that lie so
        counted = rows.withColumn("n", F.count("*").over(Window.partitionBy("tree")))
        self.sized = counted.filter(F.col("n") <= most).select("tree", *self.nodes.columns)
        shape = ", ".join(f"{c} {self.types[c]}" for c in self.nodes.columns)
        self.placed = self.sized.mapInArrow(_trees, f"{shape}, cid string, height int, up string")
        if (largest or 0) > most:
            self.large = TermGraph(counted.filter(F.col("n") > most).select(*self.nodes.columns))
            self.placed = self.placed.unionByName(self.large.placed)
        self.ids = self.placed.select("id", "cid", "height")

    def _by_level(self, nodes: DataFrame) -> None:
        arity = self.nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("arity"))
        shape = written(self.nodes.join(arity, "id", "left").withColumn("arity", F.coalesce("arity", F.lit(0))), "terms-shape")
        empty = F.sha2(F.lit(""), 256)
        level = written(shape.filter("arity = 0").select("id", "parent", "pos", term_id(F.col("kind"), F.col("label"), F.lit(0), empty).alias("cid"), F.lit(0).alias("height")), "terms-level")
        levels, waiting = [level], None
        while not level.isEmpty():
            children = level.filter("parent is not null").select(F.col("parent").alias("id"), "pos", "cid", "height")
            come = children if waiting is None else children.unionByName(waiting)
            # of a parent whose children are not all here, what has come waits
            have = come.groupBy("id").agg(F.count("*").alias("have"), F.max("height").alias("top"))
            ready = shape.join(have, "id").filter("arity = have").select("id", "parent", F.col("pos").alias("at"), "kind", "label", "arity", (F.col("top") + 1).alias("height"))
            parts = come.select("id", "pos", "cid").join(ready.select("id"), "id", "left_semi").groupBy("id", F.floor(F.col("pos") / PART).alias("part"))
            parts = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cid"))), lambda x: x["cid"]), ""), 256).alias("h"))
            parts = parts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "").alias("children"))
            last, level = level, written(ready.join(parts, "id").select("id", "parent", F.col("at").alias("pos"), term_id(F.col("kind"), F.col("label"), F.col("arity"), F.col("children")).alias("cid"), "height"), "terms-level")
            kept, waiting = waiting, written(come.join(level.select("id"), "id", "left_anti"), "terms-waiting")
            if kept is not None:
                dropped(kept)
            levels.append(level)
        self.ids = levels[0].select("id", "cid", "height")
        for t in levels[1:]:
            self.ids = self.ids.unionByName(t.select("id", "cid", "height"))
        self.ids = written(self.ids, "terms-ids")
        dropped(shape, waiting, *levels) if waiting is not None else dropped(shape, *levels)

    def terms(self) -> DataFrame:
        """Each term once: ``cid, kind, label, height, uses`` (nodes that are this term)."""
        if self.sized is None:
            return self.placed.groupBy("cid", "kind", "label", "height").agg(F.count("*").alias("uses"))
        each = self.sized.mapInArrow(_counted_terms, f"cid string, kind {self.types['kind']}, label {self.types['label']}, height int, uses long")
        return self._summed(each if self.large is None else each.unionByName(self.large.terms()), ["cid"], ["kind", "label", "height"])

    def edges(self) -> DataFrame:
        """``cid, pos, child, uses``: a term's children."""
        if self.sized is None:
            return self.placed.filter("up is not null").groupBy(F.col("up").alias("cid"), "pos", F.col("cid").alias("child")).agg(F.count("*").alias("uses"))
        each = self.sized.mapInArrow(_counted_edges, f"cid string, pos {self.types['pos']}, child string, uses long")
        return self._summed(each if self.large is None else each.unionByName(self.large.edges()), ["cid", "child"], ["pos"]).select("cid", "pos", "child", "uses")

    @staticmethod
    def _summed(each: DataFrame, hashes: list[str], others: list[str]) -> DataFrame:
        """Uses by hashes, which travel as bytes, and by other columns."""
        sums = each.groupBy(*[F.unhex(h).alias(h) for h in hashes], *others).agg(F.sum("uses").alias("uses"))
        return sums.select(*[F.lower(F.hex(h)).alias(h) for h in hashes], *others, "uses")

    def roots(self) -> DataFrame:
        return self.placed.filter("parent is null").select("id", "cid")

    def unfinished(self) -> DataFrame:
        return self.nodes.join(self.ids.select("id"), "id", "left_anti")
