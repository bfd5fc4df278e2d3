"""Queries of incremental recomputation, consumption state, interned terms and graphs, registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.functions import utf8
from claimloom.operators import determinism, graphs, lattice, selection
from claimloom.operators.incremental import Workspace
from claimloom.operators.interning import TermGraph
from claimloom.plans.catalogue import _t, query
from claimloom.sources import kit
from claimloom.sources.scratch import folder
from claimloom.streaming import cursors

# --- incremental recomputation: orders -> customers (brackets of 100,000) -> nations (sums) -> regions (maxima) ---

_EDIT = "CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 0.01 WHEN o_orderkey % 89 = 1 THEN o_totalprice * 2 ELSE o_totalprice END"
#: An edited slice: prices moved by a cent, prices doubled, orders withdrawn.
_GONE = "o_orderkey % 101 <> 5"


def _orders(spark, sf, edited: bool):
    o = _t(spark, sf, "orders")
    return o.filter(_GONE).withColumn("o_totalprice", F.expr(_EDIT)) if edited else o


def _sources(orders):
    return orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("value"))


def _deps(spark, sf, orders):
    """Who reads what; customers 7, 57, 107 ... do not know all that they read."""
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    buyers = c.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    sold = n.join(buyers.select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    one = lambda d, level, node, input_, known: d.select(F.concat(*node).alias("node"), F.lit(level).alias("level"), F.concat(*input_).alias("input"), known.alias("complete"))
    return (
        one(orders, 1, (F.lit("c"), "o_custkey"), (F.lit("o"), "o_orderkey"), F.col("o_custkey") % 50 != 7)
        .unionByName(one(buyers, 2, (F.lit("n"), "c_nationkey"), (F.lit("c"), "c_custkey"), F.lit(True)))
        .unionByName(one(sold, 3, (F.lit("r"), "n_regionkey"), (F.lit("n"), "n_nationkey"), F.lit(True)))
    )


RULES = {
    1: lambda d: d.groupBy("node").agg(F.expr("cast(sum(cast(value as long)) div 10000000 as string)").alias("value")),
    2: lambda d: d.groupBy("node").agg(F.sum(F.col("value").cast("long")).cast("string").alias("value")),
    3: lambda d: d.groupBy("node").agg(F.max(F.col("value").cast("long")).cast("string").alias("value")),
}

_LEVELS = """{p}c AS (SELECT o_custkey AS k, sum(round({price} * 100)::BIGINT) // 10000000 AS v FROM orders WHERE {where} GROUP BY 1),
    {p}n AS (SELECT c_nationkey AS k, sum(v) AS v FROM {p}c JOIN customer ON c_custkey = k GROUP BY 1), {p}r AS (SELECT n_regionkey AS k, max(v) AS v FROM {p}n JOIN nation ON n_nationkey = k GROUP BY 1)"""
_BEFORE, _AFTER = _LEVELS.format(p="a", price="o_totalprice", where="true"), _LEVELS.format(p="b", price=f"({_EDIT})", where=_GONE)


@query("incremental_refresh", f"""WITH {_BEFORE}, {_AFTER},
    tc AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 1 OR NOT ({_GONE}) OR o_custkey % 50 = 7),
    mc AS (SELECT coalesce(ac.k, bc.k) AS k FROM ac FULL JOIN bc ON ac.k = bc.k WHERE ac.v IS DISTINCT FROM bc.v), tn AS (SELECT DISTINCT c_nationkey AS k FROM mc JOIN customer ON c_custkey = k),
    mn AS (SELECT coalesce(an.k, bn.k) AS k FROM an FULL JOIN bn ON an.k = bn.k WHERE an.v IS DISTINCT FROM bn.v), tr AS (SELECT DISTINCT n_regionkey AS k FROM mn JOIN nation ON n_nationkey = k)
    SELECT 1 AS level, 'c' || k AS id, v::VARCHAR AS value, CASE WHEN k IN (SELECT k FROM tc) THEN 'recomputed' ELSE 'kept' END AS status FROM bc
    UNION ALL SELECT 2, 'n' || k, v::VARCHAR, CASE WHEN k IN (SELECT k FROM tn) THEN 'recomputed' ELSE 'kept' END FROM bn
    UNION ALL SELECT 3, 'r' || k, v::VARCHAR, CASE WHEN k IN (SELECT k FROM tr) THEN 'recomputed' ELSE 'kept' END FROM br""")
def incremental_refresh(spark, sf):
    w = Workspace(spark)
    for edited in (False, True):
        orders = _orders(spark, sf, edited)
        out = w.refresh(_sources(orders), _deps(spark, sf, orders), RULES)
    return out


@query("incremental_revert", f"""WITH {_BEFORE}, {_AFTER},
    tc AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 1 OR NOT ({_GONE}) OR o_custkey % 50 = 7),
    mc AS (SELECT coalesce(ac.k, bc.k) AS k FROM ac FULL JOIN bc ON ac.k = bc.k WHERE ac.v IS DISTINCT FROM bc.v), tn AS (SELECT DISTINCT c_nationkey AS k FROM mc JOIN customer ON c_custkey = k),
    mn AS (SELECT coalesce(an.k, bn.k) AS k FROM an FULL JOIN bn ON an.k = bn.k WHERE an.v IS DISTINCT FROM bn.v), tr AS (SELECT DISTINCT n_regionkey AS k FROM mn JOIN nation ON n_nationkey = k),
    s AS (SELECT 1 AS level, 'c' || k AS id, v, k IN (SELECT k FROM tc) AS hit FROM ac UNION ALL SELECT 2, 'n' || k, v, k IN (SELECT k FROM tn) FROM an UNION ALL SELECT 3, 'r' || k, v, k IN (SELECT k FROM tr) FROM ar)
    SELECT level, id, v::VARCHAR AS value, CASE WHEN hit THEN 'hit' ELSE 'kept' END AS status FROM s""")
def incremental_revert(spark, sf):
    """An edit that is committed and taken back: all that it moved is found in the cache, nothing is computed again."""
    w = Workspace(spark)
    for edited in (False, True, False):
        orders = _orders(spark, sf, edited)
        out = w.refresh(_sources(orders), _deps(spark, sf, orders), RULES)
    return out


# --- consumption state: users are iterators, event types are operations ---

_OPERATION = "CASE event_type WHEN 'signup' THEN 'define' WHEN 'view' THEN 'advance' WHEN 'click' THEN 'advance' WHEN 'purchase' THEN 'consume' WHEN 'error' THEN 'reset' ELSE event_type END"
_CONSUMED = f"""WITH e AS (SELECT user_id::VARCHAR AS key, ts, event_id AS id, {_OPERATION} AS op FROM events),
    v AS (SELECT *, count_if(op = 'define') OVER w AS version, count_if(op IN ('define', 'reset')) OVER w AS part, op IN ('advance', 'consume') AS takes FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, id)),
    g AS (SELECT *, coalesce(count_if(op = 'consume') OVER (PARTITION BY key, version ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS gone FROM v),
    r AS (SELECT *, CASE WHEN takes AND version = 0 THEN 'refused:undefined' WHEN takes AND gone THEN 'refused:consumed' END AS refused FROM g),
    o AS (SELECT *, CASE WHEN takes AND refused IS NULL THEN count_if(takes AND refused IS NULL) OVER (PARTITION BY key, part ORDER BY ts, id) - 1 END AS occurrence FROM r)
    SELECT key, id, version, occurrence, CASE WHEN occurrence = 0 THEN '@def' || version WHEN occurrence > 0 THEN '@adv' || occurrence END AS alias, coalesce(refused, op) AS outcome FROM o"""


def _operations(spark, sf):
    return _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.expr(_OPERATION).alias("op"))


@query("consumption_batch", _CONSUMED)
def consumption_batch(spark, sf):
    return cursors.batch(_operations(spark, sf))


@query("consumption_stream", _CONSUMED)
def consumption_stream(spark, sf):
    """All events as a stream of three runs that go on from one checkpoint: shuffled, and every tenth a run later than its time."""
    path, ops = folder(spark, "cursors"), _operations(spark, sf)
    span = ops.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    if span.lo is None:
        return cursors.batch(ops)
    third = (span.hi - span.lo).total_seconds() / 3 + 1
    run = F.floor((F.unix_micros("ts") / 1_000_000 - F.lit(span.lo).cast("timestamp").cast("double")) / third)
    run = F.least(F.lit(2), run + F.when(F.xxhash64("id") % 10 == 0, 1).otherwise(0))
    ops = ops.withColumn("run", run.cast("int"))
    delay = f"{int(2 * third) + 1} seconds"
    for k in range(3):
        part = ops.filter(F.col("run") == k).drop("run")
        if k == 2:  # a time that lets all before it pass
            last = ops.agg((F.max("ts") + F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {int(2 * third) + cursors.BUCKET_MS // 500})")).alias("ts"))
            part = part.unionByName(last.select(F.lit("").alias("key"), "ts", F.lit(-1).cast("long").alias("id"), F.lit("close").alias("op")))
        part.orderBy(F.rand(k)).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(part.schema).parquet(f"{path}/in")
        cursors.append_to(cursors.stream(source, delay), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").filter("key <> ''")


# --- interned terms: each order is the sum of its lines, ((q1 + q2) + q3) ..., each line a constant ---


def _sums(spark, sf):
    """Node ``<order>/<line>`` adds line ``<line>`` to what stands before; ``<order>/<line>c`` is the line's constant."""
    line = Window.partitionBy("tree").orderBy("l_linenumber", "l_partkey", "l_suppkey", "quantity")
    l = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tree"), "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_quantity").alias("quantity"))
    l = l.select("tree", (F.col("quantity").cast("int") % 10).cast("string").alias("q"), F.row_number().over(line).alias("n"), F.count("*").over(Window.partitionBy("tree")).alias("m"))
    at = lambda n, c="": F.concat(F.col("tree").cast("string"), F.lit("/"), n.cast("string"), F.lit(c))
    n, above = F.col("n"), F.when(F.col("n") < F.col("m"), at(F.col("n") + 1))
    node = lambda id_, parent, pos, kind, label: F.struct(id_.alias("id"), parent.alias("parent"), pos.alias("pos"), F.lit(kind).alias("kind"), label.alias("label"))
    plus = node(at(n), above, F.lit(0), "ctor", F.lit("+"))
    # the first line's node has its constant only
    const = node(at(n, "c"), at(n), F.when(n == 1, 0).otherwise(1), "const", F.col("q"))
    return l.select("tree", F.inline(F.array(plus, const)))  # both side by side, so that no tree is moved again


def _sizes(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg((2 * F.count("*")).alias("n"))


_TERMS = """WITH RECURSIVE l AS (SELECT l_orderkey AS o, (floor(l_quantity)::INTEGER % 10)::VARCHAR AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, floor(l_quantity)) AS n FROM lineitem),
    k AS (SELECT o, n, q, sha256('const' || chr(31) || q || chr(31) || '0' || chr(31) || sha256('')) AS c FROM l),
    p AS (SELECT o, n, c, NULL::VARCHAR AS below, sha256('ctor' || chr(31) || '+' || chr(31) || '1' || chr(31) || sha256(c)) AS cid FROM k WHERE n = 1
      UNION ALL SELECT k.o, k.n, k.c, p.cid, sha256('ctor' || chr(31) || '+' || chr(31) || '2' || chr(31) || sha256(p.cid || k.c)) FROM p JOIN k ON k.o = p.o AND k.n = p.n + 1)"""


@query("term_graph", _TERMS + """ SELECT c AS cid, 'const' AS kind, q AS label, 0 AS height, count(*) AS uses FROM k GROUP BY 1, 3 UNION ALL SELECT cid, 'ctor', '+', n::INTEGER, count(*) FROM p GROUP BY 1, 4""")
def term_graph(spark, sf):
    return TermGraph(_sums(spark, sf), "tree", sizes=_sizes(spark, sf)).terms()


@query("term_edges", _TERMS + """ SELECT cid, pos::INTEGER AS pos, child, count(*) AS uses FROM (SELECT cid, CASE WHEN n = 1 THEN 0 ELSE 1 END AS pos, c AS child FROM p UNION ALL SELECT cid, 0, below FROM p WHERE below IS NOT NULL) GROUP BY 1, 2, 3""")
def term_edges(spark, sf):
    return TermGraph(_sums(spark, sf), "tree", sizes=_sizes(spark, sf)).edges()


# --- graphs: rings of 40 customers, every third block a chain; links on to twice the number ---

_LINKS = """SELECT c_custkey AS a, CASE WHEN c_custkey % 40 = 39 THEN c_custkey - 39 ELSE c_custkey + 1 END AS b FROM customer WHERE NOT (c_custkey % 40 = 39 AND c_custkey // 40 % 3 = 1)
    UNION SELECT c_custkey, 2 * c_custkey FROM customer WHERE c_custkey % 40 = 5 UNION SELECT c_custkey, c_custkey FROM customer WHERE c_custkey % 120 = 77"""


@query("cyclic_components", f"""WITH RECURSIVE e AS ({_LINKS}), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT p.a AS node, min(p.b) AS component FROM r p JOIN r q ON q.a = p.b AND q.b = p.a GROUP BY p.a""")
def cyclic_components(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("a"))
    on = c.filter("not (a % 40 = 39 and a div 40 % 3 = 1)").select("a", F.expr("case when a % 40 = 39 then a - 39 else a + 1 end").alias("b"))
    return graphs.components(on.union(c.filter("a % 40 = 5").select("a", F.col("a") * 2)).union(c.filter("a % 120 = 77").select("a", "a")), "a", "b")


_TREE = """WITH RECURSIVE p AS (SELECT c_custkey AS v, [c_custkey] AS path, 0 AS depth FROM customer WHERE c_custkey = 0
      UNION ALL SELECT c_custkey, list_append(path, c_custkey), depth + 1 FROM p JOIN customer ON c_custkey // 3 = v AND c_custkey > 0)"""


def _labels(spark, sf):
    return graphs.intervals(_t(spark, sf, "customer").select("c_custkey", F.expr("nullif(c_custkey div 3, c_custkey)").alias("parent")), "c_custkey", "parent")


@query("enclosure_intervals", _TREE + """, n AS (SELECT a, count(*) AS n FROM (SELECT unnest(path) AS a FROM p) GROUP BY a), o AS (SELECT v, depth, row_number() OVER (ORDER BY path) - 1 AS f FROM p)
    SELECT v AS node, f AS first, f + n - 1 AS last, depth FROM o JOIN n ON a = v""")
def enclosure_intervals(spark, sf):
    return _labels(spark, sf)


@query("enclosure_tests", _TREE + " SELECT o_orderkey, o_orderkey % 50 <> o_custkey AND list_contains(path, o_orderkey % 50) AS encloses FROM orders JOIN p ON v = o_custkey")
def enclosure_tests(spark, sf):
    pairs = _t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 50).alias("outer"), F.col("o_custkey").alias("inner"))
    return graphs.encloses(pairs, _labels(spark, sf), "outer", "inner").select("o_orderkey", "encloses")


# --- losses along searched paths: customers to nations, nations to nations ---

_LOSS_EDGES = """SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b, [0, 1, 2, 4, 8, 0][1 + c_custkey % 6] AS bits FROM customer
    UNION SELECT 'n' || n_nationkey, 'n' || (n_nationkey * 2 + 1) % 25, [0, 1, 2][1 + n_nationkey % 3] FROM nation UNION SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 5) % 25, [4, 0, 8, 1][1 + n_nationkey % 4] FROM nation"""


@query("least_losses", f"""WITH RECURSIVE e AS ({_LOSS_EDGES}), r AS (SELECT a, b, bits FROM e WHERE a LIKE 'c%' UNION SELECT r.a, e.b, r.bits | e.bits FROM r JOIN e ON e.a = r.b)
    SELECT a AS source, b AS target, CASE WHEN bits & 12 = 12 THEN 'compound:saturating+wrapping' WHEN bits & 8 <> 0 THEN 'wrapping' WHEN bits & 4 <> 0 THEN 'saturating' WHEN bits & 2 <> 0 THEN 'narrowing' WHEN bits & 1 <> 0 THEN 'widening' ELSE 'none' END AS loss, bits
    FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.a = r.a AND x.b = r.b AND x.bits & r.bits = x.bits AND x.bits <> r.bits)""")
def least_losses(spark, sf):
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    pick = lambda labels, k: F.get(F.array(*[F.lit(x) for x in labels]), (k % len(labels)).cast("int"))
    nation = lambda k: F.concat(F.lit("n"), k.cast("string"))
    k = F.col("n_nationkey")
    edges = c.select(F.concat(F.lit("c"), "c_custkey").alias("a"), nation(F.col("c_nationkey")).alias("b"), pick(["none", "widening", "narrowing", "saturating", "wrapping", "none"], F.col("c_custkey")).alias("loss"))
    edges = edges.unionByName(n.select(nation(k).alias("a"), nation((k * 2 + 1) % 25).alias("b"), pick(["none", "widening", "narrowing"], k).alias("loss")))
    edges = edges.unionByName(n.select(nation(k).alias("a"), nation((k + 5) % 25).alias("b"), pick(["saturating", "none", "wrapping", "widening"], k).alias("loss")))
    out = lattice.least_losses(edges.withColumn("bits", lattice.mode(F.col("loss"))), c.select(F.concat(F.lit("c"), "c_custkey").alias("source")))
    return out.select("source", "target", lattice.label(F.col("bits")).alias("loss"), "bits")


# --- exact percentiles by counting ---


@query("percentile_rounds", "WITH p AS (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.9, 1.0]) AS p), r AS (SELECT l_suppkey, l_extendedprice - 30000 AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, p, min(v) AS result FROM r, p WHERE k = least(n, greatest(1, ceil(p * n - 1e-9))) GROUP BY 1, 2")
def percentile_rounds(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_suppkey", (F.col("l_extendedprice") - 30000).alias("v"))
    return selection.nearest_ranks(rows, ["l_suppkey"], "v", [0.0, 0.25, 0.5, 0.9, 1.0])


# --- stored queries: each nation has one ---

_STORED = [
    ("'select p_partkey, p_name from part where p_size = {} order by p_partkey limit 5'", ""),
    ("'select p_name from part where p_size > {} order by p_size limit 5'", "limit,order"),
    ("'select count(*) as n from orders where o_custkey = {}'", ""),
    ("'select rand() as r, n_name from nation where n_nationkey < {} order by n_nationkey'", "random"),
    ("'select current_date() as today, max(o_orderdate) as last from orders where o_custkey > {}'", "clock"),
    ("'select o_custkey, sum(o_totalprice) as s from orders where o_orderkey > {} group by o_custkey order by o_custkey'", ""),
    ("'select o_custkey, first(o_orderkey) as f from orders where o_orderkey > {} group by o_custkey order by o_custkey'", "arrival"),
    ("'select x from nowhere where x = {}'", "unknown"),
    ("'select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate) as n from orders where o_custkey < {} order by o_orderkey'", "window"),
    ("'select n_name, p_name from nation join part on p_size = n_nationkey where n_nationkey < {} order by n_nationkey, p_partkey'", ""),
    ("'select distinct p_size from part where p_partkey > {}'", "order"),
]


@query("determinism_plans", "SELECT n_nationkey, faults, faults = '' AS runs FROM (SELECT n_nationkey, [" + ", ".join(f"'{f}'" for _, f in _STORED) + f"][1 + n_nationkey % {len(_STORED)}] AS faults FROM nation)")
def determinism_plans(spark, sf):
    n = _t(spark, sf, "nation")
    text = F.get(F.array(*[F.replace(F.expr(t), F.lit("{}"), F.col("n_nationkey").cast("string")) for t, _ in _STORED]), (F.col("n_nationkey") % len(_STORED)).cast("int"))
    tables = {name: (_t(spark, sf, name), [key]) for name, key in (("part", "p_partkey"), ("orders", "o_orderkey"), ("nation", "n_nationkey"))}
    return determinism.judged(n.select("n_nationkey", text.alias("text")), tables, "n_nationkey")


# --- texts that break in the middle: what four of five documents have there is no character ---

_BREAKS = ["", "C3", "E282", "F09F98", "C0AF"]


@query("utf8_chunks", """WITH d AS (SELECT doc_id, left(text, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b, doc_id % 5 AS k FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, 0 AS chunk, a || b AS valid, '' AS invalid FROM d WHERE k = 0 AND a || b <> '' UNION ALL SELECT doc_id, 0, a, ['C3', 'E282', 'F09F98', 'C0'][k::INTEGER] FROM d WHERE k > 0
      UNION ALL SELECT doc_id, 1, '', 'AF' FROM d WHERE k = 4 UNION ALL SELECT doc_id, CASE WHEN k = 4 THEN 2 ELSE 1 END, b, '' FROM d WHERE k > 0 AND b <> '')
    SELECT doc_id, chunk, sha256(valid) AS valid_sha256, strlen(valid) AS valid_bytes, invalid FROM c""")
def utf8_chunks(spark, sf):
    d = _t(spark, sf, "documents").filter("text is not null")
    half = F.expr("length(text) div 2")
    broken = F.get(F.array(*[F.unhex(F.lit(x)) for x in _BREAKS]), (F.col("doc_id") % 5).cast("int"))
    raw = F.concat(F.substring("text", F.lit(1), half.cast("int")).cast("binary"), broken, F.substring("text", (half + 1).cast("int"), F.length("text")).cast("binary"))
    out = utf8.chunks(d.select("doc_id", raw.alias("raw")), "doc_id", "raw")
    return out.select(F.col("id").alias("doc_id"), "chunk", F.sha2("valid", 256).alias("valid_sha256"), F.octet_length("valid").alias("valid_bytes"), F.hex("invalid").alias("invalid"))


# --- a kit's enumeration: facts of a file, gaps as rows ---


@query("kit_facts", """SELECT o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, CASE WHEN o_orderpriority IS NULL THEN 'missing-file' END AS reason FROM orders GROUP BY 1
    UNION ALL SELECT NULL, 1, NULL, 'missing-file'""")
def kit_facts(spark, sf):
    asked = lambda at: kit.enumerated(spark, sf, "facts", at=at)
    rows = asked("orders.parquet").unionByName(asked("order.parquet"))
    of = F.from_json("payload", "o_orderkey long, o_orderpriority string")
    return rows.groupBy(of["o_orderpriority"].alias("o_orderpriority"), "reason").agg(F.count("*").alias("n"), F.sum(of["o_orderkey"]).alias("keys")).select("o_orderpriority", "n", "keys", "reason")


@query("kit_seek", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 5 AND 9")
def kit_seek(spark, sf):
    """A slice by pushed bounds and a fact by its seek; nations lie in order of their keys."""
    got = kit.enumerated(spark, sf, "facts", at="nation.parquet").filter("ordinal between 5 and 8").unionByName(kit.enumerated(spark, sf, "facts", at="nation.parquet", seek="true", ordinal=9))
    return got.select(F.from_json("payload", "n_nationkey long, n_name string").alias("r")).select(F.col("r.n_nationkey").alias("n_nationkey"), "r.n_name")
