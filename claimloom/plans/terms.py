"""Queries of formulas, witnesses, manifests, relations and the cap of sequences, registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import canonical
from claimloom.functions.sorts import with_sorts
from claimloom.functions import sequences as S
from claimloom.operators import linking, predicates
from claimloom.plans.catalogue import _SEQ, _SEQUENCES, _checkpoints, _t, query, sequences
from claimloom.plans.records import _lines, operators
from claimloom.sources import pool
from claimloom.sources.scratch import folder

# --- formulas: one per order, its binder named by the order ---


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("formula_alpha", """SELECT o_orderkey, '{"body":{"args":[{"kind":"var","name":"$b0"},{"kind":"const","value":' || o_custkey || '},{"kind":"var","name":"free"}],"kind":"ctor","name":"between"},"kind":"forall","name":"$b0"}' AS form FROM orders""")
def formula_alpha(spark, sf):
    """Formulas that differ in their binders' names, in a let around them and in the order of keys are one."""
    name = F.concat(F.lit("v"), (F.col("o_orderkey") % 7).cast("string"))
    body = _text('{"name":"between","kind":"ctor","args":[{"name":"', name, '","kind":"var"},{"value":', F.col("o_custkey"), ',"kind":"const"},{"kind":"var","name":"free"}]}')
    plain = _text('{"kind":"forall","name":"', name, '","body":', body, "}")
    let = _text('{"kind":"let","name":"k","value":{"kind":"const","value":', F.col("o_custkey"), '},"body":', F.replace(plain, _text('{"value":', F.col("o_custkey"), ',"kind":"const"}'), F.lit('{"kind":"var","name":"k"}')), "}")
    return _t(spark, sf, "orders").select("o_orderkey", canonical.alpha_form(F.when(F.col("o_orderkey") % 3 == 0, let).otherwise(plain)).alias("form"))


_OPS = ["&", "|", "^", "<<", ">>"]


@query("formula_fold", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{"kind":"const","sort":{"kind":"primitive","name":"Int"},"value":' || CASE l_orderkey % 5 WHEN 0 THEN (l_partkey & l_suppkey)::HUGEINT WHEN 1 THEN (l_partkey | l_suppkey)::HUGEINT WHEN 2 THEN xor(l_partkey, l_suppkey)::HUGEINT
    WHEN 3 THEN l_partkey::HUGEINT * (1::HUGEINT << (l_suppkey % 60)::HUGEINT) ELSE (l_partkey >> (l_suppkey % 60))::HUGEINT END || '}' AS form FROM lineitem""")
def formula_fold(spark, sf):
    k = F.col("l_orderkey") % 5
    const = lambda c: _text('{"kind":"const","value":', c, "}")
    op = F.get(F.array(*[F.lit(o) for o in _OPS]), k.cast("int"))
    right = F.when(k >= 3, F.col("l_suppkey") % 60).otherwise(F.col("l_suppkey"))
    text = _text('{"kind":"ctor","name":"', op, '","args":[', const(F.col("l_partkey")), ",", const(right), "]}")
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", canonical.alpha_form(text).alias("form"))


@query("formula_instances", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'forall y. (' || o_custkey || ' <= y)' WHEN 1 THEN 'forall y''. (y <= y'')' WHEN 2 THEN '(' || o_custkey || ' <= z)' END AS text FROM orders""")
def formula_instances(spark, sf):
    """``forall x. forall y. x <= y``: for a number, for a variable that the inner binder would capture, for two terms, for more terms than binders."""
    formula = '{"kind":"forall","name":"x","body":{"kind":"forall","name":"y","body":{"kind":"ctor","name":"<=","args":[{"kind":"var","name":"x"},{"kind":"var","name":"y"}]}}}'
    k, number = F.col("o_orderkey") % 4, _text('{"kind":"const","value":', F.col("o_custkey"), "}")
    var = lambda n: f'{{"kind":"var","name":"{n}"}}'
    actuals = F.when(k == 0, _text("[", number, "]")).when(k == 1, f"[{var('y')}]").when(k == 2, _text("[", number, f",{var('z')}]")).otherwise(_text("[", number, f",{var('z')},{var('z')}]"))
    return _t(spark, sf, "orders").select("o_orderkey", canonical.as_text(canonical.instantiated(F.lit(formula), actuals)).alias("text"))


# --- witnesses of the registry's operators ---


@query("registry_witnesses", "SELECT unnest(['const', 'var', 'twice', 'sum']) AS name, count(*) AS rows, count(*) AS good, 0::BIGINT AS bad FROM orders")
def registry_witnesses(spark, sf):
    return operators().witnesses(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("x")))


# --- pools: manifests, and a body under two names ---


@query("pool_manifest", """SELECT o_orderpriority AS name, count(DISTINCT o_custkey) AS members, NULL::VARCHAR AS reason FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1
    UNION ALL SELECT 'all', count(DISTINCT o_orderpriority || o_custkey), NULL FROM orders WHERE o_orderkey % 10 <> 0""")
def pool_manifest(spark, sf):
    """Groups by the manifest that was written, with what is wrong with them; all bodies stand in a second group too."""
    path, lines = folder(spark, "pool"), pool.members(_lines(spark, sf))
    pool.seal(lines.unionByName(lines.withColumn("name", F.lit("all"))), path)
    m = spark.read.parquet(f"{path}/manifest").groupBy("name").agg(F.sum(F.size("member_cids")).alias("members"))
    return m.join(pool.manifest_gaps(spark, path), "name", "left")


# --- the other relations of the predicate layer ---


def _relations(spark, sf):
    l, p, e, o = (_t(spark, sf, n) for n in ("lineitem", "part", "events", "orders"))
    cid = lambda c: F.sha2(c.cast("string"), 256)
    args = F.array(F.struct(F.lit(0).alias("position"), F.lit("const").alias("kind"), F.col("l_quantity").cast("string").alias("text")))
    return {
        "call_edges": l.select(F.concat(F.lit("f"), "l_orderkey").alias("caller_function"), F.concat(F.lit("p"), "l_partkey").alias("callee_name"), args.alias("args"), F.col("l_returnflag").alias("callsite_path"), F.col("l_linenumber").alias("callsite_line"), F.lit(0).alias("callsite_column")),
        "contracts": o.select(F.concat(F.lit("f"), "o_orderkey").alias("function"), F.col("o_orderstatus").alias("kind"), F.lit("self").alias("binding"), cid(F.col("o_custkey")).alias("source_cid")),
        "lifted_files": p.select(F.col("p_name").alias("path"), F.col("p_size").alias("edge_count"), cid(F.col("p_partkey")).alias("source_cid")),
        "effects": e.select(F.concat(F.lit("u"), "user_id").alias("function"), F.get(F.array(*[F.lit(x) for x in ("Reads", "Writes", "Io", "Panics", "Sleeps")]), (F.col("event_id") % 5).cast("int")).alias("kind"), F.col("event_type").alias("target"), cid(F.col("event_id")).alias("source_cid")),
        "composed_contracts": l.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("chain")).select(cid(F.array_join("chain", ">")).alias("composed_cid"), "chain", cid(F.col("l_orderkey")).alias("effect_set_cid"), F.lit("1").alias("ccp_version"), cid(F.col("l_orderkey")).alias("source_cid")),
    }


@query("relation_checks", """WITH c AS (SELECT sha256(array_to_string(list_sort(list_distinct(list(l_partkey::VARCHAR))), '>')) AS k FROM lineitem GROUP BY l_orderkey)
    SELECT 'lifted_files' AS relation, 'key:repeated' AS rule, count(*) AS keys, sum(n)::BIGINT AS rows FROM (SELECT count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1) HAVING count(*) > 0
    UNION ALL SELECT 'effects', 'check:kind in (''Reads'', ''Writes'', ''Io'', ''Unsafe'', ''Panics'', ''UnresolvedCall'')', count(DISTINCT user_id), count(*) FROM events WHERE event_id % 5 = 4 HAVING count(*) > 0
    UNION ALL SELECT 'composed_contracts', 'key:repeated', count(*), sum(n)::BIGINT FROM (SELECT count(*) AS n FROM c GROUP BY k HAVING count(*) > 1) HAVING count(*) > 0""")
def relation_checks(spark, sf):
    """All five relations but ``functions``, from tables, against their keys and checks."""
    out = None
    for name, rows in _relations(spark, sf).items():
        bad = predicates.violations(rows, name).groupBy("rule").agg(F.count("*").alias("keys"), F.sum("rows").alias("rows")).select(F.lit(name).alias("relation"), "rule", "keys", "rows")
        out = bad if out is None else out.unionByName(bad)
    return out


@query("relation_joins", """SELECT 'f' || l_orderkey AS function, o_orderstatus AS kind, count(*) AS calls, count(DISTINCT l_partkey) AS callees FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE NOT EXISTS (SELECT 1 FROM part WHERE 'p' || p_partkey = 'p' || l_partkey AND p_size > 25) GROUP BY 1, 2""")
def relation_joins(spark, sf):
    """Contracts with their calls of parts that are no long files: call edges, contracts and files together."""
    r = _relations(spark, sf)
    long_ = _t(spark, sf, "part").filter("p_size > 25").select(F.concat(F.lit("p"), "p_partkey").alias("callee_name"))
    calls = r["call_edges"].join(long_, "callee_name", "left_anti").groupBy(F.col("caller_function").alias("function")).agg(F.count("*").alias("calls"), F.countDistinct("callee_name").alias("callees"))
    return r["contracts"].select("function", "kind").join(calls, "function")


# --- sequences above the cap: incomplete under every operator ---

_MOST = 66


@query("seq_over_cap", _SEQ + f"SELECT user_id, unnest([{', '.join(repr(n) for n in _SEQUENCES)}]) AS operator, CASE WHEN len(a) > {_MOST} THEN 'LengthCap' ELSE '' END AS over, CASE WHEN len(a) > {_MOST} THEN 'INCOMPLETE' END AS status FROM s")
def seq_over_cap(spark, sf):
    """Every operator on every sequence: one above the cap is incomplete by its length, and is not evaluated."""
    one = lambda name, made: F.struct(F.lit(name).alias("operator"), S.capped(F.col("a"), lambda a: made().cast("string"), _MOST).alias("o"))
    rows = sequences(spark, sf).select("user_id", F.inline(F.array(*[one(n, made) for n, (made, _) in _SEQUENCES.items()])))
    over = F.when(F.col("o.reason") == "LengthCap", "LengthCap").otherwise("")
    return rows.select("user_id", "operator", over.alias("over"), F.when(F.col("o.status") == "INCOMPLETE", F.when(over == "LengthCap", "INCOMPLETE")).alias("status"))


# --- fail-closed rules: names of the core, and keys that were revoked at a time ---


@query("fail_closed_times", """WITH RECURSIVE d AS (SELECT o_orderkey AS cid, o_orderkey // 2 AS on_ FROM orders WHERE o_orderkey % 5 = 1),
    v AS (SELECT o_orderkey AS cid FROM orders WHERE (o_custkey % 26 = 4 AND o_orderdate >= TIMESTAMP '2000-01-01') OR (o_custkey % 26 = 17 AND o_orderdate >= TIMESTAMP '2001-06-01')),
    r AS (SELECT d.cid FROM d JOIN v ON v.cid = d.on_ UNION SELECT d.cid FROM r JOIN d ON d.on_ = r.cid)
    SELECT cid::VARCHAR AS subject, 'signer_key_revoked' AS reason FROM v UNION ALL SELECT DISTINCT cid::VARCHAR, 'dependency_unresolvable' FROM r
    UNION ALL SELECT n_name, 'no_resolution' FROM nation WHERE n_nationkey % 3 = 0 AND n_name NOT IN ('NATION_0', 'NATION_3')""")
def fail_closed_times(spark, sf):
    """Orders as declarations by their customers: some keys are revoked, one of them twice; older declarations stand."""
    _checkpoints(spark)
    o, n, c = _t(spark, sf, "orders"), _t(spark, sf, "nation"), _t(spark, sf, "customer")
    k = F.col("o_orderkey")
    said = o.select(k.alias("cid"), F.lit(True).alias("signed"), F.lit(False).alias("revoked"), F.lit(True).alias("compatible"), F.col("o_custkey").alias("signer"), F.col("o_orderdate").alias("declared_at"))
    at = lambda day: F.lit(day).cast("timestamp_ntz").alias("revoked_at")
    gone = c.filter("c_custkey % 13 = 4").select(F.col("c_custkey").alias("signer"), at("2001-06-01")).unionByName(c.filter("c_custkey % 26 = 4").select(F.col("c_custkey").alias("signer"), at("2000-01-01")))
    entries = n.filter("n_nationkey % 3 <> 0").select(F.lit(0).alias("catalog"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("cid"))
    return linking.fail_closed(n.select(F.col("n_name").alias("name")), entries, said, o.filter(k % 5 == 1).select(k.alias("cid"), F.expr("o_orderkey div 2").alias("on")), ["NATION_0", "NATION_3"], gone)


# --- sources that are read at a time of their own, and the sorts of types ---


@query("seq_runtime_sources", _SEQ + "SELECT user_id, CASE WHEN user_id % 5 < 3 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status, CASE WHEN user_id % 5 < 3 THEN list_sum(a)::BIGINT END AS total, CASE WHEN user_id % 5 < 3 THEN '' ELSE 'AmbiguousTemporalIdentity' END AS reason FROM s")
def seq_runtime_sources(spark, sf):
    producer = F.get(F.array(*[F.lit(x) for x in ("literal", "range", "collection", "from_fn", None)]), (F.col("user_id") % 5).cast("int"))
    out = S.from_source(F.col("a"), producer, lambda a: S.fold(a, F.lit(0).cast("long"), lambda x, y: x + y))
    return sequences(spark, sf).select("user_id", out.alias("o")).select("user_id", "o.status", F.col("o.value").alias("total"), "o.reason")


#: Type texts and their sorts; {} is the part's size.
_TYPES = [
    ("u{}", "u{}"), ("&'a mut Vec<S{}>", "RefMut<Vec<S{}>>"), ("[f64; {}]", "Array<Real>"), ("(bool, std::option::Option<&str>, ())", "Tuple<Bool,Option<Ref<Str>>,Unit>"), ("*const [S{}]", "Ptr<Slice<S{}>>"), ("fn(i32, S{}) -> String", "FnPtr"),
    ("Box<dyn Iterator>", "Box<Opaque>"), ("HashMap<String, Result<(), my::Err{}>>", "HashMap<String,Result<Unit,Err{}>>"), ("[u8; {}", "Unknown"), ("(((usize)))", "Int"), ("&&'b [(char, &mut [i64; 3])]", "Ref<Ref<Slice<Tuple<Char,RefMut<Array<Int>>>>>>"),
]


@query("sort_names", "SELECT p_partkey, replace([" + ", ".join("'" + b + "'" for _, b in _TYPES) + f"][1 + p_partkey % {len(_TYPES)}], '{{}}', p_size::VARCHAR) AS s, CASE WHEN s IN ('u8', 'u16', 'u32') THEN 'Int' ELSE s END AS sort FROM part")
def sort_names(spark, sf):
    p = _t(spark, sf, "part")
    text = F.replace(F.get(F.array(*[F.lit(a) for a, _ in _TYPES]), (F.col("p_partkey") % len(_TYPES)).cast("int")), F.lit("{}"), F.col("p_size").cast("string"))
    plain = F.replace(F.get(F.array(*[F.lit(b) for _, b in _TYPES]), (F.col("p_partkey") % len(_TYPES)).cast("int")), F.lit("{}"), F.col("p_size").cast("string"))
    return with_sorts(p.select("p_partkey", plain.alias("s"), text.alias("text")), "text", "sort").drop("text")
