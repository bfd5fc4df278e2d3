"""Linking, validity, mapping and JSON queries over the test tables, registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import mappings as M
from claimloom.operators import linking, versions
from claimloom.plans.catalogue import _SEQ, _checkpoints, _t, query, sequences

# --- linking ---


@query("callsite_terms", """WITH t AS (SELECT p_partkey AS claim, unnest(string_split(p_name, ' ')) AS symbol, unnest(range(len(string_split(p_name, ' ')))) AS pos FROM part),
    b AS (SELECT string_split(p_name, ' ')[1] AS symbol, min(p_partkey) AS target_cid FROM part WHERE p_size > 25 GROUP BY 1)
    SELECT claim, pos, symbol, target_cid, target_cid IS NOT NULL AS resolved FROM t LEFT JOIN b USING (symbol)""")
def callsite_terms(spark, sf):
    p = _t(spark, sf, "part")
    words = F.split("p_name", " ")
    bridges = p.filter("p_size > 25").groupBy(F.get(words, F.lit(0)).alias("source_symbol")).agg(F.min("p_partkey").alias("target_cid"))
    return linking.callsites(p.select(F.col("p_partkey").alias("claim"), words.alias("nodes")), bridges)


@query("own_callsites", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1")
def own_callsites(spark, sf):
    owned = _t(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return linking.own_callsites(_t(spark, sf, "lineitem"), owned, ["l_orderkey"], F.col("l_returnflag") == "R").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("endpoint_compose", "SELECT c_custkey AS a_id, c_nationkey AS domain, c_custkey % 7 AS to, s_suppkey AS b_id FROM customer JOIN supplier ON s_nationkey = c_nationkey AND (c_custkey % 7 = s_suppkey % 7 OR c_custkey % 7 = s_suppkey % 5)")
def endpoint_compose(spark, sf):
    a = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("domain"), (F.col("c_custkey") % 7).alias("to"))
    b = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("domain"), F.array(F.col("s_suppkey") % 7, F.col("s_suppkey") % 5).alias("from"))
    return linking.compose_endpoints(a, b)


@query("manifest_group", "SELECT DISTINCT o_custkey AS cid FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderkey % 50 = 0")
def manifest_group(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("cid"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderpriority")).alias("group"))
    return linking.manifest_group(o, "1-URGENT")


@query("signature_mismatches", "SELECT l_partkey AS name, count(*) AS calls FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity::INTEGER <> p_size GROUP BY 1")
def signature_mismatches(spark, sf):
    calls = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_quantity").cast("int").alias("signature"))
    return linking.signature_mismatches(calls, _t(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("signature"))).groupBy("name").agg(F.count("*").alias("calls"))


@query("orphan_transition", "SELECT p_partkey FROM part WHERE p_size > 5 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < '1998-01-01') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= '2001-06-01')")
def orphan_transition(spark, sf):
    uses = _t(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return linking.orphaned(_t(spark, sf, "part").filter("p_size > 5").select("p_partkey"), uses.filter("l_shipdate < '1998-01-01'"), uses.filter("l_shipdate >= '2001-06-01'"), "p_partkey")


@query("demand_gaps", """WITH d AS (SELECT o_custkey AS owner, o_orderstatus AS parameter, count(DISTINCT o_orderpriority) AS sorts, min(o_orderpriority) AS s FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1, 2)
    SELECT c_custkey AS owner, 'P' AS parameter, '5-LOW' AS sort, CASE WHEN c_custkey NOT IN (SELECT owner FROM d) THEN 'NoOwner' WHEN sorts IS NULL THEN 'NoParameter' WHEN sorts > 1 THEN 'Ambiguous' WHEN s <> '5-LOW' THEN 'SortMismatch' ELSE 'met' END AS gap
    FROM customer LEFT JOIN d ON d.owner = c_custkey AND parameter = 'P'""")
def demand_gaps(spark, sf):
    declared = _t(spark, sf, "orders").filter("o_orderpriority <> '4-NOT SPECIFIED'").select(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("parameter"), F.col("o_orderpriority").alias("sort"))
    return linking.demand_gaps(_t(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), F.lit("P").alias("parameter"), F.lit("5-LOW").alias("sort")), declared)


@query("pool_union", "SELECT cid, count(DISTINCT p) AS pools FROM (SELECT l_partkey AS cid, 0 AS p FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, 1 FROM lineitem WHERE l_discount > 0.08 UNION ALL SELECT p_partkey, 2 FROM part WHERE p_size = 7) GROUP BY 1")
def pool_union(spark, sf):
    l = _t(spark, sf, "lineitem").withColumnRenamed("l_partkey", "cid")
    return linking.union_by_cid(l.filter("l_returnflag = 'R'"), l.filter("l_discount > 0.08"), _t(spark, sf, "part").filter("p_size = 7").select(F.col("p_partkey").alias("cid")))


@query("order_discrimination", """WITH r AS (SELECT user_id, event_id % 2 AS run, sha256(string_agg(event_type, ',' ORDER BY ts, event_id)) AS h FROM events GROUP BY 1, 2)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.h IS NULL THEN 'only-b' WHEN b.h IS NULL THEN 'only-a' WHEN a.h = b.h THEN 'same' ELSE 'differs' END AS state FROM (FROM r WHERE run = 0) a FULL JOIN (FROM r WHERE run = 1) b ON a.user_id = b.user_id""")
def order_discrimination(spark, sf):
    run = lambda r: linking.run_identity(_t(spark, sf, "events").filter(f"event_id % 2 = {r}"), ["user_id"], ["ts", "event_id"], "event_type")
    return linking.same_order(run(0), run(1), ["user_id"])


@query("floor_summary", """SELECT p_brand, count(*) FILTER (p_size <= 20) AS completed, count(*) FILTER (p_size > 20 AND p_size <= 40) AS missing, count(*) FILTER (p_size > 40) AS error,
    sha256(array_to_string(list_sort(list(DISTINCT p_name)), chr(10))) AS corpus FROM part GROUP BY 1""")
def floor_summary(spark, sf):
    state = F.when(F.col("p_size") <= 20, "completed").when(F.col("p_size") <= 40, "missing").otherwise("error")
    return linking.floor_summary(_t(spark, sf, "part").select("p_brand", state.alias("state"), F.col("p_name").alias("path")), ["p_brand"])


@query("axis_tally", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS owners FROM (SELECT DISTINCT event_type, user_id, json_extract_string(props, '$.k') AS k FROM events) GROUP BY 1")
def axis_tally(spark, sf):
    return linking.axis_tally(_t(spark, sf, "events").select("event_type", F.col("user_id").alias("owner"), F.get_json_object("props", "$.k").alias("occurrence")), "event_type")


@query("verification_lookup", """WITH m AS (SELECT l_partkey AS b, l_suppkey AS p, min(l_linestatus) AS v, count(DISTINCT l_linestatus) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2), w AS (SELECT DISTINCT l_partkey AS b, l_suppkey AS p FROM lineitem)
    SELECT w.b AS binding_hash, w.p AS property_hash, v AS verdict, CASE WHEN n IS NULL THEN 'producer' WHEN n > 1 THEN 'disagreement' ELSE 'held' END AS route FROM w LEFT JOIN m ON w.b = m.b AND w.p = m.p""")
def verification_lookup(spark, sf):
    l = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("binding_hash"), F.col("l_suppkey").alias("property_hash"), F.col("l_linestatus").alias("verdict"), "l_quantity")
    return linking.verification_lookup(l.select("binding_hash", "property_hash").distinct(), l.filter("l_quantity > 10"))


@query("function_compose", """WITH g AS (SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), ',') AS c, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) FILTER (l_quantity >= 45) AS refused_by,
      list(DISTINCT l_returnflag) AS x, list(DISTINCT l_linestatus) AS y FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN refused_by IS NULL THEN c END AS chain, refused_by, array_to_string(list_sort(list_distinct(x || y)), ',') AS effects FROM g""")
def function_compose(spark, sf):
    atoms = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("cid"), (F.col("l_quantity") < 45).alias("pure"), F.array("l_returnflag", "l_linestatus").alias("effects"))
    out = linking.compose_functions(atoms, ["l_orderkey"])
    return out.withColumns({"chain": F.array_join(F.col("chain").cast("array<string>"), ","), "effects": F.array_join("effects", ",")})


@query("range_loss_path", """WITH e AS (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 'saturating' WHEN 2 THEN 'wrapping' WHEN 3 THEN 'narrowing' WHEN 4 THEN 'widening' ELSE 'none' END AS l FROM lineitem)
    SELECT l_orderkey, CASE WHEN bool_or(l = 'saturating') AND bool_or(l = 'wrapping') THEN 'compound:saturating+wrapping' WHEN bool_or(l = 'wrapping') THEN 'wrapping' WHEN bool_or(l = 'saturating') THEN 'saturating'
      WHEN bool_or(l = 'narrowing') THEN 'narrowing' WHEN bool_or(l = 'widening') THEN 'widening' ELSE 'none' END AS loss FROM e GROUP BY 1""")
def range_loss_path(spark, sf):
    label = F.when(F.col("l_linenumber") == 1, "saturating").when(F.col("l_linenumber") == 2, "wrapping").when(F.col("l_linenumber") == 3, "narrowing").when(F.col("l_linenumber") == 4, "widening").otherwise("none")
    return linking.compose_range_loss(_t(spark, sf, "lineitem").select("l_orderkey", label.alias("loss")), ["l_orderkey"])


_YANKS = "SELECT o_custkey AS set_cid, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment ELSE 'SECURITY' END AS signer FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 37 = 0"


@query("yank_policies", f"""WITH y AS ({_YANKS}) SELECT 'strict' AS policy, c_custkey AS set_cid, false AS warned FROM customer WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.set_cid = c_custkey AND y.signer = c_mktsegment)
    UNION ALL SELECT 'audit', c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT set_cid FROM y WHERE signer = 'SECURITY')
    UNION ALL SELECT 'permissive', c_custkey, c_custkey IN (SELECT set_cid FROM y) FROM customer""")
def yank_policies(spark, sf):
    rel = _t(spark, sf, "customer").select(F.col("c_custkey").alias("set_cid"), F.col("c_mktsegment").alias("signer"))
    o = _t(spark, sf, "orders").filter("o_orderkey % 37 = 0").join(rel, F.col("o_custkey") == F.col("set_cid"))
    yanks = o.select("set_cid", F.when(F.col("o_orderkey") % 2 == 0, F.col("signer")).otherwise("SECURITY").alias("signer"))
    one = lambda p: linking.apply_yanks(rel, yanks, p, ["SECURITY"]).select(F.lit(p).alias("policy"), "set_cid", "warned")
    return one("strict").union(one("audit")).union(one("permissive"))


@query("patch_walk", """WITH RECURSIVE w AS (SELECT c_custkey, 0 AS step FROM customer WHERE c_custkey = 1 UNION ALL SELECT c.c_custkey, step + 1 FROM w JOIN customer c ON c.c_custkey // 3 = w.c_custkey AND c.c_custkey > 0
    WHERE c.c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey = 1) OR c.c_custkey < 30) SELECT c_custkey::VARCHAR AS set_cid, step FROM w""")
def patch_walk(spark, sf):
    _checkpoints(spark)
    c = _t(spark, sf, "customer").filter("c_custkey > 0")
    same = c.filter("c_custkey = 1").select("c_mktsegment")
    c = c.filter((F.col("c_mktsegment") == same.scalar()) | (F.col("c_custkey") < 30))
    rel = c.select(F.col("c_custkey").cast("string").alias("set_cid"), F.expr("cast(c_custkey div 3 as string)").alias("previous_set_cid"), F.lit("a").alias("signer"), F.lit("main").alias("channel"), F.lit(0).alias("declared_at"))
    return versions.version_walk(rel, "1", ["a"], "main").select("set_cid", "step")


@query("estimated_costs", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_partkey % 4 <> 0),
    b AS (SELECT *, i * 4 // n AS band FROM k), c AS (SELECT *, row_number() OVER (PARTITION BY p_brand, band ORDER BY p_retailprice, p_partkey) - 1 AS j, count(*) OVER (PARTITION BY p_brand, band) AS m FROM b),
    d AS (SELECT p_brand, band, max(p_size) AS hi, max(CASE WHEN j = m // 2 THEN p_retailprice END) AS med FROM c GROUP BY 1, 2), f AS (SELECT p_brand, quantile_disc(p_retailprice, 0.75) AS fl FROM k GROUP BY 1)
    SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice ELSE greatest(fl, coalesce((SELECT arg_min(med, hi * 10000000 + med) FROM d WHERE d.p_brand = p.p_brand AND hi >= p_size), fl)) END AS estimate FROM part p LEFT JOIN f ON f.p_brand = p.p_brand""")
def estimated_costs(spark, sf):
    p = _t(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("path"), F.col("p_size").alias("size_bytes"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("cost_s"))
    return linking.estimate_costs(p, ["p_brand"]).select(F.col("path").alias("p_partkey"), "estimate")


@query("fail_closed", """WITH RECURSIVE d AS (SELECT s_suppkey AS cid, CASE s_suppkey % 10 WHEN 3 THEN s_suppkey + 1 WHEN 4 THEN s_suppkey - 1 ELSE s_suppkey // 2 END AS on_ FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 5 <> 1),
    r AS (SELECT cid, on_ FROM d UNION SELECT r.cid, d.on_ FROM r JOIN d ON r.on_ = d.cid),
    e AS (SELECT s_suppkey % 3 AS catalog, s_nationkey AS name, CASE WHEN s_suppkey % 17 = 0 THEN s_suppkey + 1000000 WHEN s_nationkey < 12 THEN s_nationkey::BIGINT ELSE s_suppkey END AS cid FROM supplier),
    f AS (SELECT cid AS s, 'declaration_missing' AS reason FROM e WHERE cid NOT IN (SELECT s_suppkey FROM supplier) UNION SELECT s_suppkey, 'invalid_signature' FROM supplier WHERE s_suppkey % 41 = 11
      UNION SELECT s_suppkey, 'signer_key_revoked' FROM supplier WHERE s_acctbal < 300 UNION SELECT s_suppkey, 'compiler_incompatible' FROM supplier WHERE s_suppkey % 43 = 12 UNION SELECT cid, 'cyclic_dependency' FROM r WHERE cid = on_)
    SELECT DISTINCT s::VARCHAR AS subject, reason FROM (SELECT * FROM f UNION SELECT cid, 'dependency_unresolvable' FROM r WHERE on_ IN (SELECT s FROM f) UNION SELECT n_nationkey + k, 'no_resolution' FROM nation, (SELECT unnest([0, 3]) AS k) WHERE n_nationkey + k NOT IN (SELECT name FROM e)
      UNION SELECT name, 'name_collision' FROM e GROUP BY name HAVING count(DISTINCT cid) > 1 AND count(DISTINCT catalog) > 1)""")
def fail_closed(spark, sf):
    _checkpoints(spark)
    s, k = _t(spark, sf, "supplier"), F.col("s_suppkey")
    on = F.when(k % 10 == 3, k + 1).when(k % 10 == 4, k - 1).otherwise(F.expr("s_suppkey div 2"))
    cid = F.when(k % 17 == 0, k + 1_000_000).when(F.col("s_nationkey") < 12, F.col("s_nationkey").cast("long")).otherwise(k)
    names = _t(spark, sf, "nation").select(F.explode(F.array(F.col("n_nationkey"), F.col("n_nationkey") + 3)).alias("name"))
    return linking.fail_closed(
        names,
        s.select((k % 3).alias("catalog"), F.col("s_nationkey").alias("name"), cid.alias("cid")),
        s.select(k.alias("cid"), (k % 41 != 11).alias("signed"), (F.col("s_acctbal") < 300).alias("revoked"), (k % 43 != 12).alias("compatible")),
        s.filter((k > 0) & (k % 5 != 1)).select(k.alias("cid"), on.alias("on")),
    )


@query("enclosure", """WITH RECURSIVE r AS (SELECT s_suppkey AS inner, s_suppkey // 2 AS outer FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT r.inner, r.outer // 2 FROM r WHERE r.outer > 0) SELECT inner, outer FROM r""".replace("inner", '"inner"').replace("outer", '"outer"'))
def enclosure(spark, sf):
    from claimloom.operators.claims import closure

    _checkpoints(spark)
    return closure(_t(spark, sf, "supplier").filter("s_suppkey > 0").select(F.col("s_suppkey").alias("inner"), F.expr("s_suppkey div 2").alias("outer")), "inner", "outer")


# --- sequences: constraints, early failure, decomposition, membership ---


def _on_sequences(name, column, sql):
    @query(f"seq_{name}", _SEQ + f"SELECT user_id, {sql} AS r FROM s")
    def run(spark, sf):
        return sequences(spark, sf).select("user_id", column().alias("r"))


_PARTS = "list_distinct(a)", "list_distinct(list_transform(a, lambda x: x + 1))"


def _parts():
    return F.array_distinct("a"), F.array_distinct(F.transform("a", lambda x: x + 1))


_on_sequences("constraints_sequential", lambda: F.array_join(linking.sequential(*_parts()), ","), f"array_to_string(list_sort(list_distinct({_PARTS[0]} || {_PARTS[1]})), ',')")
_on_sequences("constraints_branched", lambda: F.array_join(linking.branched(*_parts()), ","), f"coalesce(array_to_string(list_sort(list_intersect({_PARTS[0]}, {_PARTS[1]})), ','), '')")
_on_sequences("constraints_top", lambda: F.when(linking.branched(_parts()[0], F.when(F.size("a") % 2 == 0, _parts()[1])).isNull(), "top").otherwise("known"), "CASE WHEN len(a) % 2 = 1 THEN 'top' ELSE 'known' END")
_on_sequences("try_map", lambda: M.outcome_text(M.try_map(F.col("a"), lambda x: F.when(x >= 7, x - 7))), "CASE WHEN list_min(a) < 7 THEN 'err:' || (list_position(list_transform(a, lambda x: x < 7), true) - 1) ELSE 'ok:' || array_to_string(list_transform(a, lambda x: x - 7), ',') END")
_on_sequences("try_from_fn", lambda: M.outcome_text(M.try_from_fn(4, lambda i: F.get("a", i * 20))), "CASE WHEN len(a) <= 60 THEN 'err:' || CASE WHEN len(a) <= 20 THEN 1 WHEN len(a) <= 40 THEN 2 ELSE 3 END ELSE 'ok:' || a[1] || ',' || a[21] || ',' || a[41] || ',' || a[61] END")
_on_sequences("transpose", lambda: M.transpose(F.get("a", F.lit(70)).isNotNull(), F.get("a", F.lit(70)) % 2 == 0, F.get("a", F.lit(70))), "CASE WHEN len(a) <= 70 THEN 'ok:none' WHEN a[71] % 2 = 0 THEN 'ok:some:' || a[71] ELSE 'err:' || a[71] END")
_on_sequences("membership", lambda: M.membership(F.transform("a", lambda x: F.when(x >= 5, x)), F.lit(20)), "CASE WHEN list_contains(a, 20) THEN 'in' WHEN list_min(a) < 5 THEN 'undecided' ELSE 'out' END")
_on_sequences("char_range", lambda: M.char_range(F.lit(0xD7F0), F.lit(0xD7F0) + F.get("a", F.lit(0)) % 30 + 0x800), "array_to_string(list_transform(list_filter(range(55280, 55280 + a[1] % 30 + 2048), lambda c: c < 55296 OR c > 57343), lambda c: chr(c::INTEGER)), '')")


@query("seq_equality_facts", _SEQ + "SELECT user_id, -1 AS pos, (len(a) = len(a[4:])) AS holds FROM s UNION ALL SELECT user_id, unnest(range(0, greatest(len(a) - 3, 0)))::INTEGER, unnest(list_transform(range(1, greatest(len(a) - 3, 0) + 1), lambda i: a[i] = a[i + 3])) FROM s")
def seq_equality_facts(spark, sf):
    return sequences(spark, sf).select("user_id", F.inline(M.equality_facts(F.col("a"), F.slice("a", F.lit(4), F.size("a")))))


# --- mappings and JSON ---

_MAPS = "WITH c AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 250) AS h FROM events GROUP BY 1, 2) "


def _maps(spark, sf):
    c = _t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 250).alias("h"))
    pairs = lambda v, ok: F.map_from_entries(F.array_compact(F.collect_list(F.when(ok, F.struct("event_type", v)))))
    return c.groupBy("user_id").agg(pairs("n", F.lit(True)).alias("d"), pairs("h", F.col("event_type") != "click").alias("e"))


def _on_maps(name, column, key, value, where="true"):
    @query(f"map_{name}", _MAPS + f"SELECT user_id, string_agg({key} || '=' || ({value}), ',' ORDER BY {key}) FILTER ({where}) AS r FROM c GROUP BY 1")
    def run(spark, sf):
        return _maps(spark, sf).select("user_id", F.nullif(M.map_text(column()), F.lit("")).alias("r"))


_on_maps("merge", lambda: M.merge("d", "e"), "event_type", "CASE WHEN event_type <> 'click' THEN h ELSE n END")
_on_maps("set_default", lambda: M.set_default("e", F.lit("click"), F.lit(-1).cast("long")), "event_type", "CASE WHEN event_type <> 'click' THEN h ELSE -1 END")
_on_maps("pop", lambda: M.pop("d", F.lit("click"))["rest"], "event_type", "n", "event_type <> 'click'")
_on_maps("extract_values", lambda: F.map_filter("d", lambda k, v: v % 2 == 0), "event_type", "n", "n % 2 = 0")


@query("json_scalars", "SELECT event_id, json_valid(props) AS valid, json_extract_string(props, '$.k')::BIGINT AS k, len(json_keys(props))::INTEGER AS keys, json_extract_string(props, '$.none') IS NULL AS missing FROM events")
def json_scalars(spark, sf):
    e, p = _t(spark, sf, "events"), F.col("props")
    return e.select("event_id", M.json_valid(p).alias("valid"), F.get_json_object(p, "$.k").cast("long").alias("k"), F.size(F.json_object_keys(p)).alias("keys"), F.get_json_object(p, "$.none").isNull().alias("missing"))


@query("json_each", "WITH j AS (SELECT o_orderkey, '[' || o_custkey || ',\"' || o_orderstatus || '\",null]' AS t FROM orders) SELECT o_orderkey, json_array_length(t)::INTEGER AS n, json_extract_string(t, '$[0]') AS first, json_extract_string(t, '$[1]') AS second, json_type(t) = 'ARRAY' AS is_array FROM j")
def json_each(spark, sf):
    t = F.concat(F.lit("["), F.col("o_custkey"), F.lit(',"'), F.col("o_orderstatus"), F.lit('",null]'))
    return _t(spark, sf, "orders").select("o_orderkey", F.json_array_length(t).alias("n"), F.get_json_object(t, "$[0]").alias("first"), F.get_json_object(t, "$[1]").alias("second"), (M.json_type(t) == "array").alias("is_array"))
