"""Queries of linking, provenance, pool and predicate-layer records, registered with those of the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimloom.functions import canonical
from claimloom.functions.registry import Operator, Registry
from claimloom.operators import claims, determinism, linking, predicates, versions
from claimloom.plans.catalogue import _VERDICT, _checkpoints, _t, _verdicts, query
from claimloom.sources import pool
from claimloom.streaming.upsert import tumbling, upsert, upserted

# --- linking ---


@query("forward_pin_gate", """WITH m AS (SELECT p_partkey % 10 AS b, p_partkey AS c FROM part WHERE p_size > 10 AND p_partkey % 10 < 8)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 11 = 10 THEN NULL WHEN l_suppkey % 11 NOT IN (SELECT b FROM m) THEN 'PinnedBundleMissing' WHEN NOT EXISTS (SELECT 1 FROM m WHERE b = l_suppkey % 11 AND c = l_partkey) THEN 'NotInPinnedBundle' END AS reason FROM lineitem""")
def forward_pin_gate(spark, sf):
    l = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("target_cid"), F.expr("nullif(l_suppkey % 11, 10)").alias("bundle"))
    m = _t(spark, sf, "part").filter("p_size > 10 and p_partkey % 10 < 8").select((F.col("p_partkey") % 10).alias("bundle"), F.col("p_partkey").alias("cid"))
    return linking.pin_gate(l, m).select("l_orderkey", "l_linenumber", F.col("target_cid").alias("l_partkey"), "l_suppkey", "reason")


@query("region_substitution", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'static' ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN 'r1' ELSE o_orderstatus END AS b, 'r9' AS c FROM orders""")
def region_substitution(spark, sf):
    k = F.col("o_orderkey")
    formals = F.array(F.lit("r0"), F.when(k % 2 == 0, "r1").when(k % 3 != 0, "r0"), F.lit("r2"))
    actuals = F.array(F.when(k % 3 == 0, "static").otherwise(F.col("o_orderstatus")), F.when(k % 2 == 0, F.col("o_orderpriority")).when(k % 3 != 0, F.col("o_orderstatus")))
    s = linking.region_substitution(formals, actuals)
    second = F.when((k % 2 == 0) | (k % 3 == 0), "r1").otherwise("r0")
    return _t(spark, sf, "orders").select("o_orderkey", *[linking.substituted(s, r).alias(n) for n, r in (("a", F.lit("r0")), ("b", second), ("c", F.lit("r9")))])


@query("parameter_gaps", """WITH c AS (SELECT o_orderkey, o_custkey AS owner, o_orderkey % 4 AS coordinate FROM orders), u AS (SELECT c_custkey AS owner, c_acctbal > 0 AS closed, c_nationkey % 2 = 0 AS external FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 'StaleCandidateOrDemand' WHEN n.n_nationkey IS NULL OR n.n_nationkey = 7 THEN 'MissingFormalOwnershipTestimony' WHEN n.n_nationkey = 3 THEN 'StaleContract' WHEN coordinate = 3 THEN 'FormalCoordinateMismatch' WHEN n.n_nationkey = 4 AND coordinate = 1 THEN 'StaleFormalCoordinate'
      WHEN o_orderkey % 31 = 0 THEN 'FormalOrdinalMismatch' WHEN o_orderkey % 37 = 0 THEN 'FormalSortMismatch' WHEN o_orderkey % 2 = 0 AND u.owner IS NULL THEN 'StaleResolution' WHEN o_orderkey % 5 = 0 THEN 'declared-demand' WHEN coalesce(NOT closed OR external, true) THEN 'OpenCallerUniverse' ELSE 'NoIncomingCaller' END AS resolution
    FROM c LEFT JOIN customer k ON k.c_custkey = c.owner LEFT JOIN nation n ON n.n_nationkey = k.c_nationkey LEFT JOIN u ON u.owner = c.owner""")
def parameter_gaps(spark, sf):
    k, c = F.col("o_orderkey"), _t(spark, sf, "customer")
    cand = _t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"), (k % 4).alias("coordinate"), F.when(k % 31 == 0, -1).otherwise(k % 4).alias("ordinal"), F.when(k % 37 == 0, "Bool").otherwise("Int").alias("sort"), k.alias("demand"), (k % 29 != 0).alias("fresh"), F.when(k % 2 == 0, "closed-callers").otherwise("declared-demand").alias("basis"))
    at = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    formals = c.filter("c_nationkey <> 7").select(F.col("c_custkey").alias("owner"), "c_nationkey", at.alias("coordinate")).select("owner", F.col("coordinate").cast("long").alias("coordinate"), F.col("coordinate").alias("ordinal"), F.lit("Int").alias("sort"), (~((F.col("c_nationkey") == 4) & (F.col("coordinate") == 1))).alias("fresh"), (F.col("c_nationkey") != 3).alias("contract_fresh"))
    declared = _t(spark, sf, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("owner"), k.alias("demand"))
    universes = c.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("owner"), (F.col("c_acctbal") > 0).alias("closed"), (F.col("c_nationkey") % 2 == 0).alias("external"))
    return linking.discharge_parameters(cand, formals, declared, universes).select("o_orderkey", "resolution")


@query("link_failed_reports", f"""WITH v AS (SELECT l_partkey, {_VERDICT} AS verdict FROM lineitem), r AS (SELECT l_partkey, count(*) AS rows, CASE WHEN count(*) FILTER (verdict = 'Unsatisfied') > 0 THEN 1 WHEN count(*) FILTER (verdict = 'Discharged') < count(*) THEN 3 ELSE 0 END AS code FROM v GROUP BY 1)
    SELECT l_partkey, rows, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) THEN 4 ELSE code END AS exit_code FROM r""")
def link_failed_reports(spark, sf):
    errors = _t(spark, sf, "part").filter("p_size < 20").select(F.col("p_partkey").alias("l_partkey"))
    return claims.with_link_surface(claims.classify_reports(_verdicts(spark, sf), ["l_partkey"]), errors, ["l_partkey"]).select("l_partkey", "rows", "exit_code")


@query("attribute_safety", """WITH s AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS r, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'k' || user_id % 4 END AS a, value > 400 AS g FROM events)
    SELECT event_id, CASE WHEN r IS NULL THEN 'unproven:unknown-receiver' WHEN a = '' THEN 'unproven:empty-attribute' WHEN g THEN 'discharged:guard' WHEN r = 'click' THEN 'unproven:no-shape' WHEN a IN ('k0', 'k1') THEN 'discharged:shape' ELSE 'unproven:not-guaranteed' END AS how FROM s""")
def attribute_safety(spark, sf):
    e = _t(spark, sf, "events")
    sites = e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("receiver"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("k"), F.col("user_id") % 4)).alias("attribute"), (F.col("value") > 400).alias("guarded"))
    shapes = e.filter("event_type <> 'click'").select(F.col("event_type").alias("receiver"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).distinct().select("receiver", F.concat(F.lit("k"), "i").alias("attribute"), (F.col("i") < 2).alias("guaranteed"))
    return linking.attribute_safety(sites, shapes).select("event_id", "how")


@query("effect_verdicts", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Undecidable' WHEN 'login' THEN 'SolverTimeout' WHEN 'purchase' THEN 'Refused' ELSE 'Undecidable' END AS verdict, CASE event_type WHEN 'click' THEN 'no sound discharger' WHEN 'login' THEN 'solver timeout' WHEN 'purchase' THEN 'wrong answer' ELSE 'unknown effect ' || event_type END AS reason FROM events")
def effect_verdicts(spark, sf):
    table = spark.createDataFrame([("click", "Undecidable", "no sound discharger"), ("login", "SolverTimeout", "solver timeout"), ("purchase", "Refused", "wrong answer")], "kind string, verdict string, reason string")
    return linking.effect_verdicts(_t(spark, sf, "events").select("event_id", F.col("event_type").alias("kind")), table).select("event_id", "verdict", "reason")


@query("method_chains", """WITH r AS (SELECT string_split(p_name, ' ')[1] AS name, 'c' || min(p_partkey) AS cid FROM part WHERE p_size > 12 GROUP BY 1), s AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS name, unnest(range(len(string_split(p_name, ' ')))) AS pos FROM part),
    g AS (SELECT p_partkey, count(*) AS n, count(cid) AS k, string_agg(cid, '>' ORDER BY pos) AS t FROM s LEFT JOIN r USING (name) GROUP BY 1) SELECT p_partkey AS id, CASE WHEN n >= 2 AND n = k THEN sha256(t) END AS composed FROM g""")
def method_chains(spark, sf):
    p, words = _t(spark, sf, "part"), F.split("p_name", " ")
    registry = p.filter("p_size > 12").groupBy(F.get(words, F.lit(0)).alias("name")).agg(F.concat(F.lit("c"), F.min("p_partkey")).alias("cid"))
    return linking.compose_chains(p.select(F.col("p_partkey").alias("id"), words.alias("methods")), registry)


@query("claim_errors", """WITH c AS (SELECT c_custkey AS id, c_nationkey + 3 AS scope, c_mktsegment AS s, CASE WHEN c_acctbal > 0 THEN c_name END AS p FROM customer)
    SELECT id, 'UnknownScope' AS error FROM c WHERE scope NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT id, 'UnknownSort' FROM c WHERE s NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT id, 'NoProvenance' FROM c WHERE p IS NULL""")
def claim_errors(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 3).alias("scope"), F.col("c_mktsegment").alias("sort"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("provenance"))
    return linking.claim_errors(c, _t(spark, sf, "nation").select(F.col("n_nationkey").alias("scope")), ["BUILDING", "MACHINERY"])


@query("binding_entries", "SELECT o_orderstatus, o_orderpriority, count(*) AS stated, sha256(o_orderstatus || chr(31) || o_orderpriority) AS entry_cid FROM orders GROUP BY 1, 2")
def binding_entries(spark, sf):
    return linking.bindings(_t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("utterances", """WITH f AS (SELECT DISTINCT 'p' || l_partkey AS s, l_returnflag AS who FROM lineitem WHERE l_quantity > 45), r AS (SELECT 'p' || p_partkey AS s, 'p' || (p_partkey // 2) AS o, p_brand AS who FROM part)
    SELECT DISTINCT r.o AS subject, r.who AS rule_by, f.who AS fact_by FROM f JOIN r USING (s) WHERE r.o NOT IN (SELECT s FROM f)""")
def utterances(spark, sf):
    name = lambda c: F.concat(F.lit("p"), c)
    facts = _t(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_returnflag").alias("speaker"), name("l_partkey").alias("subject"))
    rules = _t(spark, sf, "part").select(F.col("p_brand").alias("speaker"), name("p_partkey").alias("subject"), name(F.expr("p_partkey div 2")).alias("object"))
    return linking.solved(linking.spoken(facts, _t(spark, sf, "region").select(F.lit("all").alias("speaker"), F.col("r_name").alias("subject")), rules))


@query("link_facade", """WITH r AS (SELECT l_orderkey, l_quantity < 40 AS ok, list_sort(list_distinct([l_returnflag, l_linestatus, l_suppkey::VARCHAR])) AS c FROM lineitem), g AS (SELECT l_orderkey, bool_and(ok) AS made, list(c) AS e FROM r GROUP BY 1),
    s AS (SELECT *, list_sort(list_filter(list_distinct(flatten(e)), lambda x: len(list_filter(e, lambda y: list_contains(y, x))) = len(e))) AS h FROM g)
    SELECT l_orderkey, CASE WHEN made THEN 'composed' WHEN len(h) > 0 THEN 'shared' ELSE 'refused' END AS link, CASE WHEN NOT made THEN h[1] END AS contract FROM s""")
def link_facade(spark, sf):
    l = _t(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") < 40, F.col("l_partkey")).alias("composed"), F.array("l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string")).alias("contracts"))
    return linking.link_or_share(l, ["l_orderkey"])


@query("solver_verdicts", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 5 = 0 THEN 'Undecidable' WHEN l_orderkey > l_partkey THEN 'Discharged' WHEN l_partkey <= l_suppkey * 3 THEN 'Discharged' ELSE 'Unsatisfied' END AS verdict FROM lineitem")
def solver_verdicts(spark, sf):
    l = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_orderkey").alias("lo"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_partkey")).alias("hi"), (F.col("l_suppkey") * 3).alias("bound"))
    return linking.decided(l, linking.interval_solver).drop("lo", "hi", "bound")


def operators() -> Registry:
    """A small roster: constants, a column, addition, and doubling before addition."""
    r = Registry()
    r.add(Operator("const", lambda n: n["kind"] == "const", lambda n, f: F.lit(n["value"]), good="1 = 1", bad="1 = 2", tree={"kind": "const", "value": 7}, equal="3 + 4", unequal="8"))
    r.add(Operator("var", lambda n: n["kind"] == "var", lambda n, f: F.col(n["name"]), good="x = x", bad="x = x + 1", tree={"kind": "var", "name": "x"}, equal="x", unequal="x + 1"))
    r.add(Operator("sum", lambda n: n["kind"] == "add", lambda n, f: f(n["args"][0]) + f(n["args"][1]), good="1 + 2 = 3", bad="1 + 2 = 4", tree={"kind": "add", "args": [{"kind": "var", "name": "x"}, {"kind": "const", "value": 2}]}, equal="2 + x", unequal="x * 2 + 3"))
    r.add(Operator("twice", lambda n: n["kind"] == "add" and n["args"][0] == n["args"][1], lambda n, f: f(n["args"][0]) * 2, before=("sum",), good="2 + 2 = 4", bad="2 + 2 = 5", tree={"kind": "add", "args": [{"kind": "var", "name": "x"}] * 2}, equal="x + x", unequal="2 * x + 1"))
    return r


@query("registry_build", "SELECT o_orderkey, o_orderkey * 2 + 7 + o_custkey AS value, 'twice' AS first FROM orders")
def registry_build(spark, sf):
    var = lambda x: {"kind": "var", "name": x}
    add = lambda a, b: {"kind": "add", "args": [a, b]}
    r = operators()
    first = next(name for name, _, _ in r.roster() if name in ("sum", "twice"))
    return _t(spark, sf, "orders").select("o_orderkey", r.build(add(add(add(var("o_orderkey"), var("o_orderkey")), {"kind": "const", "value": 7}), var("o_custkey"))).alias("value"), F.lit(first).alias("first"))


# --- pools ---


@query("canonical_bodies", """SELECT o_orderkey, '{"a":[' || o_custkey || ',null,true],"b":{"x":"' || o_orderstatus || '","y":"\\u0001"},"z":' || (o_orderkey::HUGEINT * 1000000000000000000000 + 1) || '}' AS body FROM orders""")
def canonical_bodies(spark, sf):
    text = F.concat(F.lit('{ "z" : '), F.when(F.col("o_orderkey") == 0, "1").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("000000000000000000001"))), F.lit(', "b": {"y": "\\u0001", "x": "'), F.col("o_orderstatus"), F.lit('"}, "a": ['), F.col("o_custkey"), F.lit(", null, true]}"))
    return _t(spark, sf, "orders").select("o_orderkey", canonical.canonical(text).alias("body"))


def _lines(spark, sf):
    o = _t(spark, sf, "orders")
    text = F.concat(F.lit('{"name": "'), F.col("o_orderpriority"), F.lit('", "x": '), F.col("o_custkey"), F.when(F.col("o_orderkey") % 10 == 0, "").otherwise("}"))
    return o.select(text.alias("value"), F.col("o_orderpriority").alias("name"))


@query("pool_members", "SELECT o_orderpriority AS name, count(*) FILTER (o_orderkey % 10 <> 0) AS good, count(*) FILTER (o_orderkey % 10 = 0) AS broken, count(DISTINCT CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END) AS ids FROM orders GROUP BY 1")
def pool_members(spark, sf):
    m = pool.members(_lines(spark, sf))
    return m.groupBy("name").agg(F.count("cid").alias("good"), F.count_if(F.col("cid").isNull()).alias("broken"), F.countDistinct("cid").alias("ids"))


def _folder(spark, name: str) -> str:
    _checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/claimloom/{name}-{uuid.uuid4().hex}"


@query("pool_sealed", "SELECT o_orderpriority AS name, count(DISTINCT o_custkey) AS members FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1")
def pool_sealed(spark, sf):
    path = _folder(spark, "pool")
    pool.seal(pool.members(_lines(spark, sf)), path)
    good, bad = pool.load(spark, path)
    return good.join(bad.select("cid"), "cid", "left_anti").groupBy("name").agg(F.count("*").alias("members"))


@query("pool_decoded", "SELECT o_orderstatus, count(*) FILTER (o_orderkey % 3 <> 0) AS decoded, count(*) FILTER (o_orderkey % 3 = 0) AS errors, max(o_custkey) FILTER (o_orderkey % 3 <> 0)::INTEGER AS line FROM orders GROUP BY 1")
def pool_decoded(spark, sf):
    text = F.concat(F.lit('{"file": "'), F.col("o_orderstatus"), F.lit('", "line": '), F.when(F.col("o_orderkey") % 3 == 0, F.lit('"x"')).otherwise(F.col("o_custkey").cast("string")), F.lit("}"))
    ok, bad = pool.decode(_t(spark, sf, "orders").select(text.alias("t")), "t", pool.LOCUS)
    errors = bad.groupBy(F.get_json_object("raw", "$.file").alias("o_orderstatus")).agg(F.count("*").alias("errors"))
    return ok.groupBy(F.col("file").alias("o_orderstatus")).agg(F.count("*").alias("decoded"), F.max("line").alias("line")).join(errors, "o_orderstatus").select("o_orderstatus", "decoded", "errors", "line")


@query("pool_enumeration", "SELECT l_returnflag, l_quantity <= 45 AS node, CASE WHEN l_quantity > 45 THEN 'TooMany' END AS reason, count(*) AS n FROM lineitem GROUP BY ALL")
def pool_enumeration(spark, sf):
    nodes, gaps = pool.enumerated(_t(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"], F.col("l_quantity") > 45, F.lit("TooMany"))
    one = nodes.select(F.col("payload.l_returnflag").alias("l_returnflag"), F.lit(True).alias("node"), F.lit(None).cast("string").alias("reason"))
    return one.union(gaps.select("memento.l_returnflag", F.lit(False), "reason")).groupBy("l_returnflag", "node", "reason").agg(F.count("*").alias("n"))


@query("pool_dump", """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ',"r":' || n_regionkey ELSE '' END || '}' AS line FROM nation""")
def pool_dump(spark, sf):
    return pool.dump(_t(spark, sf, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("r")))


@query("census_checkpoint", "SELECT event_type, count(*) AS n, CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS run FROM events GROUP BY 1")
def census_checkpoint(spark, sf):
    path, n = _folder(spark, "census"), _t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    for run, manifest, part in ((1, "m1", "true"), (9, "m2", "true"), (2, "m1", "event_type = 'click'")):
        pool.save_results(n.filter(part).withColumn("run", F.lit(run)), path, manifest, "event_type")
    return pool.saved_results(spark, path, "m1").select("event_type", "n", "run")


@query("term_table", """SELECT 'const' AS kind, count(DISTINCT v) AS terms FROM (SELECT o_custkey % 5 AS v FROM orders UNION ALL SELECT o_orderkey % 3 FROM orders) UNION ALL SELECT 'var', 1 UNION ALL SELECT 'ctor', 2 * count(*) FROM (SELECT DISTINCT o_custkey % 5, o_orderkey % 3 FROM orders)""")
def term_table(spark, sf):
    const = lambda c: F.concat(F.lit('{"kind":"const","value":'), c, F.lit("}"))
    inner = F.concat(F.lit('{"kind":"ctor","name":"+","args":['), const(F.col("o_custkey") % 5), F.lit(","), const(F.col("o_orderkey") % 3), F.lit("]}"))
    outer = F.concat(F.lit('{"args":['), inner, F.lit(',{"name":"x","kind":"var"}],"kind":"ctor","name":"="}'))
    terms = _t(spark, sf, "orders").select(F.explode(canonical.terms(outer)).alias("body")).withColumn("cid", canonical.cid(F.col("body"))).dropDuplicates(["cid"])
    return terms.groupBy(F.get_json_object("body", "$.kind").alias("kind")).agg(F.count("*").alias("terms"))


# --- streams ---


@query("stream_upsert", "SELECT p_brand, count(DISTINCT p_name) AS names FROM part WHERE p_size <> 7 GROUP BY 1")
def stream_upsert(spark, sf):
    path = _folder(spark, "upsert")
    part = _t(spark, sf, "part").select("p_brand", F.when(F.col("p_size") != 7, F.concat_ws("/", "p_brand", "p_name")).alias("cid"))
    part.write.parquet(f"{path}/in")
    for k in range(2):  # the second run brings nothing new
        upsert(spark.readStream.schema(part.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint{k}").awaitTermination()
    return upserted(spark, f"{path}/out").groupBy("p_brand").agg(F.count("*").alias("names"))


@query("tumbling_days", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_days(spark, sf):
    return tumbling(_t(spark, sf, "events")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


# --- predicate layer ---


@query("relation_violations", """SELECT 'check:has_body in (0, 1)' AS rule, p_name AS key, count(*) AS rows FROM part WHERE p_size % 3 = 2 GROUP BY 2 UNION ALL SELECT 'key:repeated', p_name, count(*) FROM part GROUP BY 2 HAVING count(*) > 1""")
def relation_violations(spark, sf):
    f = _t(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_size").alias("line"), (F.col("p_size") % 3).alias("has_body"))
    return predicates.violations(f, "functions")


_KEYS = "SELECT o_custkey, o_orderpriority || ':' || lpad((o_orderkey % 100)::VARCHAR, 9, '0') || ':' || o_orderstatus || ':' || 'f' AS k, o_orderkey FROM orders"
_IDS = "h AS (SELECT DISTINCT o_custkey, sha256(k) AS h FROM r), p AS (SELECT o_custkey, h[:2] AS part, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS p FROM h GROUP BY 1, 2), s AS (SELECT o_custkey, sum(n)::BIGINT AS rows, sha256(string_agg(p, '' ORDER BY part)) AS result_cid FROM p GROUP BY 1)"


def _result_sets(spark, sf, where="true"):
    rows = predicates.result_rows(_t(spark, sf, "orders").filter(where), F.col("o_orderpriority"), F.col("o_orderkey") % 100, F.col("o_orderstatus"), F.lit("f"), F.struct("o_custkey", "o_orderkey"))
    return predicates.set_id(rows.select("key", F.col("evidence.o_custkey").alias("o_custkey")), "key", ["o_custkey"])


@query("result_sets", f"WITH r AS ({_KEYS}), {_IDS} SELECT * FROM s")
def result_sets(spark, sf):
    return _result_sets(spark, sf)


@query("query_applications", f"""WITH r AS ({_KEYS}), {_IDS}, r2 AS ({_KEYS} WHERE o_orderkey % 3 <> 0), g AS (SELECT o_custkey, count(DISTINCT k) AS n FROM r2 GROUP BY 1)
    SELECT s.o_custkey, CASE WHEN g.n IS NULL THEN 'refused:no-result' WHEN s.o_custkey % 4 = 3 THEN 'refused:lifter' WHEN s.rows <> g.n THEN 'refused:count' ELSE 'held' END AS status FROM s LEFT JOIN g USING (o_custkey)""")
def query_applications(spark, sf):
    c = F.col("o_custkey") % 4
    stated = _result_sets(spark, sf).withColumn("lifter", F.when(c == 1, "l1").when(c == 3, "l9").otherwise("l2"))
    again = _result_sets(spark, sf, "o_orderkey % 3 <> 0").withColumn("lifter", F.lit("l2"))
    return predicates.applied(stated, again, ["o_custkey"], {"l1": "l2"})


_PRE, _POST = "l_shipdate < '1999-06-01'", "l_shipdate >= '2001-01-01'"


@query("discharging_test", f"""WITH a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE {_PRE}), b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE {_POST} AND l_suppkey % 3 = 0)
    SELECT DISTINCT s AS l_suppkey FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.s = a.s AND b.p NOT IN (SELECT p FROM a x WHERE x.s = b.s)) AND EXISTS (SELECT 1 FROM a y WHERE y.s = a.s AND y.p % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b WHERE b.s = y.s AND b.p = y.p))""")
def discharging_test(spark, sf):
    l = _t(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate")
    pre, post = l.filter(_PRE), l.filter(_POST).filter("l_suppkey % 3 = 0")
    closed = pre.select("l_suppkey", "l_partkey").join(post.select("l_suppkey", "l_partkey"), ["l_suppkey", "l_partkey"], "left_anti")
    return predicates.discharged(versions.closure_delta(pre, post, ["l_partkey"], ["l_suppkey"]), closed, F.col("l_partkey") % 2 == 0, ["l_suppkey"])


#: A region's stored query, and what stands against it.
_TEXTS = [
    ("select count(*) as n from functions where length(name) > 3", ""),
    ("select random() as r, now() as t from functions", "random,clock,order"),
    ("select name, line from functions order by name, line limit 5", "limit,order"),
    ("select current_timestamp as t, name from functions order by id limit 5", "clock"),
    ("select name, line from functions order by line, id limit 5", ""),
]


@query("determinism_rule", "SELECT r_regionkey AS query, d AS disqualified, d = '' AS runs FROM (SELECT r_regionkey, [" + ", ".join(f"'{d}'" for _, d in _TEXTS) + f"][1 + r_regionkey % {len(_TEXTS)}] AS d FROM region)")
def determinism_rule(spark, sf):
    functions = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("line"))
    text = F.get(F.array(*[F.lit(t) for t, _ in _TEXTS]), (F.col("r_regionkey") % len(_TEXTS)).cast("int"))
    stored = _t(spark, sf, "region").select(F.col("r_regionkey").alias("query"), text.alias("text"))
    return determinism.judged(stored, {"functions": (functions, ["id"])}, "query").withColumnRenamed("faults", "disqualified")
