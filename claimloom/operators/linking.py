"""Linking and validity: callsites, demands, manifests, revisions, compositions, yanks, fail-closed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.claims import reaching
from claimloom.operators.graphs import components
from claimloom.operators.selection import nearest_ranks


def callsites(terms: DataFrame, bridges: DataFrame) -> DataFrame:
    """One row per term node of ``claim, nodes``; a node whose symbol no bridge names stays, unresolved."""
    b = bridges.select(F.col("source_symbol").alias("symbol"), "target_cid")
    sites = terms.select("claim", F.posexplode("nodes").alias("pos", "symbol")).join(b, "symbol", "left")
    return sites.withColumn("resolved", F.col("target_cid").isNotNull())


def own_callsites(sites: DataFrame, owned: DataFrame, key: list[str], imported: Column) -> DataFrame:
    """Callsites that are neither imported nor owned by another pass."""
    return sites.filter(~F.coalesce(imported, F.lit(False))).join(owned.select(*key).distinct(), key, "left_anti")


#: Pairs that are made in one block of a large key, and blocks that a task gets on average.
BLOCK_PAIRS, TASK_BLOCKS = 1 << 21, 8


def compose_endpoints(a: DataFrame, b: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Pairs of one domain where an input of ``b`` (array ``from``) is the output ``to`` of ``a``.

    A key's pairs are made in blocks of about ``block_pairs``: its rows of ``a`` are dealt over the blocks, those of ``b`` stand in
    each, and the number of tasks follows from that of all pairs.  So no task's work grows with the tables, however few keys there are.
    """
    key = ["domain", "to"]
    ends = b.select(F.col("id").alias("b_id"), "domain", F.explode(F.array_distinct("from")).alias("to")).dropna(subset=key)
    starts = a.select(F.col("id").alias("a_id"), *key).dropna(subset=key)
    # both counts in a double: their product may pass a long
    load = starts.groupBy(*key).agg(F.count("*").alias("_a")).join(ends.groupBy(*key).agg(F.count("*").alias("_b")), key)
    load = load.withColumn("_blocks", F.least(F.col("_a"), F.ceil(F.col("_a").cast("double") * F.col("_b") / block_pairs)).cast("long"))
    blocks = load.select(F.sum("_blocks").alias("n")).first().n or 0
    session = a.sparkSession
    tasks = min(max(blocks // TASK_BLOCKS, int(session.conf.get("spark.sql.shuffle.partitions"))), 100_000)
    large = load.filter("_blocks > 1").select(*key, "_blocks")
    one = F.coalesce(F.col("_blocks"), F.lit(1).cast("long"))
    at = F.struct(*key, "_block").alias("_at")  # one key: a part that is constant would leave a join's keys, and the partitions with it
    starts = starts.join(large, key, "left").withColumn("_block", F.pmod(F.xxhash64("a_id"), one)).select("a_id", *key, at)
    ends = ends.join(large, key, "left").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).select("b_id", at)
    # a number of partitions that is asked for is not coalesced by bytes: pairs cost more than the rows that make them
    return starts.repartition(tasks, "_at").join(ends.repartition(tasks, "_at").hint("merge"), "_at").drop("_at")


def manifest_group(members: DataFrame, name: str) -> DataFrame:
    """Members of one named group and the ambient ones (null group), each id once."""
    return members.filter((F.col("group") == name) | F.col("group").isNull()).select("cid").distinct()


def signature_mismatches(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """Calls of a known contract whose signature differs."""
    c = contracts.select("name", F.col("signature").alias("declared"))
    return calls.join(c, "name").filter(~F.col("signature").eqNullSafe(F.col("declared")))


def orphaned(definitions: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Definitions referenced before and no longer after."""
    return definitions.join(before.select(key), key, "left_semi").join(after.select(key), key, "left_anti")


def demand_gaps(demands: DataFrame, declared: DataFrame) -> DataFrame:
    """Demands (``owner, parameter, sort``) against declarations; each gets the name of its gap, or ``met``."""
    per = declared.groupBy("owner", "parameter").agg(F.countDistinct("sort").alias("sorts"), F.min("sort").alias("declared"))
    owners = declared.select("owner").distinct().withColumn("_known", F.lit(True))
    out = demands.join(per, ["owner", "parameter"], "left").join(owners, "owner", "left")
    gap = F.when(F.col("_known").isNull(), "NoOwner").when(F.col("sorts").isNull(), "NoParameter").when(F.col("sorts") > 1, "Ambiguous").when(F.col("sort") != F.col("declared"), "SortMismatch").otherwise("met")
    return out.withColumn("gap", gap).drop("_known", "sorts", "declared")


def union_by_cid(*pools: DataFrame) -> DataFrame:
    """All pools' members, each id once, with the number of pools that hold it."""
    every = None
    for i, p in enumerate(pools):
        part = p.select("cid").withColumn("pool", F.lit(i))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("cid").agg(F.countDistinct("pool").alias("pools"))


def run_identity(rows: DataFrame, group: list[str], order: list[str], item: str) -> DataFrame:
    """A hash of each group's items in order; two runs with one hash gave the same order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item")))), lambda r: r["_item"].cast("string"))
    return rows.groupBy(*group).agg(F.sha2(F.array_join(items, ","), 256).alias("identity"))


def same_order(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    x, y = a.withColumnRenamed("identity", "a"), b.withColumnRenamed("identity", "b")
    state = F.when(F.col("a").isNull(), "only-b").when(F.col("b").isNull(), "only-a").when(F.col("a") == F.col("b"), "same").otherwise("differs")
    return x.join(y, group, "full_outer").withColumn("state", state).drop("a", "b")


def floor_summary(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group: counts of completed, missing and error rows and the id of its set of paths."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    paths = F.array_join(F.array_sort(F.collect_set(F.col("path").cast("string"))), "\n")
    return rows.groupBy(*group).agg(count("completed"), count("missing"), count("error"), F.sha2(paths, 256).alias("corpus"))


def axis_tally(rows: DataFrame, axis: str) -> DataFrame:
    """Occurrences per axis, each (owner, occurrence) once."""
    return rows.select(axis, "owner", "occurrence").distinct().groupBy(axis).agg(F.count("*").alias("n"), F.countDistinct("owner").alias("owners"))


def verification_lookup(wanted: DataFrame, memo: DataFrame) -> DataFrame:
    """The verdict held for (binding_hash, property_hash); a miss goes to the producer."""
    key = ["binding_hash", "property_hash"]
    held = memo.groupBy(*key).agg(F.min("verdict").alias("verdict"), F.countDistinct("verdict").alias("_n"))
    out = wanted.join(held, key, "left")
    return out.withColumn("route", F.when(F.col("_n").isNull(), "producer").when(F.col("_n") > 1, "disagreement").otherwise("held")).drop("_n")


def compose_functions(atoms: DataFrame, group: list[str]) -> DataFrame:
    """Atoms ``pos, cid, pure, effects`` leaf-first: the chain and the union of effects, or the first impure atom that refuses."""
    chain = F.transform(F.array_sort(F.collect_list(F.struct("pos", "cid"))), lambda r: r["cid"])
    refused = F.min(F.when(~F.col("pure"), F.struct("pos", "cid")))["cid"]
    out = atoms.groupBy(*group).agg(chain.alias("chain"), refused.alias("refused_by"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("effects")))).alias("effects"))
    return out.withColumn("chain", F.when(F.col("refused_by").isNull(), F.col("chain")))


def compose_range_loss(edges: DataFrame, path: list[str]) -> DataFrame:
    """The loss of a path from its edges' labels: none is neutral, wrapping and saturating stay visible, both make a compound."""
    has = lambda x: F.bool_or(F.col("loss") == x)
    both = F.when(has("saturating") & has("wrapping"), "compound:saturating+wrapping")
    return edges.groupBy(*path).agg(both.when(has("wrapping"), "wrapping").when(has("saturating"), "saturating").when(has("narrowing"), "narrowing").when(has("widening"), "widening").otherwise("none").alias("loss"))


def apply_yanks(releases: DataFrame, yanks: DataFrame, policy: str, trusted: list[str] = ()) -> DataFrame:
    """Strict: a yank by a release's own signer excludes it; audit: only one by a trusted signer; permissive: kept with a warning."""
    if policy == "strict":
        return releases.join(yanks.select("set_cid", "signer").distinct(), ["set_cid", "signer"], "left_anti").withColumn("warned", F.lit(False))
    if policy == "audit":
        return releases.join(yanks.filter(F.col("signer").isin(*trusted)).select("set_cid"), "set_cid", "left_anti").withColumn("warned", F.lit(False))
    hit = yanks.select("set_cid").distinct().withColumn("_y", F.lit(True))
    return releases.join(hit, "set_cid", "left").withColumn("warned", F.coalesce("_y", F.lit(False))).drop("_y")


def estimate_costs(rows: DataFrame, group: list[str], bands: int = 4) -> DataFrame:
    """Known costs as they are; unknown ones by the upper median of their size's band of known rows, at least the known 75th percentile (1 without any).

    ``path, size_bytes, cost_s``.  Bands hold equal numbers of known rows by size.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy("size_bytes", "path")
    known = rows.filter("cost_s is not null").withColumn("_i", F.row_number().over(w) - 1).withColumn("_k", F.count("*").over(Window.partitionBy(*group)))
    known = known.withColumn("_band", F.floor(F.col("_i") * bands / F.col("_k")))
    inside = Window.partitionBy(*group, "_band")
    known = known.withColumn("_j", F.row_number().over(inside.orderBy("cost_s", "path")) - 1).withColumn("_n", F.count("*").over(inside))
    band = known.groupBy(*group, "_band").agg(F.max("size_bytes").alias("_max"), F.max(F.when(F.col("_j") == F.floor(F.col("_n") / 2), F.col("cost_s"))).alias("_median"))
    band = band.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_max", "_median"))).alias("_bands"))
    floor = nearest_ranks(rows, group, "cost_s", [0.75]).select(*group, F.col("result").alias("_floor"))
    out = rows.join(floor, group, "left").join(band, group, "left")
    fits = F.get(F.filter("_bands", lambda b: b["_max"] >= F.greatest(F.col("size_bytes"), F.lit(0))), F.lit(0))["_median"]
    least = F.coalesce("_floor", F.lit(1.0))
    return out.withColumn("estimate", F.coalesce("cost_s", F.greatest(least, F.coalesce(fits, least)))).drop("_floor", "_bands")


def fail_closed(references: DataFrame, entries: DataFrame, declarations: DataFrame, depends: DataFrame, core: list[str] = (), revocations: DataFrame | None = None) -> DataFrame:
    """``subject, reason`` of all that a verifier must refuse.

    ``references(name)``; ``entries(catalog, name, cid)``; ``declarations(cid, signed, revoked, compatible)``;
    ``depends(cid, on)``.  Whatever depends on a refused id, by any path, is refused too.  Names in ``core`` need no entry.
    With ``revocations(signer, revoked_at)`` a declaration (``signer, declared_at``) is refused from its signer's first revocation on.
    """
    if revocations is not None:
        since = revocations.groupBy("signer").agg(F.min("revoked_at").alias("_since"))
        declarations = declarations.join(since, "signer", "left").withColumn("revoked", F.coalesce(F.col("revoked"), F.lit(False)) | F.coalesce(F.col("declared_at") >= F.col("_since"), F.lit(False)))
    references = references.filter(~F.col("name").cast("string").isin(*core)) if core else references
    row = lambda d, c, why: d.select(F.col(c).cast("string").alias("subject"), F.lit(why).alias("reason"))
    names = entries.groupBy("name").agg(F.countDistinct("cid").alias("cids"), F.countDistinct("catalog").alias("catalogs"))
    links = depends.select("cid", "on").distinct()
    faults = (
        row(entries.join(declarations, "cid", "left_anti"), "cid", "declaration_missing")
        .union(row(declarations.filter("not signed"), "cid", "invalid_signature"))
        .union(row(declarations.filter("revoked"), "cid", "signer_key_revoked"))
        .union(row(declarations.filter("not compatible"), "cid", "compiler_incompatible"))
        .union(row(on_cycles(links, "cid", "on"), "cid", "cyclic_dependency"))
    ).checkpoint()
    text = links.select(F.col("cid").cast("string").alias("cid"), F.col("on").cast("string").alias("on"))
    through = row(reaching(text, "cid", "on", faults.select(F.col("subject").alias("node"))), "node", "dependency_unresolvable")
    named = row(references.join(names, "name", "left_anti"), "name", "no_resolution").union(row(names.filter("cids > 1 and catalogs > 1"), "name", "name_collision"))
    return faults.union(through).union(named).distinct()


def on_cycles(links: DataFrame, source: str, target: str) -> DataFrame:
    """Nodes (as ``source``) on a cycle: those of the strongly connected components, found without a closure."""
    return components(links, source, target).select(F.col("node").alias(source))


def sequential(state: Column, posts: Column) -> Column:
    """Constraints after a statement; null (top) on either side absorbs."""
    return F.when(state.isNotNull() & posts.isNotNull(), F.array_sort(F.array_union(state, posts)))


def branched(then: Column, other: Column) -> Column:
    """Constraints that hold after both branches; a branch at top leaves none known."""
    return F.when(then.isNotNull() & other.isNotNull(), F.array_sort(F.array_intersect(then, other)))


def pin_gate(callsites: DataFrame, members: DataFrame) -> DataFrame:
    """Callsites (``target_cid, bundle``) whose target must come from the pinned bundle; a null bundle pins nothing."""
    known = members.select("bundle").distinct().withColumn("_bundle", F.lit(True))
    held = members.select("bundle", F.col("cid").alias("target_cid")).distinct().withColumn("_held", F.lit(True))
    out = callsites.join(known, "bundle", "left").join(held, ["bundle", "target_cid"], "left")
    reason = F.when(F.col("bundle").isNull(), F.lit(None).cast("string")).when(F.col("_bundle").isNull(), "PinnedBundleMissing").when(F.col("_held").isNull(), "NotInPinnedBundle")
    return out.withColumn("reason", reason).drop("_bundle", "_held")


def region_substitution(formals: Column, actuals: Column) -> Column:
    """Formal regions to actual ones: pairs with a null are dropped, of a repeated formal the last pair counts, the longer side is cut."""
    n = F.least(F.size(formals), F.size(actuals))
    pairs = F.filter(F.zip_with(F.slice(formals, 1, n), F.slice(actuals, 1, n), lambda f, a: F.struct(f.alias("f"), a.alias("a"))), lambda p: p["f"].isNotNull() & p["a"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["f"] == p["f"]))
    return F.map_from_entries(last)


def substituted(subst: Column, region: Column) -> Column:
    return F.coalesce(F.try_element_at(subst, region), region)


def discharge_parameters(candidates: DataFrame, formals: DataFrame, declared: DataFrame, universes: DataFrame) -> DataFrame:
    """Each candidate's resolution (``declared-demand``) or the named gap that blocks it.

    ``candidates(owner, coordinate, ordinal, sort, demand, fresh, basis)``; ``formals(owner, coordinate, ordinal, sort, fresh, contract_fresh)``, one
    row for each formal; ``declared(owner, demand)``; ``universes(owner, closed, external)``.
    """
    f = formals.select("owner", "coordinate", F.col("ordinal").alias("_ordinal"), F.col("sort").alias("_sort"), F.col("fresh").alias("_fresh"))
    own = formals.groupBy("owner").agg(F.bool_and("contract_fresh").alias("_contract"))
    d = declared.select("owner", "demand").distinct().withColumn("_declared", F.lit(True))
    u = universes.select("owner", F.col("closed").alias("_closed"), F.col("external").alias("_external"), F.lit(True).alias("_universe"))
    out = candidates.join(own, "owner", "left").join(f, ["owner", "coordinate"], "left").join(d, ["owner", "demand"], "left").join(u, "owner", "left")
    gap = (
        F.when(~F.col("fresh"), "StaleCandidateOrDemand")
        .when(F.col("_contract").isNull(), "MissingFormalOwnershipTestimony")
        .when(~F.col("_contract"), "StaleContract")
        .when(F.col("_ordinal").isNull(), "FormalCoordinateMismatch")
        .when(~F.col("_fresh"), "StaleFormalCoordinate")
        .when(F.col("_ordinal") != F.col("ordinal"), "FormalOrdinalMismatch")
        .when(F.col("_sort") != F.col("sort"), "FormalSortMismatch")
        .when((F.col("basis") == "closed-callers") & F.col("_universe").isNull(), "StaleResolution")
        .when(F.col("_declared"), "declared-demand")
        .when(F.coalesce(~F.col("_closed") | F.col("_external"), F.lit(True)), "OpenCallerUniverse")
        .otherwise("NoIncomingCaller")
    )
    return out.withColumn("resolution", gap).select(*candidates.columns, "resolution")


def attribute_safety(sites: DataFrame, shapes: DataFrame) -> DataFrame:
    """Attribute accesses (``receiver, attribute, guarded``): discharged by a guard or by the receiver's guaranteed attributes, else unproven with a reason."""
    known = shapes.select(F.col("receiver")).distinct().withColumn("_shape", F.lit(True))
    sure = shapes.filter("guaranteed").select("receiver", "attribute").distinct().withColumn("_sure", F.lit(True))
    out = sites.join(known, "receiver", "left").join(sure, ["receiver", "attribute"], "left")
    how = (
        F.when(F.coalesce(F.col("receiver"), F.lit("")) == "", "unproven:unknown-receiver")
        .when(F.coalesce(F.col("attribute"), F.lit("")) == "", "unproven:empty-attribute")
        .when(F.col("guarded"), "discharged:guard")
        .when(F.col("_shape").isNull(), "unproven:no-shape")
        .when(F.col("_sure"), "discharged:shape")
        .otherwise("unproven:not-guaranteed")
    )
    return out.withColumn("how", how).drop("_shape", "_sure")


def effect_verdicts(effects: DataFrame, table: DataFrame) -> DataFrame:
    """Effects (``kind``) to their verdict and reason; a kind that the table does not know is undecidable."""
    t = table.select("kind", "verdict", "reason")
    return effects.join(t, "kind", "left").withColumns({"verdict": F.coalesce("verdict", F.lit("Undecidable")), "reason": F.coalesce("reason", F.concat(F.lit("unknown effect "), F.col("kind")))})


def compose_chains(chains: DataFrame, registry: DataFrame) -> DataFrame:
    """Method chains (``id, methods``) as one composed id over their steps' contracts; null below two steps or where a step has none."""
    steps = chains.select("id", F.posexplode("methods").alias("pos", "name")).join(registry.groupBy("name").agg(F.min("cid").alias("cid")), "name", "left")
    made = steps.groupBy("id").agg(F.count("*").alias("steps"), F.count("cid").alias("known"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cid"))), lambda s: s["cid"]), ">").alias("text"))
    return chains.select("id").join(made, "id", "left").select("id", F.when((F.col("steps") >= 2) & (F.col("steps") == F.col("known")), F.sha2("text", 256)).alias("composed"))


def claim_errors(claims: DataFrame, scopes: DataFrame, sorts: list[str]) -> DataFrame:
    """``id, error`` of claims (``id, scope, sort, provenance``) that cannot be built; a claim may have several."""
    named = claims.join(scopes.select("scope").distinct().withColumn("_scope", F.lit(True)), "scope", "left")
    errors = F.array_compact(F.array(F.when(F.col("_scope").isNull(), "UnknownScope"), F.when(~F.coalesce(F.col("sort").isin(*sorts), F.lit(False)), "UnknownSort"), F.when(F.coalesce(F.col("provenance"), F.lit("")) == "", "NoProvenance")))
    return named.select("id", F.explode(errors).alias("error"))


def bindings(rows: DataFrame, *parts: str) -> DataFrame:
    """Content-addressed binding entries: each distinct one once, with its id and how many rows stated it."""
    entry = F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("\x00")) for p in parts])
    return rows.groupBy(*parts).agg(F.count("*").alias("stated")).withColumn("entry_cid", F.sha2(entry, 256))


def spoken(facts: DataFrame, universes: DataFrame, implications: DataFrame) -> DataFrame:
    """Utterances of three kinds as one pool: ``speaker, kind, subject, object``."""
    one = lambda d, kind, o: d.select("speaker", F.lit(kind).alias("kind"), F.col("subject").cast("string").alias("subject"), o.cast("string").alias("object"))
    return one(facts, "fact", F.lit(None)).union(one(universes, "universe", F.lit(None))).union(one(implications, "implication", F.col("object")))


def solved(pool: DataFrame) -> DataFrame:
    """What a step of implication gives from the pool's facts: the object, the speaker of the implication and that of the fact; known facts are left out."""
    facts = pool.filter("kind = 'fact'").select("subject", F.col("speaker").alias("fact_by")).distinct()
    rules = pool.filter("kind = 'implication'").select("subject", "object", F.col("speaker").alias("rule_by")).distinct()
    new = facts.join(rules, "subject").select(F.col("object").alias("subject"), "rule_by", "fact_by").distinct()
    return new.join(facts.select("subject"), "subject", "left_anti")


def link_or_share(groups: DataFrame, group: list[str]) -> DataFrame:
    """Per group of parts (``composed``: the id they compose to, or null; ``contracts``: their contract ids): composed if all compose, else a contract that all share, else refused."""
    all_shared = F.array_sort(F.array_distinct(F.flatten(F.collect_list("contracts"))))
    g = groups.groupBy(*group).agg(F.count("*").alias("parts"), F.count("composed").alias("made"), F.collect_list("contracts").alias("each"), all_shared.alias("any"))
    shared = F.filter("any", lambda c: F.forall("each", lambda e: F.array_contains(e, c)))
    return g.select(*group, F.when(F.col("parts") == F.col("made"), "composed").when(F.size(shared) > 0, "shared").otherwise("refused").alias("link"), F.when(F.col("parts") != F.col("made"), F.get(shared, F.lit(0))).alias("contract"))


def decided(obligations: DataFrame, solver) -> DataFrame:
    """Obligations with the ``verdict`` of a solver: a function from the table's columns to a Column; a null verdict is undecidable."""
    return obligations.withColumn("verdict", F.coalesce(solver(F.col), F.lit("Undecidable")))


def interval_solver(c) -> Column:
    """``lo <= x <= hi`` implies ``x <= bound``: the default solver; an open interval is left undecided, an empty one discharges."""
    return F.when(c("lo") > c("hi"), "Discharged").when(c("hi") <= c("bound"), "Discharged").when(c("hi") > c("bound"), "Unsatisfied")
