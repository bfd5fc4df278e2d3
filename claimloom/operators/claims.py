"""The claim pool: linking, resolving, merging, folding and comparing claims, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.status import DEFINITIVE, DISAGREEMENT, DISCHARGED, HARD, UNSATISFIED


def superposition(verdicts: DataFrame) -> DataFrame:
    """Per symbol, its licensing and finding pins; symbols without a licence are dropped. Weak if there are findings."""
    sets = verdicts.groupBy("symbol").agg(
        F.array_sort(F.collect_set(F.when(F.col("verdict") == DISCHARGED, F.col("pin")))).alias("licensing"),
        F.array_sort(F.collect_set(F.when(F.col("verdict").isin(UNSATISFIED, DISAGREEMENT), F.col("pin")))).alias("findings"),
    )
    return sets.filter(F.size("licensing") > 0).withColumn("strength", F.when(F.size("findings") == 0, "Strong").otherwise("Weak"))


def superposition_counts(verdicts: DataFrame) -> DataFrame:
    """The same with numbers of distinct pins only: one row a pin first, so no symbol's pins are gathered and no row is copied for each count."""
    v = F.col("verdict")
    pins = verdicts.filter("pin is not null").groupBy("symbol", "pin").agg(F.bool_or(v == DISCHARGED).alias("l"), F.bool_or(v.isin(UNSATISFIED, DISAGREEMENT)).alias("f"))
    counts = pins.groupBy("symbol").agg(F.count_if("l").alias("licensing"), F.count_if("f").alias("findings"))
    return counts.filter("licensing > 0").withColumn("strength", F.when(F.col("findings") == 0, "Strong").otherwise("Weak"))


def symbol_key(bridge: Column, prop: Column) -> Column:
    """Bridge name, else the property's name without prefix, theory mark and assertion suffix."""
    p = F.regexp_replace(F.substring_index(F.regexp_replace(prop, "^consistency:", ""), "#euf#", 1), "::assertion$", "")
    return F.coalesce(F.nullif(bridge, F.lit("")), F.nullif(p, F.lit("")), F.lit("<unkeyed>"))


def classify_reports(verdicts: DataFrame, group: list[str], errors: Column | None = None) -> DataFrame:
    """Per group: VerifyFailed over Undecided over Verified, and the exit code; a report without rows is undecided. See :func:`with_link_surface`."""
    err = F.coalesce(F.sum(errors) if errors is not None else F.lit(0), F.lit(0))
    agg = verdicts.groupBy(*group).agg(F.count("verdict").alias("rows"), F.count_if(F.col("verdict").isin(*HARD)).alias("hard"), F.count_if(F.col("verdict") == DISCHARGED).alias("discharged"), err.alias("errors"))
    c = F.when(F.col("hard") > 0, "VerifyFailed").when((F.col("errors") > 0) | (F.col("rows") == 0) | (F.col("discharged") < F.col("rows")), "Undecided").otherwise("Verified")
    return agg.withColumn("class", c).withColumn("exit_code", F.when(c == "Verified", 0).when(c == "VerifyFailed", 1).otherwise(3))


def with_link_surface(reports: DataFrame, link_errors: DataFrame, group: list[str]) -> DataFrame:
    """Reports whose group has link errors become LinkFailed (exit 4), whatever they said; their counts stay."""
    bad = link_errors.select(*group).distinct().withColumn("_bad", F.lit(True))
    out = reports.join(bad, group, "left")
    return out.withColumns({"class": F.when(F.col("_bad"), "LinkFailed").otherwise(F.col("class")), "exit_code": F.when(F.col("_bad"), 4).otherwise(F.col("exit_code"))}).drop("_bad")


def merge_contracts(slots: DataFrame) -> DataFrame:
    """``name, slot, cid`` rows: equal slots dedupe, disjoint slots merge, two ids in one slot are a conflict."""
    per = slots.groupBy("name", "slot").agg(F.countDistinct("cid").alias("ids"), F.count("*").alias("claims"), F.min("cid").alias("cid"))
    return per.groupBy("name").agg(F.count("*").alias("slots"), F.sum("claims").alias("claims"), F.count_if(F.col("ids") > 1).alias("conflicts")).withColumn(
        "merge", F.when(F.col("conflicts") > 0, "conflict").when(F.col("slots") > 1, "merged").when(F.col("claims") > 1, "deduped").otherwise("single")
    )


def link_edges(edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """Call edges to contracts: a direct id wins as it stands, else the symbol after its first colon by name (the smallest id of that name); unmatched edges have a null target."""
    named = contracts.groupBy(F.col("name").alias("_name")).agg(F.min("cid").alias("_named"))
    bare = F.when(F.instr("target_symbol", ":") > 0, F.expr("substring(target_symbol, instr(target_symbol, ':') + 1)")).otherwise(F.col("target_symbol"))
    out = edges.join(named, bare == F.col("_name"), "left")
    return out.withColumn("linked_cid", F.coalesce("target_cid", "_named")).drop("_name", "_named")


def resolve(callsites: DataFrame, bridges: DataFrame, contracts: DataFrame) -> DataFrame:
    """Callsites (``symbol``) through bridges to contracts, with the reason of a failure; none is dropped."""
    b = bridges.select(F.col("source_symbol").alias("symbol"), "target_cid", F.lit(True).alias("_bridge"))
    c = contracts.select(F.col("cid").alias("target_cid"), F.col("kind").alias("_kind"), F.col("body").alias("_body"), F.lit(True).alias("_known"))
    out = callsites.join(b, "symbol", "left").join(c, "target_cid", "left")
    reason = F.when(F.col("_bridge").isNull(), "UnresolvedSymbol").when(F.col("target_cid").isNull(), "NoTarget").when(F.col("_known").isNull(), "NotInPool").when(F.col("_kind") != "contract", "NotAContract").when(F.col("_body").isNull(), "NoBody")
    return out.withColumn("reason", reason).drop("_bridge", "_kind", "_body", "_known")


def handshake(edges: DataFrame, implications: DataFrame, signers: list[str]) -> DataFrame:
    """``producer_post, consumer_pre`` pairs: tier 1 where they are equal, tier 2 where a trusted signer holds the implication; no signers, no hits."""
    cached = implications.filter(F.col("signer").isin(*signers) if signers else F.lit(False)).select(F.col("antecedent").alias("producer_post"), F.col("consequent").alias("consumer_pre")).distinct().withColumn("_hit", F.lit(2))
    out = edges.join(cached, ["producer_post", "consumer_pre"], "left")
    return out.withColumn("tier", F.when(F.col("producer_post") == F.col("consumer_pre"), 1).otherwise(F.col("_hit"))).drop("_hit")


def shared_by_all(members: DataFrame, owner: str, item: str) -> DataFrame:
    """Items that every owner has."""
    owners = members.select(F.countDistinct(owner).alias("n"))
    per = members.groupBy(item).agg(F.countDistinct(owner).alias("owners"))
    return per.filter(F.col("owners") == owners.scalar()).select(item)


def behaviour_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``cid, name`` of two versions: held, renamed, new or lost, and the bump it implies."""
    o, n = old.select("cid", F.col("name").alias("old_name")), new.select("cid", F.col("name").alias("new_name"))
    out = o.join(n, "cid", "full_outer")
    change = F.when(F.col("old_name").isNull(), "new").when(F.col("new_name").isNull(), "lost").when(F.col("old_name") != F.col("new_name"), "renamed").otherwise("held")
    return out.withColumn("change", change).withColumn("bump", F.when(change == "lost", "major").when(change == "new", "minor").otherwise("none"))


def compose_verdict(rows: DataFrame, group: list[str]) -> DataFrame:
    """Any Refuted; all Proved; any Unknown; else Unresolved."""
    v = F.col("verdict")
    return rows.groupBy(*group).agg(F.when(F.bool_or(v == "Refuted"), "Refuted").when(F.bool_and(v == "Proved"), "Proved").when(F.bool_or(v == "Unknown"), "Unknown").otherwise("Unresolved").alias("verdict"))


def portfolio(seats: DataFrame, group: list[str]) -> DataFrame:
    """Consensus of definitive verdicts, and the first definitive verdict by seat."""
    d = F.when(F.col("verdict").isin(*DEFINITIVE), F.col("verdict"))
    agg = seats.groupBy(*group).agg(F.min(d).alias("_lo"), F.max(d).alias("_hi"), F.min(F.when(d.isNotNull(), F.struct("seat", "verdict")))["verdict"].alias("first_wins"))
    consensus = F.when(F.col("_lo").isNull(), "Undecidable").when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(DISAGREEMENT)
    return agg.select(*group, consensus.alias("consensus"), F.coalesce("first_wins", F.lit("Undecidable")).alias("first_wins"))


def closure(edges: DataFrame, source: str, target: str, depth: int = 64) -> DataFrame:
    """All pairs ``source, target`` with a path, by semi-naive doubling joins; cycles end when nothing is new."""
    reach = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct().checkpoint()
    have = reach.count()
    for _ in range(depth):
        more = reach.alias("x").join(reach.alias("y"), F.col("x.t") == F.col("y.s")).select("x.s", "y.t")
        reach = reach.union(more).distinct().checkpoint()
        now = reach.count()
        if now == have:
            break
        have = now
    return reach.select(F.col("s").alias(source), F.col("t").alias(target))


def reaching(edges: DataFrame, source: str, target: str, ends: DataFrame) -> DataFrame:
    """``node``: all with a path of one step or more to one of ``ends`` (column ``node``): a walk back from the ends, not a closure of all pairs."""
    found = None
    front = ends.select("node").distinct()
    while True:
        step = edges.join(front.select(F.col("node").alias(target)), target, "left_semi").select(F.col(source).alias("node")).distinct()
        front = (step if found is None else step.join(found, "node", "left_anti")).checkpoint()
        if found is not None and front.isEmpty():
            return found
        found = front if found is None else found.union(front).checkpoint()


def region_holds(demands: DataFrame, facts_closure: DataFrame, top: str) -> DataFrame:
    """``a outlives b``: equal, the top region on either side, or in the closure; and how."""
    c = facts_closure.select(F.col("longer").alias("a"), F.col("shorter").alias("b"), F.lit(True).alias("_in"))
    out = demands.join(c, ["a", "b"], "left")
    how = F.when(F.col("a") == F.col("b"), "reflexive").when((F.col("a") == top) | (F.col("b") == top), "top").when(F.col("_in"), "closure").otherwise("refused")
    return out.select("a", "b", how.alias("how"))


def weaken(claims: DataFrame, verified: DataFrame) -> DataFrame:
    """``claim, conjunct`` rows less the verified conjuncts: how many are left; none left means true."""
    v = verified.select("conjunct").distinct().withColumn("_v", F.lit(1))
    return claims.join(v, "conjunct", "left").groupBy("claim").agg(F.count("*").alias("conjuncts"), F.count_if(F.col("_v").isNull()).alias("left")).withColumn("discharged", F.col("left") == 0)


def contrapositive(obligations: DataFrame, pool: DataFrame) -> DataFrame:
    """``not q -> not p`` is discharged where the pool has ``p -> q``."""
    p = pool.select(F.col("antecedent").alias("p"), F.col("consequent").alias("q")).distinct()
    return obligations.join(p, (F.col("not_antecedent") == F.col("q")) & (F.col("not_consequent") == F.col("p")), "left_semi")


def latest(bindings: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return bindings.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def theory(nodes: DataFrame, precedence: dict[str, int]) -> DataFrame:
    """The theory of highest precedence among a formula's nodes."""
    rank = F.coalesce(*[F.when(F.col("theory") == k, F.lit(v)) for k, v in precedence.items()], F.lit(-1))
    return nodes.groupBy("formula").agg(F.max_by("theory", F.struct(rank, "theory")).alias("theory"))
