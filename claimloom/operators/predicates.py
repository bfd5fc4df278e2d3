"""The predicate layer's relations, results and guards: schemas with keys and checks, result rows, applications that fail closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ARGS = "array<struct<position: int, kind: string, text: string>>"
#: Columns, key and checks of the relations, version 1 (fixed values).
RELATIONS = {
    "call_edges": (f"caller_function string, callee_name string, args {_ARGS}, callsite_path string, callsite_line int, callsite_column int", [], []),
    "functions": ("name string, path string, line int, has_body int", ["name"], ["has_body in (0, 1)"]),
    "contracts": ("function string, kind string, binding string, source_cid string", [], []),
    "lifted_files": ("path string, edge_count int, source_cid string", ["path"], []),
    "effects": ("function string, kind string, target string, source_cid string", [], ["kind in ('Reads', 'Writes', 'Io', 'Unsafe', 'Panics', 'UnresolvedCall')"]),
    "composed_contracts": ("composed_cid string, chain array<string>, effect_set_cid string, ccp_version string, source_cid string", ["composed_cid"], []),
}
def violations(rows: DataFrame, relation: str) -> DataFrame:
    """``rule, key, rows`` of each broken rule: a missing or repeated key, a check that does not hold."""
    _, key, checks = RELATIONS[relation]
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in (key or rows.columns[:1])])
    found = [(f"check:{c}", rows.filter(~F.coalesce(F.expr(c), F.lit(False))).groupBy(text.alias("key")).agg(F.count("*").alias("rows"))) for c in checks]
    if key:
        found.append(("key:missing", rows.filter(F.greatest(*[F.col(k).isNull() for k in key], F.lit(False))).groupBy(text.alias("key")).agg(F.count("*").alias("rows"))))
        found.append(("key:repeated", rows.groupBy(text.alias("key")).agg(F.count("*").alias("rows")).filter("rows > 1")))
    out = None
    for rule, bad in found:
        part = bad.select(F.lit(rule).alias("rule"), "key", "rows")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.limit(0).select(F.lit("").alias("rule"), F.lit("").alias("key"), F.lit(0).cast("long").alias("rows"))


def result_rows(rows: DataFrame, path: Column, line: Column, function: Column, fragment: Column, evidence: Column) -> DataFrame:
    """``locus, evidence, key``: a result row and the text that it is ordered and compared by."""
    locus = F.struct(path.alias("path"), line.cast("int").alias("line"), function.alias("function"), fragment.alias("fragment"))
    return rows.select(locus.alias("locus"), evidence.alias("evidence"), F.concat_ws(":", path, F.lpad(line.cast("string"), 9, "0"), function, fragment).alias("key"))


def set_id(rows: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Per group the number of distinct keys and the id of their set: of the ids of its 256 parts, each over the sorted hashes of its keys, so no row holds all."""
    one = rows.select(*group, F.sha2(F.col(key), 256).alias("h")).distinct()
    part = one.groupBy(*group, F.substring("h", 1, 2).alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("p"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "p"))), lambda x: x["p"])
    return part.groupBy(*group).agg(F.sum("n").alias("rows"), F.sha2(F.array_join(parts, ""), 256).alias("result_cid"))


def applied(applications: DataFrame, again: DataFrame, group: list[str], compatible: dict[str, str]) -> DataFrame:
    """Stated applications (``rows, result_cid, lifter``) against what is found again (``rows, result_cid, lifter``): anything that differs fails closed.

    Lifters agree where they are equal or listed as compatible.
    """
    a = applications.select(*group, F.col("rows").alias("_rows"), F.col("result_cid").alias("_cid"), F.col("lifter").alias("_lifter"))
    same = F.col("lifter") == F.col("_lifter")
    for old, new in compatible.items():
        same = same | ((F.col("_lifter") == old) & (F.col("lifter") == new))
    status = F.when(F.col("result_cid").isNull(), "refused:no-result").when(~same, "refused:lifter").when(F.col("rows") != F.col("_rows"), "refused:count").when(F.col("result_cid") != F.col("_cid"), "refused:result").otherwise("held")
    return a.join(again, group, "left").select(*group, status.alias("status"))


def discharged(delta: DataFrame, closed_rows: DataFrame, gap: Column, group: list[str]) -> DataFrame:
    """Groups whose change discharges (``shape`` empty or strict-subset) and among whose closed rows the gap's own row is."""
    return delta.filter(F.col("shape").isin("empty", "strict-subset")).join(closed_rows.filter(gap).select(*group).distinct(), group, "left_semi").select(*group)
