"""Three-valued logic, options and results as columns; null is "undecided" in logic and "none" as an option."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.status import outcome

Fn = Callable[[Column], Column]


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def then(left: Column, right: Column) -> Column:
    """``left && right``: the right side is evaluated only where the left one holds; an undecided left side decides nothing."""
    return F.when(left.isNull(), F.lit(None).cast("boolean")).when(~left, False).otherwise(right)


def otherwise(left: Column, right: Column) -> Column:
    """``left || right``: the right side is evaluated only where the left one fails."""
    return F.when(left.isNull(), F.lit(None).cast("boolean")).when(left, True).otherwise(right)


def for_all(domain: Column, p: Fn) -> Column:
    """Over a finite domain: false if any element fails, undecided if any is undecided."""
    return F.when(F.exists(domain, lambda x: ~F.coalesce(p(x), F.lit(True))), False).when(F.exists(domain, lambda x: p(x).isNull()), None).otherwise(True)


def there_is(domain: Column, p: Fn) -> Column:
    return ~for_all(domain, lambda x: ~p(x))


def choice(domain: Column, p: Fn) -> Column:
    """The first element for which ``p`` holds, or null."""
    return F.get(F.filter(domain, lambda x: F.coalesce(p(x), F.lit(False))), F.lit(0))


def refused_domain(sort: str) -> Column:
    """A quantifier over a sort without a finite domain."""
    return outcome(F.lit(None).cast("boolean"), F.lit(True), f"InfiniteSort:{sort}")


def truth(x: Column, kind: str) -> Column:
    """Truth of a value: numbers by zero, texts and containers by size; null is undecided."""
    return {"number": lambda: x != 0, "text": lambda: F.octet_length(x) > 0, "container": lambda: F.size(x) > 0, "bool": lambda: x}[kind]()


def text_of(b: Column) -> Column:
    """``T``, ``F``, or ``U`` for undecided."""
    return F.when(b.isNull(), "U").when(b, "T").otherwise("F")


# results: struct(tag, ok, err)


def result(ok: Column, err: Column) -> Column:
    """A result with a value where ``err`` is null, else an error."""
    return F.struct(F.when(err.isNull(), "Ok").otherwise("Err").alias("tag"), F.when(err.isNull(), ok).alias("ok"), err.alias("err"))


def ok_or(option: Column, err: Column) -> Column:
    return result(option, F.when(option.isNull(), err))


def is_ok(r: Column) -> Column:
    return r["tag"] == "Ok"


def is_err(r: Column) -> Column:
    return r["tag"] == "Err"


def map_ok(r: Column, f: Fn) -> Column:
    return result(f(r["ok"]), r["err"])


def map_err(r: Column, f: Fn) -> Column:
    return result(r["ok"], F.when(r["err"].isNotNull(), f(r["err"])))


def and_then(r: Column, f: Fn, kind: str) -> Column:
    """``f`` gives a result; an error stays."""
    return F.when(is_ok(r), f(r["ok"])).otherwise(result(F.lit(None).cast(kind), r["err"]))


def or_else(r: Column, f: Fn) -> Column:
    return F.when(is_ok(r), r).otherwise(f(r["err"]))


def then_some(b: Column, x: Column) -> Column:
    return F.when(b, x)


def matches(x: Column, *patterns: Fn) -> Column:
    """Whether any pattern holds; null never matches."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(p(x), F.lit(False))
    return hit


def match(x: Column, arms: list[tuple[Fn, Column]]) -> Column:
    """The first arm that holds, as an outcome; a value that no arm takes is incomplete."""
    out = F.when(F.lit(False), arms[0][1])
    for p, value in arms:
        out = out.when(F.coalesce(p(x), F.lit(False)), value)
    return outcome(out, incomplete=~matches(x, *[p for p, _ in arms]), effect="OpenMatch")
