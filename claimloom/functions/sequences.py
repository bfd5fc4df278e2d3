"""Finite ordered sequences in array form: each operator is one Column expression.

Counts are Python ints or integer columns.  Where a shape has no meaning (a step of
zero) the operator raises at plan time for a Python int, and gives null for a column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.status import outcome

Fn = Callable[[Column], Column]


def _n(x) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def _positive(n) -> Column:
    if isinstance(n, int) and n <= 0:
        raise ValueError("a size of zero or less is refused")
    return F.when(_n(n) > 0, _n(n))


def int_range(a, b, inclusive: bool = False) -> Column:
    """``a..b`` or ``a..=b``; empty where the end is not above the start."""
    last = _n(b) if inclusive else _n(b) - 1
    return F.when(last >= _n(a), F.sequence(_n(a), F.greatest(last, _n(a)))).otherwise(F.array().cast("array<int>"))


def indices(n: Column) -> Column:
    return int_range(0, n)


def repeat(x: Column, n) -> Column:
    return F.array_repeat(x, _n(n))


def map_(a: Column, f: Fn) -> Column:
    return F.transform(a, f)


def filter_map(a: Column, f: Fn) -> Column:
    return F.transform(F.filter(F.transform(a, lambda x: F.struct(f(x).alias("v"))), lambda s: s["v"].isNotNull()), lambda s: s["v"])


def flat_map(a: Column, f: Fn) -> Column:
    return F.flatten(F.transform(a, f))


def zip_(a: Column, b: Column) -> Column:
    """Pairs, as many as the shorter side has."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("l"), y.alias("r")))


def enumerate_(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x")))


def chain(*parts: Column) -> Column:
    return F.concat(*parts)


def take(a: Column, n) -> Column:
    return F.slice(a, 1, F.greatest(_n(n), F.lit(0)))


def skip(a: Column, n) -> Column:
    return F.slice(a, F.greatest(_n(n), F.lit(0)) + 1, F.size(a))


def lead_length(a: Column, p: Fn) -> Column:
    """Elements before the first one that fails ``p``."""
    at = F.array_position(F.transform(a, lambda x: F.coalesce(p(x), F.lit(False))), False)
    return F.when(at == 0, F.size(a)).otherwise((at - 1).cast("int"))


def take_while(a: Column, p: Fn) -> Column:
    return take(a, lead_length(a, p))


def skip_while(a: Column, p: Fn) -> Column:
    return skip(a, lead_length(a, p))


def step_by(a: Column, n) -> Column:
    k = _positive(n)
    return F.when(k.isNotNull(), F.filter(a, lambda x, i: i % k == 0))


def rev(a: Column) -> Column:
    return F.reverse(a)


def cycle_take(a: Column, n) -> Column:
    return F.when(F.size(a) == 0, a).otherwise(F.transform(indices(_n(n)), lambda i: F.get(a, i % F.size(a))))


def chunks(a: Column, n, exact: bool = False) -> Column:
    k = _positive(n)
    many = F.floor(F.size(a) / k) if exact else F.ceil(F.size(a) / k)
    return F.when(k.isNotNull(), F.transform(indices(many.cast("int")), lambda i: F.slice(a, i * k + 1, k)))


def rchunks(a: Column, n, exact: bool = False) -> Column:
    """Chunks from the end; each in its own order."""
    k = _positive(n)
    many = F.floor(F.size(a) / k) if exact else F.ceil(F.size(a) / k)
    end = lambda i: F.size(a) - i * k
    return F.when(k.isNotNull(), F.transform(indices(many.cast("int")), lambda i: F.slice(a, F.greatest(end(i) - k, F.lit(0)) + 1, F.least(k, end(i)))))


def windows(a: Column, n) -> Column:
    k = _positive(n)
    return F.when(k.isNotNull(), F.transform(indices(F.size(a) - k + 1), lambda i: F.slice(a, i + 1, k)))


def intersperse(a: Column, sep: Column) -> Column:
    return F.flatten(F.transform(a, lambda x, i: F.when(i == 0, F.array(x)).otherwise(F.array(sep, x))))


def kmerge(arrays: Column, key: Fn | None = None) -> Column:
    """Merge of sequences that are sorted by ``key``: stable, equal keys in the order of the sequences."""
    flat = F.flatten(arrays)
    if key is None:
        return F.array_sort(flat)
    tagged = F.transform(flat, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])


def scan(a: Column, init: Column, f: Callable[[Column, Column], Column]) -> Column:
    """The states after each element; ``f`` is evaluated once for each.

    Each state copies those before it, so long sequences go through :func:`capped`, or in row form through a window.
    """
    return F.aggregate(a, F.array(init), lambda acc, x: F.concat(acc, F.array(f(F.element_at(acc, -1), x))), lambda acc: F.slice(acc, F.lit(2), F.size(acc) - 1))


#: Elements of a sequence that an operator takes at most; longer ones are incomplete, not cut.
CAP = 4096


def capped(a: Column, result: Fn, cap: int = CAP) -> Column:
    """``result(a)`` as an outcome; a sequence above the cap is incomplete and is not evaluated."""
    over = F.size(a) > cap
    return outcome(F.when(~over, result(a)), incomplete=over, effect="LengthCap")


#: Producers whose elements are all there when a sequence is written down.
FINITE = ("literal", "range", "collection", "repeat")


def from_source(a: Column, producer: Column, result: Fn) -> Column:
    """``result(a)`` as an outcome, if its producer is finite; what a generator, a call or an unknown producer gives is read at a time of its own, so it is incomplete and not guessed."""
    known = F.coalesce(producer.isin(*FINITE), F.lit(False))
    return outcome(F.when(known, result(a)), incomplete=~known, effect="AmbiguousTemporalIdentity")


def fold(a: Column, init: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, init, f)


def rfold(a: Column, init: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.reverse(a), init, f)


def nth(a: Column, i) -> Column:
    """Null where there is none; negative positions count from the end."""
    return F.when(_n(i) >= 0, F.get(a, _n(i))).otherwise(F.get(a, F.size(a) + _n(i)))


def between(a: Column, lo, hi) -> Column:
    """``a[lo..hi]``; null when the bounds are out of order or range."""
    return F.when((_n(lo) >= 0) & (_n(lo) <= _n(hi)) & (_n(hi) <= F.size(a)), F.slice(a, _n(lo) + 1, _n(hi) - _n(lo)))


def is_sorted(a: Column) -> Column:
    return F.forall(F.zip_with(take(a, F.size(a) - 1), skip(a, 1), lambda x, y: x <= y), lambda ok: ok)


def partition_point(a: Column, p: Fn) -> Column:
    """Elements for which ``p`` holds; null when they do not all lead."""
    n = F.size(F.filter(a, p))
    return F.when(lead_length(a, p) == n, n)


def starts_with(a: Column, b: Column) -> Column:
    return F.slice(a, 1, F.size(b)).eqNullSafe(b)


def ends_with(a: Column, b: Column) -> Column:
    return (F.size(b) == 0) | ((F.size(b) <= F.size(a)) & F.slice(a, F.greatest(F.size(a) - F.size(b), F.lit(0)) + 1, F.size(b)).eqNullSafe(b))


def collect_option(a: Column) -> Column:
    """Null as a whole if any element is."""
    return F.when(~F.exists(a, lambda x: x.isNull()), a)


def fixed(a: Column, n: int) -> Column:
    return F.when(F.size(a) == n, a)


def equal(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda ok: ok)


def remove_first(a: Column, x: Column) -> Column:
    at = F.array_position(a, x)
    return F.when(at == 0, a).otherwise(F.concat(F.slice(a, 1, (at - 1).cast("int")), F.slice(a, (at + 1).cast("int"), F.size(a))))


def assign_slice(a: Column, lo: int, hi: int, b: Column) -> Column:
    return F.concat(take(a, lo), b, skip(a, hi))


def repeat_sequence(a: Column, n) -> Column:
    return F.flatten(F.array_repeat(a, _n(n)))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def joined(a: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), sep)


def stepped(a: Column, lo: int | None = None, hi: int | None = None, step: int = 1) -> Column:
    """``a[lo:hi:step]`` with negative bounds from the end, clipped, and negative steps; a step of zero is refused."""
    if step == 0:
        raise ValueError("a step of zero is refused")
    n = F.size(a)
    at = lambda x, d, least, most: d if x is None else F.least(F.greatest(F.lit(x) if x >= 0 else n + x, least), most)
    if step > 0:
        start, end = at(lo, F.lit(0), F.lit(0), n), at(hi, n, F.lit(0), n)
        many = F.ceil(F.greatest(end - start, F.lit(0)) / step)
    else:
        start, end = at(lo, n - 1, F.lit(-1), n - 1), at(hi, F.lit(-1), F.lit(-1), n - 1)
        many = F.ceil(F.greatest(start - end, F.lit(0)) / -step)
    return F.transform(indices(many.cast("int")), lambda i: F.get(a, (start + i * step).cast("int")))


def unpack(a: Column, before: int, after: int) -> Column:
    """``x, .., *rest, .., z``: the first ones, the rest and the last ones; null where there are too few."""
    enough = F.size(a) >= before + after
    return F.when(enough, F.struct(F.slice(a, 1, before).alias("first"), F.slice(a, F.lit(before + 1), F.size(a) - before - after).alias("rest"), F.slice(a, F.size(a) - after + 1, F.lit(after)).alias("last")))


def insert(a: Column, i: int, x: Column) -> Column:
    """Before position ``i``, which is clipped."""
    at = F.least(F.lit(i), F.size(a)) if i >= 0 else F.greatest(F.size(a) + i, F.lit(0))
    return F.concat(F.slice(a, F.lit(1), at), F.array(x), F.slice(a, at + 1, F.size(a)))


def pop(a: Column, i: int = -1) -> Column:
    """The element at ``i`` and the rest; null out of range."""
    at = F.lit(i) if i >= 0 else F.size(a) + i
    ok = (at >= 0) & (at < F.size(a))
    return F.when(ok, F.struct(F.get(a, at).alias("value"), F.concat(F.slice(a, F.lit(1), at), F.slice(a, at + 2, F.size(a))).alias("rest")))


def set_item(a: Column, i: int, x: Column) -> Column:
    """Null out of range."""
    at = F.lit(i) if i >= 0 else F.size(a) + i
    return F.when((at >= 0) & (at < F.size(a)), F.transform(a, lambda v, k: F.when(k == at, x).otherwise(v)))


def intersperse_concat(arrays: Column, sep: Column) -> Column:
    """The elements of all sequences with those of ``sep`` between them."""
    return F.flatten(F.transform(arrays, lambda x, i: F.when(i == 0, x).otherwise(F.concat(sep, x))))
