"""Mappings, early failure, membership, equality facts, character ranges and JSON tests as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def merge(d, e) -> Column:
    """``d | e``: a key of both has the value of ``e``."""
    d, e = _c(d), _c(e)
    return F.map_concat(F.map_filter(d, lambda k, v: ~F.map_contains_key(e, k)), e)


def set_default(d, key: Column, value: Column) -> Column:
    d = _c(d)
    return F.when(F.map_contains_key(d, key), d).otherwise(F.map_concat(F.map_filter(d, lambda k, v: k != key), F.create_map(key, value)))


def pop(d, key: Column) -> Column:
    """The removed value (null where the key is absent) and the rest."""
    d = _c(d)
    return F.struct(F.try_element_at(d, key).alias("value"), F.map_filter(d, lambda k, v: k != key).alias("rest"))


def set_item(d, key: Column, value: Column) -> Column:
    d = _c(d)
    return F.map_concat(F.map_filter(d, lambda k, v: k != key), F.create_map(key, value))


def pop_item(d) -> Column:
    """The entry inserted last and the rest; null for an empty mapping."""
    d = _c(d)
    last = F.element_at(F.map_entries(d), -1)
    return F.when(F.size(d) > 0, F.struct(last["key"].alias("key"), last["value"].alias("value"), F.map_filter(d, lambda k, v: k != last["key"]).alias("rest")))


def map_text(d) -> Column:
    entries = F.array_sort(F.map_entries(_c(d)))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def try_map(a: Column, f: Fn) -> Column:
    """``err``: the index of the first element for which ``f`` is null; else ``ok``: all results."""
    made = F.transform(a, f)
    at = F.array_position(F.transform(made, lambda x: x.isNull()), F.lit(True))
    return F.struct(F.when(at == 0, made).alias("ok"), F.when(at > 0, at - 1).alias("err"))


def try_from_fn(n: int, f: Fn) -> Column:
    """An array of ``n`` elements from their indexes, with the first failure."""
    return try_map(F.array(*[F.lit(i) for i in range(n)]), f)


def outcome_text(o: Column) -> Column:
    return F.when(o["err"].isNotNull(), F.concat(F.lit("err:"), o["err"])).otherwise(F.concat(F.lit("ok:"), F.array_join(o["ok"].cast("array<string>"), ",")))


def transpose(some: Column, ok: Column, value: Column) -> Column:
    """An optional result as a result of an option: no value is a success without a value."""
    return F.when(~some, "ok:none").when(ok, F.concat(F.lit("ok:some:"), value)).otherwise(F.concat(F.lit("err:"), value))


def membership(a: Column, x: Column) -> Column:
    """``in``; else ``undecided`` where an element is unknown; else ``out``."""
    return F.when(F.coalesce(F.array_contains(a, x), F.lit(False)), "in").when(F.exists(a, lambda v: v.isNull()), "undecided").otherwise("out")


def equality_facts(a: Column, b: Column) -> Column:
    """Array equality as facts ``pos, holds``: -1 for the lengths, then one for each position of both."""
    both = F.transform(a, lambda x, i: F.struct(i.alias("pos"), x.eqNullSafe(F.get(b, i)).alias("holds")))
    return F.concat(F.array(F.struct(F.lit(-1).alias("pos"), (F.size(a) == F.size(b)).alias("holds"))), F.slice(both, F.lit(1), F.least(F.size(a), F.size(b))))


def char_range(lo: Column, hi: Column) -> Column:
    """The scalar values of ``lo..hi`` (end exclusive) as text, without surrogates."""
    codes = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
    scalar = F.filter(codes, lambda c: (c < 0xD800) | (c > 0xDFFF))
    return F.array_join(F.transform(scalar, lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")), "")


def json_valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def json_type(text: Column) -> Column:
    """object, array, or the SQL type of a scalar; null for invalid text."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise(F.lower(kind))
