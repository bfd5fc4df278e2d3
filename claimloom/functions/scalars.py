"""Scalar kernel: exact integers, ASCII and Unicode text, durations, options, Python-style arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.status import outcome

_WIDTH = {"i8": 8, "i16": 16, "i32": 32, "i64": 64, "isize": 64, "i128": 128, "u8": 8, "u16": 16, "u32": 32, "u64": 64, "usize": 64, "u128": 128}
_WIDE = "decimal(38,0)"


def bounds(kind: str) -> tuple[int, int]:
    """The least and largest value; those of 128 bits are cut to the 38 digits that a column can hold."""
    bits, top = _WIDTH[kind], 10**38 - 1
    lo, hi = (0, (1 << bits) - 1) if kind[0] == "u" else (-(1 << (bits - 1)), (1 << (bits - 1)) - 1)
    return max(lo, -top), min(hi, top)


def _exact(n: int) -> Column:
    return F.lit(n) if abs(n) < 1 << 31 else F.lit(str(n)).cast(_WIDE)


def wrapping_cast(x: Column, kind: str) -> Column:
    """An integer of up to 64 bits as a fixed-width one (``u64`` and ``usize`` as decimals), by its low bits."""
    bits = _WIDTH[kind]
    if bits > 64:
        raise ValueError("a column holds 38 digits, so 128 bits cannot wrap")
    half = 0 if kind[0] == "u" else 1 << (bits - 1)
    out = F.pmod(x.cast(_WIDE) + _exact(half), _exact(1 << bits).cast(_WIDE)) - _exact(half)
    return out.cast("decimal(20,0)") if kind in ("u64", "usize") else out.cast("long")


def fits(x: Column, kind: str) -> Column:
    lo, hi = bounds(kind)
    return (x >= _exact(lo)) & (x <= _exact(hi))


def checked(op: str, a: Column, b: Column, kind: str = "i64") -> Column:
    """``add sub mul div rem`` as an outcome: out of range (the least value by -1 too) or by zero is refused."""
    wide = lambda c: c.cast(_WIDE)
    if op in ("div", "rem"):
        over = (a == _exact(bounds(kind)[0])) & (b == -1) if kind[0] != "u" else F.lit(False)
        q = F.when((b != 0) & ~over, F.call_function("div", a, b) if op == "div" else a % F.nullif(b, F.lit(0)))
        bad = F.coalesce((b == 0) | over, F.lit(False))
        out = outcome(q.cast("long"), bad, "Overflow")
        return F.when(b == 0, outcome(q.cast("long"), bad, "DivisionByZero")).otherwise(out)
    v = {"add": wide(a) + wide(b), "sub": wide(a) - wide(b), "mul": wide(a) * wide(b)}[op]
    to = _WIDE if _WIDTH[kind] == 128 or kind in ("u64", "usize") else "long"
    return outcome(F.when(fits(v, kind), v.cast(to)), ~fits(v, kind), "Overflow")


def wrapping_neg(x: Column, kind: str = "i32") -> Column:
    return wrapping_cast(-x.cast(_WIDE), kind)


def isqrt(x: Column) -> Column:
    """Null below zero."""
    r = F.floor(F.sqrt(F.when(x >= 0, x).cast("double"))).cast("long")
    square = lambda n: n.cast(_WIDE) * n.cast(_WIDE)
    return F.when(square(r) > x, r - 1).when(square(r + 1) <= x, r + 1).otherwise(r)


def int_pow(x: Column, n: int) -> Column:
    """An exact power as an outcome: beyond 64 bits it is refused."""
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    v = F.aggregate(F.array_repeat(x, n), F.lit(1).cast("decimal(38,0)"), lambda a, y: F.when(F.abs(a) <= top, (a.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast("decimal(38,0)")))
    ok = v.isNotNull() & fits(F.coalesce(v, F.lit(0)), "i64")
    return outcome(F.when(ok, v.cast("long")), ~ok, "Overflow")


def midpoint(a: Column, b: Column) -> Column:
    """Towards zero."""
    return F.call_function("div", a.cast("decimal(38,0)") + b.cast("decimal(38,0)"), F.lit(2))


def nonzero(x: Column) -> Column:
    return F.nullif(x, F.lit(0))


def floor_div(a: Column, b: Column) -> Column:
    """Exact on 64 bits; null by zero, and for the least value by -1, which has no 64-bit result."""
    ok = (b != 0) & ~((b == -1) & (a == _exact(-(1 << 63))))
    low = ((a % F.nullif(b, F.lit(0))) != 0) & ((a < 0) != (b < 0))
    return F.when(ok, F.call_function("div", a, b) - low.cast("long"))


def floor_mod(a: Column, b: Column) -> Column:
    """With the sign of ``b``."""
    r = F.when(b != 0, a % F.nullif(b, F.lit(0)))
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def ascii_upper(s: Column) -> Column:
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_ascii(s: Column) -> Column:
    return F.octet_length(s) == F.char_length(s)


def to_upper(s: Column) -> Column:
    """Case of ASCII texts only; others are incomplete."""
    return outcome(F.when(is_ascii(s), F.upper(s)), incomplete=~is_ascii(s), effect="NonAsciiCase")


_WHITE = r"\p{IsWhite_Space}"


def trim(s: Column, start: bool = True, end: bool = True) -> Column:
    if start:
        s = F.regexp_replace(s, f"^{_WHITE}+", "")
    return F.regexp_replace(s, f"{_WHITE}+$", "") if end else s


def repeat_text(s: Column, n: int, cap: int = 4096) -> Column:
    """Over ``cap`` bytes the result is incomplete."""
    over = F.octet_length(s) * n > cap
    return outcome(F.when(~over, F.repeat(s, n)), incomplete=over, effect="LengthCap")


def to_digit(c: Column, radix: int = 10) -> Column:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    at = F.locate(" ", F.lit("")) + F.instr(F.lit(digits), "0") * 0  # zero, as a column
    return F.nullif(F.call_function("locate", F.substring(ascii_lower(c), 1, 1), F.lit(digits)) + at, F.lit(0)) - 1


def memchr(s: Column, c: str) -> Column:
    """Byte position of an ASCII character, or null."""
    at = F.instr(s, c)
    return F.when(at > 0, F.octet_length(F.substring_index(s, c, 1)))


def memrchr(s: Column, c: str) -> Column:
    return F.when(F.instr(s, c) > 0, F.octet_length(s) - F.octet_length(F.substring_index(s, c, -1)) - 1)


#: Nanoseconds of units.
UNITS = {"nanos": 1, "micros": 10**3, "millis": 10**6, "secs": 10**9, "mins": 60 * 10**9, "hours": 3600 * 10**9, "days": 86400 * 10**9, "weeks": 604800 * 10**9}


def duration(n: Column, unit: str) -> Column:
    return n.cast("decimal(38,0)") * UNITS[unit]


def whole(d: Column, unit: str) -> Column:
    return F.call_function("div", d, F.lit(UNITS[unit]).cast("decimal(38,0)"))


def subsec(d: Column, unit: str) -> Column:
    return F.call_function("div", d % F.lit(10**9).cast("decimal(38,0)"), F.lit(UNITS[unit]).cast("decimal(38,0)"))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def is_normal(x: Column) -> Column:
    return is_finite(x) & (F.abs(x) >= 2.2250738585072014e-308)


def in_normal_range(x: Column) -> Column:
    """A magnitude from 1 to 1e300: that of ``x`` where it lies there, else the nearer end (null: 1, NaN: 1e300)."""
    return F.least(F.greatest(F.abs(x), F.lit(1.0)), F.lit(1e300))


def is_infinite(x: Column) -> Column:
    return F.abs(x) == float("inf")


def is_negative(x: Column) -> Column:
    """By the sign bit: true for -0.0."""
    return (x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-")))


def compute_float(w: Column, q: Column) -> Column:
    """``w * 10 ** q``, rounded once: the nearest double of the decimal text."""
    return F.concat(w.cast("string"), F.lit("e"), q.cast("string")).cast("double")


@F.pandas_udf(T.LongType())
def _bits(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy(np.float64).view(np.int64))


@F.pandas_udf(T.DoubleType())
def _from_bits(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy(np.int64).view(np.float64))


@F.pandas_udf(T.StructType([T.StructField("mantissa", T.LongType()), T.StructField("exponent", T.IntegerType()), T.StructField("sign", T.IntegerType())]))
def _decode(x: pd.Series) -> pd.DataFrame:
    b = x.to_numpy(np.float64).view(np.int64)
    e, m = (b >> 52) & 0x7FF, b & ((1 << 52) - 1)
    return pd.DataFrame({"mantissa": np.where(e == 0, m << 1, m | (1 << 52)), "exponent": (e - 1075).astype(np.int32), "sign": np.where(b < 0, -1, 1).astype(np.int32)})


def float_bits(x: Column) -> Column:
    """IEEE bits of doubles, as a signed long; null for null."""
    return F.when(x.isNotNull(), _bits(F.coalesce(x, F.lit(0.0))))


def from_bits(x: Column) -> Column:
    return F.when(x.isNotNull(), _from_bits(F.coalesce(x, F.lit(0).cast("long"))))


def integer_decode(x: Column) -> Column:
    """Mantissa, exponent and sign of doubles, with value = sign * mantissa * 2 ** exponent; null for null."""
    return F.when(x.isNotNull(), _decode(F.coalesce(x, F.lit(0.0))))


def option(x: Column, default: Column) -> Column:
    return F.coalesce(x, default)


def contains_range(x: Column, lo: Column | None, hi: Column | None, lo_closed: bool = True, hi_closed: bool = False) -> Column:
    ok = F.lit(True)
    if lo is not None:
        ok = ok & ((x >= lo) if lo_closed else (x > lo))
    return ok & ((x <= hi) if hi_closed else (x < hi)) if hi is not None else ok


def bool_select(a: Column, b: Column, truth: Column, both: bool) -> Column:
    """``a and b`` / ``a or b`` as the operand that decides."""
    return F.when(truth, b).otherwise(a) if both else F.when(truth, a).otherwise(b)


def complex_mul(ar, ai, br, bi) -> Column:
    return F.struct((ar * br - ai * bi).alias("re"), (ar * bi + ai * br).alias("im"))


#: Character classes by name, as patterns of one character (fixed values).
CHAR_CLASSES = {"alphabetic": "[\\p{IsAlphabetic}]", "numeric": "[\\p{N}]", "alphanumeric": "[\\p{IsAlphabetic}\\p{N}]", "ascii": "[\\x00-\\x7F]", "whitespace": "[\\p{IsWhite_Space}]", "uppercase": "[\\p{IsUppercase}]", "lowercase": "[\\p{IsLowercase}]"}


def char_is(c: Column, name: str) -> Column:
    """Whether a text of one character is of a class; false for other lengths."""
    return F.rlike(c, F.lit(f"\\A{CHAR_CLASSES[name]}\\z"))


def c_string(s: Column) -> Column:
    """The bytes with a NUL behind them; null where the text holds one."""
    raw = F.encode(s, "UTF-8")
    return F.when(~F.contains(raw, F.lit(b"\0")), F.concat(raw, F.lit(b"\0")))


def byte_at(raw: Column, i) -> Column:
    """A byte as a number, negative positions from the end; null where there is none."""
    at = F.lit(i) if isinstance(i, int) else i
    at = F.when(at < 0, at + F.octet_length(raw)).otherwise(at)
    return F.when((at >= 0) & (at < F.octet_length(raw)), F.conv(F.hex(F.call_function("substring", raw, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int"))
