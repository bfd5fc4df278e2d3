"""Names of source types as sorts, by rewriting from the inside out: one Column expression, no parser.

Lifetimes, paths and widths are dropped; references, pointers, slices, arrays and tuples become constructors; functions and
traits are opaque.  What is left over after ``depth`` rounds, or was no type, is ``Unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Primitive types and their sorts.
PRIMITIVES = {"Int": "u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize", "Real": "f32 f64", "Bool": "bool", "Char": "char", "Str": "str"}


def _atom(depth: int) -> str:
    """A name with arguments that are atoms, nested ``depth`` times."""
    inner = r"\w+"
    for _ in range(depth):
        inner = rf"\w+(?:<\s*{inner}(?:\s*,\s*{inner})*\s*>)?"
    return inner


_A = _atom(7)
_NO_WORD = r"(?!(?:mut|const|dyn|impl|fn)\b)"
#: Rewritten once, before the rounds.
_FIRST = [(r"'\w+\s*,?\s*", ""), (r"<\s*>", ""), (r"\b\w+\s*::\s*", ""), (r"(?<!\w)_(?!\w)", "Infer"), ("!", "Never")] + [(rf"\b(?:{v.replace(' ', '|')})\b", k) for k, v in PRIMITIVES.items()]
_ROUND = [
    (rf"\bfn\s*\((?:\s*{_A}\s*,?)*\)(?:\s*->\s*{_A})?", "FnPtr"),
    (rf"\bFnPtr\s*->\s*{_A}", "FnPtr"),
    (r"(?<!fn)(?<!fn )\(\s*\)", "Unit"),
    (rf"\b(?:impl|dyn)\s+{_A}(?:\s*\+\s*{_A})*", "Opaque"),
    (rf"\[\s*({_A})\s*;[^\[\]]*\]", "Array<$1>"),
    (rf"\[\s*({_A})\s*\]", "Slice<$1>"),
    (rf"&\s*mut\s+{_NO_WORD}({_A})", "RefMut<$1>"),
    (rf"\*\s*mut\s+{_NO_WORD}({_A})", "PtrMut<$1>"),
    (rf"\*\s*const\s+{_NO_WORD}({_A})", "Ptr<$1>"),
    (rf"&\s*{_NO_WORD}({_A})", "Ref<$1>"),
    (rf"(?<!fn)(?<!fn )\(\s*({_A}(?:\s*,\s*{_A})+)\s*,?\s*\)", "Tuple<$1>"),
    (rf"(?<!fn)(?<!fn )\(\s*({_A})\s*,\s*\)", "Tuple<$1>"),
    (rf"(?<!fn)(?<!fn )\(\s*({_A})\s*\)", "$1"),
]


def sort_name(source: Column, depth: int = 6) -> Column:
    """The sort of a type's text; null for null."""
    out = F.trim(source)
    for pattern, by in _FIRST:
        out = F.regexp_replace(out, pattern, by)

    # a round is one step of a fold, so the expression does not grow with depth
    # and a text that is an atom is not looked at again: no pattern of a round applies to one
    def once(text: Column) -> Column:
        new = text
        for pattern, by in _ROUND:
            new = F.regexp_replace(new, pattern, by)
        return F.when(text.rlike(f"^{_A}$"), text).otherwise(new)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), out, lambda text, _: once(text))
    out = F.regexp_replace(out, r"\s*([<>,])\s*", "$1")
    return F.when(source.isNotNull(), F.when(out.rlike(f"^{_A}$"), out).otherwise("Unknown"))


def with_sorts(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with the sort of the type in column ``text`` as ``out``; each distinct text is rewritten once."""
    named = rows.select(text).distinct().select(text, sort_name(F.col(text)).alias(out))
    return rows.join(named, text, "left")
