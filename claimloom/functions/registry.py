"""Operators that can be plugged in: each recognises a shape and builds a Column; claims of precedence order them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Operator:
    name: str
    recognize: Callable[[dict], bool]
    desugar: Callable[[dict, Callable[[dict], Column]], Column]
    before: tuple[str, ...] = ()
    good: str = ""  # a witness that holds, and one that does not
    bad: str = ""
    tree: dict | None = None  # a shape of its own, and SQL expressions that it must and must not equal
    equal: str = ""
    unequal: str = ""

    @property
    def cid(self) -> str:
        return hashlib.sha256("\x1f".join([self.name, *sorted(self.before), self.good, self.bad]).encode()).hexdigest()


class Registry:
    """A roster of operators, one for each name and id; the order follows their ``before`` claims, then their names."""

    def __init__(self):
        self.operators: dict[str, Operator] = {}

    def add(self, op: Operator) -> None:
        if not op.good or not op.bad:
            raise ValueError(f"{op.name}: an operator needs a good and a bad witness")
        if op.name in self.operators or op.cid in {o.cid for o in self.operators.values()}:
            raise ValueError(f"{op.name}: registered already")
        self.operators[op.name] = op

    def ordered(self) -> list[Operator]:
        left, out = dict(sorted(self.operators.items())), []
        while left:
            free = [n for n in left if not any(n in o.before for m, o in left.items() if m != n)]
            if not free:
                raise ValueError("claims of precedence form a cycle")
            out.append(left.pop(free[0]))
        return out

    def build(self, node: dict) -> Column:
        """The Column of a tree by the first operator that recognises each node; a node that none does is an error."""
        for op in self.ordered():
            if op.recognize(node):
                return op.desugar(node, self.build)
        raise ValueError(f"no operator for {node.get('kind')}")

    def witnesses(self, rows: DataFrame) -> DataFrame:
        """``name, rows, good, bad``: on how many of ``rows`` each operator's own shape gives what it must, and what it must not.

        The good and the bad witness in words are expressions too, and count as a row that holds or fails everywhere.
        """
        out = None
        for op in self.ordered():
            value = op.desugar(op.tree, self.build)
            good = value.eqNullSafe(F.expr(op.equal)) & F.expr(op.good)
            bad = value.eqNullSafe(F.expr(op.unequal)) | F.expr(op.bad)
            one = rows.agg(F.count("*").alias("rows"), F.count_if(good).alias("good"), F.count_if(bad).alias("bad")).select(F.lit(op.name).alias("name"), "rows", "good", "bad")
            out = one if out is None else out.unionByName(one)
        return out

    def roster(self) -> list[tuple[str, str, int]]:
        return [(o.name, o.cid, i) for i, o in enumerate(self.ordered())]
