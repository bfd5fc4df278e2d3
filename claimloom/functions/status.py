"""Outcome columns: a value is complete, incomplete (with an effect) or refused; never a silent null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPLETE, INCOMPLETE, REFUSED = "COMPLETE", "INCOMPLETE", "REFUSED"
#: Verdicts of an obligation: the first three of those that are not discharged are hard failures.
DISCHARGED, UNSATISFIED, REFUSED_V, DISAGREEMENT, UNDECIDABLE, TIMEOUT = "Discharged", "Unsatisfied", "Refused", "Disagreement", "Undecidable", "SolverTimeout"
HARD = (UNSATISFIED, REFUSED_V, DISAGREEMENT)
DEFINITIVE = (DISCHARGED, UNSATISFIED)


def outcome(value: Column, refused: Column | None = None, reason: str = "", incomplete: Column | None = None, effect: str = "") -> Column:
    """``struct(status, value, reason)``; a null value without another reason is incomplete."""
    no = F.lit(False)
    refused, incomplete = refused if refused is not None else no, incomplete if incomplete is not None else no
    status = F.when(refused, REFUSED).when(incomplete | value.isNull(), INCOMPLETE).otherwise(COMPLETE)
    why = F.when(refused, F.lit(reason)).when(incomplete, F.lit(effect)).when(value.isNull(), "NoValue").otherwise("")
    return F.struct(status.alias("status"), F.when(status == COMPLETE, value).alias("value"), why.alias("reason"))
