"""Column expressions that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of ``result``: susceptible, intermediate, resistant.
RESULTS = ("S", "I", "R")


def n_of(result: str) -> Column:
    """How many rows have this result."""
    return F.count_if(F.col("result") == result)


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    """100 * part / whole, null for an empty whole; rounded half up if digits are given."""
    value = F.try_divide(F.lit(100.0) * part, whole)
    return value if digits is None else F.round(value, digits)


def ladder(value: Column, steps: list[tuple[float, object]], otherwise: object, strict: bool = True) -> Column:
    """The label of the first step that the value is above (or, not strict, reaches)."""
    out = None
    for limit, label in steps:
        hit = value > limit if strict else value >= limit
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def has(col: str, *parts: str) -> Column:
    """Whether the text contains one of the parts, whatever their case; false for null."""
    low = F.lower(F.col(col))
    out = F.lit(False)
    for p in parts:
        out = out | low.contains(p.lower())
    return F.coalesce(out, F.lit(False))


def number(col: str) -> Column:
    """A double from text, null where it is none; NaN counts as null (Spark ranks NaN above every number)."""
    v = F.col(col).try_cast("double")
    return F.when(F.isnan(v), None).otherwise(v)
