"""Small column helpers shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: Column | float | int) -> Column:
    """A column, or a Python number as a double literal."""
    return c if isinstance(c, Column) else F.lit(float(c))


def clip(c: Column, low: float, high: float) -> Column:
    """Bounded value; null stays null, which least and greatest alone would hide."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def round_at(c: Column, digits: int) -> Column:
    """Round half up with plain double arithmetic, so every engine gives the same digits."""
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def fixed(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded on the exact binary value."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", c, F.lit(pattern))


def first_of(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule whose condition holds."""
    (cond, value), *rest = rules
    chain = F.when(cond, value)
    for cond, value in rest:
        chain = chain.when(cond, value)
    return chain.otherwise(otherwise)


def compact(items: list[Column]) -> Column:
    return F.array_compact(F.array(*items))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def null_safe_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return all_of([left[k].eqNullSafe(right[k]) for k in keys])
