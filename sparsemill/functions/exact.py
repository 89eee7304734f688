"""Sums of doubles that do not depend on the order or the number of tasks.

A sum of doubles depends on its order, which a shuffle does not keep. Here each value is cut into three whole numbers of 30 bits by
its size beside the largest value of all; whole numbers add up to the same in any order, and one row a group puts them together. A value
is exact down to 2^-90 of the largest one, and below that it counts as 0. Groups may have up to 2^32 rows.
NaN and infinite values make the sum of their group what plain addition makes it. Nulls are no values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a limb, and how many there are.
BITS, LIMBS = 30, 3


def largest(df: DataFrame, value: Column) -> float:
    """The largest finite absolute value of a column, 0 if there is none: one row to the driver."""
    v = F.abs(value.cast("double"))
    return df.agg(F.max(F.when(v < float("inf"), v)).alias("m")).first()["m"] or 0.0


def sum_columns(value: Column, most: float, name: str) -> tuple[list[Column], Column]:
    """(aggregates to take, the sum from them) of values whose absolute values are `most` at most."""
    top = math.frexp(most)[1] if most else 0  # values are below 2^top
    v = value.cast("double")
    finite = F.abs(v) < float("inf")
    rest, limbs = F.when(finite, v), []
    for k in range(1, LIMBS + 1):
        unit = top - BITS * k
        scale = lambda c, e: c * F.lit(2.0 ** (e // 2)) * F.lit(2.0 ** (e - e // 2))  # noqa: E731  a power of two may be beyond a double
        whole = F.rint(scale(rest, -unit))
        limbs.append((whole.cast("long"), unit))
        rest = rest - scale(whole, unit)
    aggregates = [F.sum(w).alias(f"_{name}{k}") for k, (w, _) in enumerate(limbs)]
    aggregates.append(F.sum(F.when(~finite | F.isnan(v), v)).alias(f"_{name}_odd"))
    joined = F.lit(None).cast("double")
    for k, (_, unit) in reversed(list(enumerate(limbs))):
        own = scale(F.col(f"_{name}{k}").cast("double"), unit)
        joined = own if k == LIMBS - 1 else joined + own
    return aggregates, F.coalesce(F.col(f"_{name}_odd"), joined)


def repeatable_sums(df: DataFrame, by: list[str | Column], **values: Column) -> DataFrame:
    """df grouped, with the repeatable sum of each value."""
    each = {name: sum_columns(v, largest(df, v), name) for name, v in values.items()}
    grouped = df.groupBy(*by).agg(*(a for aggregates, _ in each.values() for a in aggregates))
    keys = [c for c in grouped.columns if not any(c.startswith(f"_{name}") for name in values)]
    return grouped.select(*keys, *(s.alias(name) for name, (_, s) in each.items()))
