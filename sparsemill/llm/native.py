"""DataFrame-only helpers: stable hashes that SQL engines share, and two-level running sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsemill.llm.common import WORD, free_name

#: Rows that one group of a running sum sorts together.
RUN_ROWS = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_number(text: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a long (null: of the empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def running_sum(df: DataFrame, key: str, order: str, measure: str, out: str, rows: int, ties: list[str], total: dict[str, str] | None = None) -> DataFrame:
    """df with out: the sum of measure over the rows before it within its key, in the order of `order`.

    order holds 60-bit numbers that are spread evenly. Each key is cut into ranges of order of
    about RUN_ROWS rows; range totals are summed first, then each range is summed on its own, so that
    no key, however hot, is sorted in one task. key must not be null. Rows equal in order and
    ties follow one another in any order.
    """
    bits = max(0, min(40, math.ceil(math.log2(max(1, rows / RUN_ROWS)))))
    part, base = free_name(df, "_part"), free_name(df, "_base")
    df = df.withColumn(part, F.shiftright(F.col(order), 60 - bits) if bits else F.lit(0).cast("long"))
    sums = df.groupBy(key, part).agg(F.sum(measure).alias("_sum"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(key, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(key, part).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out_df = df.join(bases, [key, part]).withColumn(out, F.col(base) + F.coalesce(F.sum(measure).over(inside), F.lit(0)))
    return out_df.drop(part, base)
