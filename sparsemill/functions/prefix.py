"""Running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsemill.functions.tasks import dealt as deal
from sparsemill.functions.tasks import tasks
from sparsemill.sources.shared import materialise


def running_total(df: DataFrame, key: str, measure: Column, out: str, *, span: int, ties: tuple[str, ...] = (), by: tuple[str, ...] = (), inclusive: bool = False) -> DataFrame:
    """df with out: the sum of measure over the rows before (or up to) each, by key then ties.

    For keys with few rows each: stretches of `span` keys are summed first and their totals accumulated (a few rows); each
    stretch then runs on its own. by: columns that start afresh. Keys must not be negative.
    """
    part, value = F.expr(f"{key} div {span}"), "_value"
    df = df.withColumn("_stretch", part).withColumn(value, measure)
    group = [*by, "_stretch"]
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = df.groupBy(*group).agg(F.sum(value).alias("_t")).select(*group, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    total = F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return df.join(bases, group).withColumn(out, total).drop("_stretch", "_base", value)


def scan(df: DataFrame, measures: dict[str, Column], *, order: tuple[str, ...], by: tuple[str, ...] = (), bound: int | None = None) -> DataFrame:
    """df with a column for each measure: its sum over the rows before, in the order of `order` within `by`.

    Rows are dealt into ranges of (by, order) that Spark samples, so that a task's share is bounded by rows, whatever the keys.
    The ranges are written once, so that sums of ranges and of rows speak of the same; the ranges' totals are accumulated (one row a
    range and group), and each range then runs on its own. Rows equal in order follow one another in any order. Groups may be null.
    bound: a number that the rows do not exceed; more rows get more ranges.
    """
    spark = df.sparkSession
    parts = tasks(spark, bound)
    values = {out: f"_{out}_value" for out in measures}
    group = F.struct(*by) if by else F.struct(F.lit(0))
    dealt = df.withColumns({values[out]: m for out, m in measures.items()}).repartitionByRange(parts, *by, *order)
    dealt = materialise(dealt.withColumns({"_group": group, "_range": F.spark_partition_id()}), "ranges")
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_group", "_range").agg(*(F.sum(v).alias(v) for v in values.values()))
    zero = lambda c: F.coalesce(c, F.lit(0))
    bases = sums.select("_group", "_range", *(zero(F.sum(v).over(before)).alias(f"{v}_base") for v in values.values()))
    inside = Window.partitionBy("_group", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = {out: F.col(f"{v}_base") + zero(F.sum(v).over(inside)) for out, v in values.items()}
    return deal(dealt, bound, "_group", "_range").join(bases, ["_group", "_range"]).select(*df.columns, *(t.alias(out) for out, t in totals.items()))
