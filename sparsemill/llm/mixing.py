"""Mixing sources to target weights: a time-varying curriculum, in DataFrame operations alone.

Targets. Sources in code-point order (null last) weigh WEIGHTS in turn and share `share` of all
words; a target stops at `most` times its source's words, and the excess goes to the others by weight.
That is the water level of the sorted ratios cap / weight, found with running sums over sources.

Method. A source's documents are laid end to end in a fixed random order (an MD5 of id and text),
again from the start for each further pass. Each source has a weight schedule over training time
[0, 1], piecewise linear; its integral is the source's cumulative demand in words, which reaches the
target at time 1. A document whose middle word lies below the target is taken, and inverting the demand at that
word gives its position in training. Rows are then range-sorted by position.

Offsets within a source are two-level running sums, so a source with a third of all rows is spread
over many tasks. A source's taken words differ from its target by half a document at most.

Defined results: null text has size 0; a document of size 0 is never taken; null sources form one
source; null ids sort first; repeated rows follow one another, each with its own offset; with no words
at all every target is 0; an empty table gives an empty result; other columns are carried along,
columns named like the results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsemill.llm.common import in_struct, load, materialise
from sparsemill.llm.native import md5_number, running_sum, word_count

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Weight over time as (time, weight) knots, for the sources in turn: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
RESULTS = ("size", "source_size", "target", "taken", "positions")


def _in_turn(values: tuple, index: Column) -> Column:
    return reduce(lambda out, k: F.when(index % len(values) == k, F.lit(values[k])).otherwise(out), range(1, len(values)), F.lit(values[0]))


def invert_demand(share: Column, knots: tuple) -> Column:
    """The time at which the integral of a piecewise-linear weight reaches this share of its total."""
    parts, total = [], 0.0
    for (t0, v0), (t1, v1) in zip(knots, knots[1:]):
        parts.append((t0, v0, (v1 - v0) / (t1 - t0), total))
        total += (v0 + v1) / 2 * (t1 - t0)
    out = None
    for t0, v0, slope, begun in parts:
        # begun + v0 x + slope x^2 / 2 = share * total, solved so that slope 0 needs no case of its own
        need = share * F.lit(total) - F.lit(begun)
        x = F.lit(t0) + F.lit(2.0) * need / (F.lit(v0) + F.sqrt(F.greatest(F.lit(v0 * v0) + F.lit(2 * slope) * need, F.lit(0.0))))
        out = x if out is None else F.when(share * F.lit(total) >= F.lit(begun), x).otherwise(out)
    return out


def targets(sizes: DataFrame, *, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(_key, _source, source_size) with _turn and target: one row a source in, one row out."""
    by_name = Window.orderBy(F.col("_source").isNull(), "_source")
    turned = sizes.withColumn("_turn", F.row_number().over(by_name) - 1)
    weighed = turned.withColumn("_w", _in_turn(weights, F.col("_turn")).cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_turn"))
    every, before = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), none)
    levels = weighed.withColumn("_left", left).withColumn("_rest", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), none))
    fits = F.col("_cap") * F.col("_rest") >= F.col("_left") * F.col("_w")
    first = lambda c: F.first(F.when(fits, F.col(c)), ignorenulls=True).over(every)
    found = levels.withColumn("_l", first("_left")).withColumn("_r", first("_rest"))
    return found.select("_key", "source_size", "_turn", F.coalesce(F.least("_cap", F.col("_l") * F.col("_w") / F.col("_r")), F.col("_cap")).alias("target"))


def mix(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE,
    most: int = MOST, schedules: tuple = SCHEDULES, keep_text: bool = True,
) -> DataFrame:
    """One row a document: size, source_size, target, taken and the positions (one for each pass that takes it)."""
    inputs = ("_doc_id", "_doc_text", "_doc_source")
    carried = [c for c in df.columns if (c.lower() not in RESULTS or c in (id_col, text_col, source_col)) and (keep_text or c != text_col)]
    df = df.select(F.col(id_col).alias(inputs[0]), F.col(text_col).alias(inputs[1]), F.col(source_col).alias(inputs[2]), in_struct([c for c in carried if c != text_col]))
    order = md5_number(F.concat_ws(":", F.col(inputs[0]).cast("string"), F.coalesce(inputs[1], F.lit(""))))
    key = F.coalesce(F.concat(F.lit("="), F.col(inputs[2])), F.lit(""))
    sized = df.select("*", key.alias("_key"), word_count(F.col(inputs[1])).alias("size"), order.alias("_order"))
    sized = materialise(sized if keep_text else sized.drop(inputs[1]), "sized")
    rows = sized.count()
    sizes = sized.groupBy("_key").agg(F.min(inputs[2]).alias("_source"), F.sum("size").alias("source_size"))
    aims = targets(sizes, weights=weights, share=share, most=most)
    laid = running_sum(sized, "_key", "_order", "size", "_before", rows, [inputs[0]]).join(aims, "_key")
    middle = lambda k: (F.col("_before") + F.col("source_size") * k) + F.col("size") / F.lit(2.0)
    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(int(most) - 1)), lambda k: middle(k) / F.col("target")), lambda y: (y < 1.0))
    passes = F.when((F.col("size") > 0) & (F.col("target") > 0), passes).otherwise(F.array().cast("array<double>"))

    def place(y: Column) -> Column:
        found = [invert_demand(y, k) for k in schedules]
        return reduce(lambda out, k: F.when(F.col("_turn") % len(found) == k, found[k]).otherwise(out), range(1, len(found)), found[0])

    placed = laid.withColumn("_passes", passes).withColumn("positions", F.transform("_passes", place))
    result = placed.withColumn("taken", F.col("size") * F.size("_passes"))
    return result.select(*((F.col(inputs[1]) if c == text_col else F.col("_rest").getField(c)).alias(c) for c in carried), *RESULTS)


def in_training_order(mixed: DataFrame, position_col: str = "position") -> DataFrame:
    """One row for each time that a document is trained on, range-sorted by position (which replaces a column of that name)."""
    every = mixed.withColumn(position_col, F.explode("positions"))
    return every.repartitionByRange(F.col(position_col)).sortWithinPartitions(position_col)


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, one row each, range-sorted by their first position."""
    mixed = mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    first = F.round(F.get("positions", F.lit(0)), 9).alias("position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first).orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, coalesce(text, ''))), 1, 15))::BIGINT AS o
  FROM documents),
s AS (SELECT k, min(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
t AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn FROM s),
w AS (SELECT *, CASE turn % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM t),
l AS (SELECT *,
  (SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM w),
f AS (SELECT lft, rest FROM l WHERE cap * rest >= lft * w ORDER BY cap / w, turn LIMIT 1),
a AS (SELECT k, source_size, turn, coalesce(least(cap, (SELECT lft FROM f) * w / (SELECT rest FROM f)), cap) AS target FROM l),
b AS (SELECT doc_id, size, source_size, target, turn,
  coalesce(sum(size) OVER (PARTITION BY k ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef FROM d JOIN a USING (k)),
y AS (SELECT *, CASE WHEN size > 0 AND target > 0 THEN (bef + size / 2.0::DOUBLE) / target END AS y0,
             CASE WHEN size > 0 AND target > 0 THEN ((bef + source_size) + size / 2.0::DOUBLE) / target END AS y1 FROM b),
p AS (SELECT *, CASE WHEN y0 < 1.0 THEN 1 ELSE 0 END + CASE WHEN y1 < 1.0 THEN 1 ELSE 0 END AS n FROM y)
SELECT doc_id, size, source_size, target, (size * n)::BIGINT AS taken,
  round(CASE WHEN NOT coalesce(y0 < 1.0, false) THEN NULL
    WHEN turn % 3 = 0 THEN 2.0::DOUBLE * y0 / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2.0::DOUBLE * y0, 0)))
    WHEN turn % 3 = 1 THEN 2.0::DOUBLE * y0 / (1.0::DOUBLE + sqrt(1.0::DOUBLE))
    WHEN y0 * 0.875::DOUBLE >= 0.25::DOUBLE THEN 0.5::DOUBLE + 2.0::DOUBLE * (y0 * 0.875::DOUBLE - 0.25::DOUBLE) / (0.5::DOUBLE + sqrt(greatest(0.25::DOUBLE + 6.0::DOUBLE * (y0 * 0.875::DOUBLE - 0.25::DOUBLE), 0)))
    ELSE 2.0::DOUBLE * (y0 * 0.875::DOUBLE) / (0.5::DOUBLE + sqrt(0.25::DOUBLE)) END, 9) AS position
FROM p"""
