"""Exact order statistics and ranks of all groups at once, without gathering a group.

Nulls and NaN are no values. Groups may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsemill.functions.prefix import scan
from sparsemill.sources.shared import drop, materialise

#: Bins of an interval; rounds after which something is wrong: signs take one, logarithms two, and 52 bits of a double five.
BINS, MOST_ROUNDS = 1 << 12, 20
#: Values of an interval that are numbered in one sort.
FEW = 1 << 12


def real(value: Column) -> Column:
    """Whether a value counts: neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def key_of(by: tuple[str, ...]) -> Column:
    """The group as one column that is never null, so that null groups meet themselves in joins."""
    return F.struct(*by) if by else F.struct(F.lit(0))


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """A number for v in [lo, hi] that never falls as v rises: by sign, by the logarithm where ends are far apart, else linear."""
    most = F.lit(1.7976931348623157e308)
    inf = F.abs(v) > most
    low, high = F.greatest(lo, -most), F.least(hi, most)
    steps = lambda share: F.least(F.floor(share * BINS), F.lit(BINS - 1))
    logs = lambda a, b: F.ln(F.abs(a)) - F.ln(F.abs(b))
    far = F.lit(float(BINS))
    return (
        F.when(inf, F.signum(v) * 2 * BINS)
        .when((low <= 0) & (high >= 0), F.signum(v))
        .when((low > 0) & (high / far > low), steps(logs(v, low) / logs(high, low)))
        .when((high < 0) & (low / far < high), steps(1 - logs(v, high) / logs(low, high)))
        .otherwise(steps((v / 2 - low / 2) / (high / 2 - low / 2)))
    ).cast("long")


def select_ranks(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_g, rank, x): the value of each wanted rank (from 0). values: _g, v; wanted: _g, rank.

    Refined histograms: a rank lies between two values of its group; in each round the values between them are counted in BINS
    bins, for all groups and ranks at once, and the ends move to the least and largest value of the rank's bin, until they
    are equal or have no more than FEW values between them, which are then numbered. A round reads the values once and shuffles
    at most BINS counts a task and interval; nothing is gathered but FEW values of an interval at the end. Bins are by sign, then
    by logarithm, then linear, so rounds are few whatever the values.
    """
    ends = values.groupBy("_g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    bounds = materialise(wanted.join(ends, "_g").select("_g", "rank", "lo", "hi", "n", F.lit(0).cast("long").alias("before")), "bounds")
    wide = (F.col("lo") < F.col("hi")) & (F.col("n") > FEW)
    for _ in range(MOST_ROUNDS):
        if (open_ := bounds.where(wide).drop("n")).isEmpty():
            return _numbered(values, bounds)
        # intervals of a group are equal or apart, so a value is counted once
        inside = _inside(values, open_.select("_g", "lo", "hi"))
        counts = inside.groupBy("_g", "lo", _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = Window.partitionBy("_g", "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        summed = counts.withColumn("under", F.coalesce(F.sum("n").over(before), F.lit(0)))
        found = open_.join(summed, ["_g", "lo"]).where("rank - before >= under and rank - before < under + n")
        moved = found.select("_g", "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), "n", (F.col("before") + F.col("under")).alias("before"))
        last, bounds = bounds, materialise(bounds.where(~wide).unionByName(moved), "bounds")
        drop(last)
    raise RuntimeError("the histograms do not close in on a value")


def _inside(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """Values with the interval of their group that they lie in."""
    return values.join(intervals.distinct(), "_g").where("v >= lo and v <= hi")


def _numbered(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """(_g, rank, x) where an interval has one distinct value, or few values, each of which then gets its rank."""
    few = bounds.where("lo < hi")
    order = Window.partitionBy("_g", "lo").orderBy("v")
    ranked = _inside(values, few.select("_g", "lo", "hi", "before")).select("_g", (F.col("before") + F.row_number().over(order) - 1).alias("rank"), F.col("v").alias("x"))
    return bounds.where("lo >= hi").select("_g", "rank", F.col("lo").alias("x")).unionByName(few.select("_g", "rank").join(ranked, ["_g", "rank"]))


def quantiles(df: DataFrame, value: str, names: dict[str, float], *by: str) -> DataFrame:
    """by, n, mean and a column for each named probability: exact, linear between the two nearest values."""
    values = df.select(*by, key_of(by).alias("_key"), F.col(value).cast("double").alias("_v")).where(real(F.col("_v")))
    sums = materialise(values.groupBy("_key", *by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean")), "sums")
    at = {name: F.lit(p) * (F.col("n") - 1) for name, p in names.items()}
    ranks = F.array_distinct(F.array(*(f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil))))
    chosen = select_ranks(values.select(F.col("_key").alias("_g"), F.col("_v").alias("v")), sums.select(F.col("_key").alias("_g"), F.explode(ranks).alias("rank")))
    each = chosen.groupBy(F.col("_g").alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_x"))  # two ranks a name at most

    def between(x: Column) -> Column:
        low, high = (F.element_at("_x", f(x).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (x - F.floor(x)) * (high - low))

    return sums.join(each, "_key").select(*by, "n", "mean", *(between(x).alias(name) for name, x in at.items()))


def tie_ranks(df: DataFrame, value: str, counts: dict[str, Column], *by: str) -> DataFrame:
    """by, value, n, counts and below, one row for each distinct value of a group: how many rows have it (and how many fulfil each condition), and how many of the group are below it.

    A value's rows have the ranks below + 1 to below + n. Equal values are counted before they are sent.
    """
    seen = df.where(real(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias(value), *(c.alias(k) for k, c in counts.items()))
    ties = seen.groupBy(*by, value).agg(F.count("*").alias("n"), *(F.count_if(F.col(k)).alias(k) for k in counts))
    return scan(ties, {"below": F.col("n")}, order=(value,), by=by)
