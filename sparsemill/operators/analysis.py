"""Post-processing of benchmark measurements.

Measurements have noise_level, method, iteration and time_ms. No operator gathers a group: order statistics come from refined
histograms, ranks from a range sort, tests from sums, and resampling from mergeable sums of hashed weights.
Null and NaN times are no measurements where ranks are needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsemill.functions import resampling as rs
from sparsemill.functions import statistics as st
from sparsemill.functions.normal import normal_quantile
from sparsemill.functions.prefix import scan
from sparsemill.functions.selection import key_of, quantiles, real, tie_ranks

MB = 1024**2


def measurements_union(frames: list[DataFrame]) -> DataFrame:
    """All frames with the same leading columns, sorted by noise level and iteration."""
    both = reduce(lambda a, b: a.unionByName(b), frames)
    return both.select("noise_level", "iteration", "time_ms", *(c for c in both.columns if c not in ("noise_level", "iteration", "time_ms"))).orderBy("noise_level", "iteration")


def without_warmup(df: DataFrame) -> DataFrame:
    """The first iteration warms up and is not counted."""
    return df.where("iteration > 0")


def runtime_summary(df: DataFrame, *by: str) -> DataFrame:
    """count, mean, sample deviation, min, max."""
    return df.groupBy(*by).agg(F.count("time_ms").alias("count"), F.avg("time_ms").alias("mean"), F.stddev_samp("time_ms").alias("std"), F.min("time_ms").alias("min"), F.max("time_ms").alias("max"))


def print_stats(df: DataFrame, *by: str) -> DataFrame:
    """mean, population deviation, min, max, the warm-up included."""
    return df.groupBy(*by).agg(F.avg("time_ms").alias("mean"), F.stddev_pop("time_ms").alias("std"), F.min("time_ms").alias("min"), F.max("time_ms").alias("max"))


def runtime_comparison(baseline: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Mean times by noise level, also where one of the two has none, with the speed-up."""
    mean = lambda df, name: df.groupBy("noise_level").agg(F.avg("time_ms").alias(name))
    both = mean(baseline, "baseline_mean_ms").join(mean(hybrid, "hybrid_mean_ms"), "noise_level", "full")
    b, h = F.col("baseline_mean_ms"), F.col("hybrid_mean_ms")
    return both.select("noise_level", b, h, F.try_divide(b, h).alias("speedup"), (F.try_divide(b - h, b) * 100).alias("hybrid_faster_by_percent"))


def speedup_extremes(comparison: DataFrame) -> DataFrame:
    return comparison.agg(F.avg("speedup").alias("avg_speedup"), F.max("speedup").alias("max_speedup"), F.min("speedup").alias("min_speedup"))


def quartiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, median and exact 25th and 75th percentiles (linear between values)."""
    return quantiles(df, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}, *by)


def to_megabytes(df: DataFrame) -> DataFrame:
    """Each *_cost_bytes column also as *_storage_mb."""
    names = [c.removesuffix("_cost_bytes") for c in df.columns if c.endswith("_cost_bytes")]
    return df.select("*", *((F.col(f"{n}_cost_bytes") / MB).alias(f"{n}_storage_mb") for n in names))


def best_threshold(costs: DataFrame) -> DataFrame:
    """noise, threshold, cost of the cheapest threshold; ties to the lowest."""
    best = costs.groupBy("noise").agg(F.min(F.struct("cost", "threshold")).alias("b"))
    return best.select("noise", F.col("b.threshold").alias("threshold"), F.col("b.cost").alias("cost"))


def percent_label(noise: Column) -> Column:
    """A noise level as an axis label: per cent, with digits only for the two finest levels."""
    scaled = noise * 100
    return F.when(noise == 0.0001, F.format_string("%.2f%%", scaled)).when(noise == 0.001, F.format_string("%.1f%%", scaled)).otherwise(F.format_string("%.0f%%", scaled))


def cohens_d(df: DataFrame, first: str, second: str, *by: str) -> DataFrame:
    """The effect's size between two methods and its label, without leaving the JVM."""
    of = lambda f, m: f(F.when(F.col("method") == m, F.col("time_ms")))
    sums = df.groupBy(*by).agg(*(of(f, m).alias(f"{n}{k}") for k, m in enumerate((first, second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    n0, n1, v0, v1 = (F.col(c) for c in ("n0", "n1", "v0", "v1"))
    pooled = F.sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2))
    both = sums.where("n0 > 1 and n1 > 1").select(*by, F.try_divide(F.col("m0") - F.col("m1"), pooled).alias("cohens_d"))
    d = F.abs("cohens_d")
    return both.withColumn("effect_size", F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").otherwise("large"))


def parametric_ci(df: DataFrame, *by: str, level: float = 0.95, normal_from: int | None = None) -> DataFrame:
    """mean, ci_low, ci_high by Student's t (by the normal from normal_from values on)."""
    sums = df.groupBy(*by).agg(F.count("time_ms").alias("n"), F.avg("time_ms").alias("mean"), F.stddev_samp("time_ms").alias("s"))

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = (1 + level) / 2
        for f in frames:
            q = [np.nan if n < 2 else st.normal_quantile(p) if normal_from and n >= normal_from else st.t_quantile(p, n - 1) for n in f["n"]]
            margin = np.array(q, dtype=float) * f["s"].astype(float) / np.sqrt(f["n"])
            yield f.drop(columns="s").assign(ci_low=f["mean"] - margin, ci_high=f["mean"] + margin)

    fields = ", ".join(f"{c} {t}" for c, t in sums.dtypes if c != "s")
    return sums.mapInPandas(add, f"{fields}, ci_low double, ci_high double")


def _interval(value: Column, level: float) -> list[Column]:
    """ci_low, ci_high of one value a resample: a group of bounded size."""
    ends = F.percentile(value, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return [ends[0].alias("ci_low"), ends[1].alias("ci_high")]


def bootstrap_ci(df: DataFrame, *by: str, statistic: str = "median", resamples: int = rs.RESAMPLES, level: float = 0.95, seed: int = rs.SEED) -> DataFrame:
    """The statistic (mean or median) with its percentile bootstrap interval, from hashed Poisson weights."""
    values = df.where(real(F.col("time_ms"))).select(*by, F.to_json(key_of(by), {"ignoreNullFields": "false"}).alias("g"), F.lit(0).alias("stream"), F.col("time_ms").cast("double").alias("x"))
    rows = rs.ranked(values.select("g", "stream", "x"))
    if statistic == "mean":
        drawn = rs.resampled_sums(rows, resamples=resamples, seed=seed).where("total > 0").select("g", (F.col("weighted") / F.col("total")).alias("y"))
        own = values.groupBy("g", *by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    elif statistic == "median":
        drawn = rs.resampled_medians(rows, resamples=resamples, seed=seed).select("g", F.col("median").alias("y"))
        own = quantiles(values, "x", {"median": 0.5}, "g", *by).drop("mean")
    else:
        raise ValueError(f"no bootstrap of the {statistic}")
    return own.join(drawn.groupBy("g").agg(*_interval(F.col("y"), level)), "g").select(*by, "n", statistic, "ci_low", "ci_high")


#: D'Agostino and Pearson's test, step by step, from a sample's size n (8 at least), skewness g1 and kurtosis g2.
_DAGOSTINO = {
    "y": "g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2)))",
    "beta": "3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))",
    "w2": "sqrt(2 * (beta - 1)) - 1",
    "z1": "asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2)",
    "v": "(g2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))",
    "root": "6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))",
    "a": "6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root)))",
    "z2": "(1 - 2 / (9 * a) - cbrt(try_divide(1 - 2 / a, 1 + v * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a))",
    "p_value": "exp(-(z1 * z1 + z2 * z2) / 2)",
}


def normality(df: DataFrame, *by: str) -> DataFrame:
    """n, p_value of D'Agostino and Pearson's test, and whether the sample passes for normal (never under 8 values or where all are equal).

    The test needs a group's moments alone, so no sample is gathered.
    """
    steps = df.groupBy(*by).agg(F.count("time_ms").alias("_n"), F.skewness("time_ms").alias("g1"), (F.kurtosis("time_ms") + 3).alias("g2")).where("_n > 0")
    steps = steps.withColumn("n", F.greatest("_n", F.lit(8)).cast("double"))
    for name, value in _DAGOSTINO.items():
        steps = steps.withColumn(name, F.expr(value))
    p = F.when(F.col("_n") < 8, None).otherwise(F.col("p_value"))
    return steps.select(*by, F.col("_n").alias("n"), F.coalesce(p, F.lit(float("nan"))).alias("p_value"), F.coalesce(p > 0.05, F.lit(False)).alias("is_normal"))


def shapiro(df: DataFrame, *by: str) -> DataFrame:
    """n, w and p_value of Shapiro and Wilk's test, and is_normal (p of 0.05 or more; w and p are null under 3 values and where all are equal).

    Every value gets its rank in its group by a range sort, and its normal score as a column; the test is a dot product of the
    two and a few sums. The approximation is published for 3 to 5000 values; larger groups get its formula all the same.
    """
    values = df.where(real(F.col("time_ms"))).select(*by, F.col("time_ms").cast("double").alias("x"))
    sizes = values.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop("x").alias("v"))
    ranked = scan(values, {"rank": F.lit(1).cast("long")}, order=("x",), by=by).withColumn("_g", key_of(by))
    joined = ranked.join(sizes.select(key_of(by).alias("_g"), "n", "v"), "_g")
    score = normal_quantile((F.col("rank") + 0.625) / (F.col("n") + 0.25))
    end = lambda k: F.max(F.when(F.col("rank") == k, F.col("x")))
    sums = joined.withColumn("m", score).groupBy(*by).agg(
        F.max("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("square"), F.sum(F.col("m") * F.col("x")).alias("dot"), (F.max("v") * F.max("n")).alias("deviation"),
        F.array(end(F.lit(0)), F.coalesce(end(F.lit(1)), end(F.lit(0))), F.coalesce(end(F.col("n") - 2), end(F.col("n") - 1)), end(F.col("n") - 1)).alias("ends"),
    )

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [st.shapiro(*r) for r in f[["n", "square", "dot", "deviation", "ends"]].itertuples(index=False)]
            yield f[[*by, "n"]].assign(w=[w for w, _ in found], p_value=[p for _, p in found], is_normal=[p >= 0.05 for _, p in found])

    kinds = dict(df.dtypes)
    return sums.mapInPandas(finish, ", ".join([*(f"{c} {kinds[c]}" for c in by), "n long", "w double", "p_value double", "is_normal boolean"]))


def location_measure(tests: DataFrame) -> DataFrame:
    """One row: mean if every group passes for normal, else median for all."""
    return tests.agg(F.when(F.coalesce(F.bool_and("is_normal"), F.lit(False)), "mean").otherwise("median").alias("measure"))


def compare_methods(df: DataFrame, first: str, second: str, *by: str) -> DataFrame:
    """The test of two methods' times that suits their distributions, of groups with two values of each at least.

    Levene's test takes medians by refined histograms and the sums of deviations from them; Mann and Whitney's takes mid-ranks over both methods
    together, from a range sort of distinct values. A group's sums make one row, and the tests are made from those.
    """
    values = df.where(real(F.col("time_ms")) & F.col("method").isin(first, second)).select(*by, key_of(by).alias("_g"), (F.col("method") == first).alias("_a"), F.col("time_ms").cast("double").alias("x"))
    of = lambda f, a, c: f(F.when(F.col("_a") == a, F.col(c)))
    moments = lambda c, n: [of(f, a, c).alias(f"{n}{k}{int(not a)}") for a in (True, False) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    sums = values.groupBy("_g", *by).agg(*moments("x", "s")).where("sn0 > 1 and sn1 > 1")
    normal = normality(values.withColumnRenamed("x", "time_ms"), "_g", "_a").groupBy("_g").agg(*(F.bool_or(F.when(F.col("_a") == a, F.isnan("p_value") | (F.col("p_value") > 0.05))).alias(f"normal{int(not a)}") for a in (True, False)))
    centre = quantiles(values, "x", {"centre": 0.5}, "_g", "_a").select("_g", "_a", "centre")
    spread = values.join(centre, ["_g", "_a"]).withColumn("z", F.abs(F.col("x") - F.col("centre"))).groupBy("_g").agg(*moments("z", "z"))
    ties = tie_ranks(values, "x", {"mine": F.col("_a")}, "_g")
    n = F.col("n").cast("double")
    ranks = ties.groupBy("_g").agg(F.sum(F.col("mine") * (F.col("below") + (n + 1) / 2)).alias("ranks"), F.sum(n * n * n - n).alias("ties"))
    joined = sums.join(normal, "_g").join(spread, "_g").join(ranks, "_g").drop("_g")

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = lambda r, c, k: st.Sample(int(r[f"{c}n{k}"]), r[f"{c}m{k}"], r[f"{c}v{k}"])
        for f in frames:
            rows = [st.compare(sample(r, "s", 0), sample(r, "s", 1), [bool(r["normal0"]), bool(r["normal1"])], (sample(r, "z", 0), sample(r, "z", 1)), r["ranks"], r["ties"]) for r in f.to_dict("records")]
            if rows:
                yield pd.concat([f[list(by)].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    kinds = dict(df.dtypes)
    fields = [*(f"{c} {kinds[c]}" for c in by), "test_name string", "test_statistic double", "p_value double", "cohens_d double", "effect_size string", "significant boolean", "a_normal boolean", "b_normal boolean"]
    return joined.mapInPandas(finish, ", ".join(fields))


def speedup_ci(df: DataFrame, first: str, second: str, *by: str) -> DataFrame:
    """Ratio of means with its 95 % interval by the delta method."""
    of = lambda f, m: f(F.when(F.col("method") == m, F.col("time_ms")))
    sums = df.groupBy(*by).agg(*(of(f, m).alias(f"{n}{k}") for k, m in enumerate((first, second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    ratio = F.col("m0") / F.col("m1")
    variance = F.col("v0") / (F.col("n0") * F.pow("m1", F.lit(2))) + F.pow("m0", F.lit(2)) * F.col("v1") / (F.col("n1") * F.pow("m1", F.lit(4)))
    z = F.lit(st.normal_quantile(0.975))
    return sums.where("n0 > 1 and n1 > 1 and m1 != 0").select(*by, ratio.alias("speedup"), (ratio - z * F.sqrt(variance)).alias("ci_low"), (ratio + z * F.sqrt(variance)).alias("ci_high"))


def bootstrap_speedup_ci(df: DataFrame, first: str, second: str, *by: str, resamples: int = rs.RESAMPLES, seed: int = rs.SEED) -> DataFrame:
    """Ratio of means with its 95 % bootstrap interval: both methods are drawn on their own, by hashed Poisson weights."""
    stream = F.when(F.col("method") == first, 0).otherwise(1)
    values = df.where(real(F.col("time_ms")) & F.col("method").isin(first, second)).select(*by, F.to_json(key_of(by), {"ignoreNullFields": "false"}).alias("g"), stream.alias("stream"), F.col("time_ms").cast("double").alias("x"))
    sums = rs.resampled_sums(rs.ranked(values.select("g", "stream", "x")), resamples=resamples, seed=seed)
    mean = lambda k: F.try_divide(F.max(F.when(F.col("stream") == k, F.col("weighted"))), F.max(F.when(F.col("stream") == k, F.col("total"))))
    ratios = sums.groupBy("g", "b").agg(F.try_divide(mean(0), mean(1)).alias("y"))
    of = lambda k: F.avg(F.when(F.col("stream") == k, F.col("x")))
    own = values.groupBy("g", *by).agg(F.try_divide(of(0), of(1)).alias("speedup")).where("speedup is not null")
    return own.join(ratios.groupBy("g").agg(*_interval(F.col("y"), 0.95)), "g").select(*by, "speedup", "ci_low", "ci_high")


def mean_speedup(df: DataFrame, first: str, second: str) -> DataFrame:
    """Ratio of mean times without the warm-up, over the iterations that count."""
    of = lambda m: F.avg(F.when(F.col("method") == m, F.col("time_ms")))
    return without_warmup(df).agg((of(first) / of(second)).alias("speedup"))
