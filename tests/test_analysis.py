"""Statistics against known values, and the CSV round trip of a benchmark run."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsemill.functions import resampling as rs
from sparsemill.functions import selection
from sparsemill.functions import statistics as st
from sparsemill.functions.normal import normal_quantile
from sparsemill.functions.selection import quantiles, tie_ranks
from sparsemill.operators import analysis as an
from sparsemill.sources import matrix as src
from sparsemill.sources import sinks
from tests import plain_statistics as plain


def test_distributions():
    assert st.t_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-5)
    assert st.t_two_sided(2.262157, 9) == pytest.approx(0.05, abs=1e-6)
    assert st.f_upper(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert st.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)
    assert st.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_plain_tests():
    rng = np.random.default_rng(1)
    a, b = rng.normal(10, 1, 200), rng.normal(11, 1, 200)
    assert plain.normality(a) > 0.01 and plain.normality(rng.exponential(1, 200)) < 1e-6 and math.isnan(plain.normality(a[:7]))
    assert plain.t_test(a, b, True)[1] < 1e-10 and plain.t_test(a, a, False) == (0, 1)
    assert plain.levene(a, 5 * b) < 1e-10 < plain.levene(a, b)
    assert plain.mann_whitney(a, b)[1] < 1e-10 and plain.mann_whitney(np.ones(5), np.ones(5))[1] == 1
    u, p = plain.mann_whitney(np.array([1.0, 2, 3]), np.array([4.0, 5, 6]))
    assert u == 0 and p == pytest.approx(0.0808556, abs=1e-6)
    assert st.effect_label(0.1) == "negligible" and st.effect_label(-0.9) == "large"
    w, p = plain.shapiro(np.array([148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))  # published values for a sample of eleven weights
    assert w == pytest.approx(0.78881, abs=1e-4) and p == pytest.approx(0.006704, abs=1e-5)


SHAPES = "noise_level double, method string, iteration long, time_ms double"


def shaped():
    """Pairs of samples by noise level: equal and unequal variances, other shapes, ties, constants, tiny ones, and a null group."""
    rng = np.random.default_rng(8)
    pairs = {
        0.1: (rng.normal(10, 1, 90), rng.normal(10.4, 1, 70)), 0.2: (rng.normal(10, 1, 60), rng.normal(10, 4, 80)), 0.3: (rng.exponential(2, 120), rng.exponential(2.5, 90)), 0.4: (rng.integers(0, 4, 200), rng.integers(0, 5, 150)),
        0.5: (np.ones(20), np.ones(30)), 0.6: (np.array([1.0, 2]), np.array([2.0, 3, 4])), 0.7: (np.array([1.0]), np.array([2.0, 3])), 0.8: (np.ones(9), 2 * np.ones(9)), None: (rng.normal(5, 1, 30), rng.standard_t(2, 40)),
    }
    return {k: tuple(np.asarray(x, dtype=float) for x in v) for k, v in pairs.items()}


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(level, m, k, float(v)) for level, pair in shaped().items() for m, x in zip("ab", pair) for k, v in enumerate(x)]
    rows += [(0.1, "a", 999, None), (0.1, "b", 999, float("nan")), (0.1, "other", 999, 5.0), (0.9, "a", 1, None)]
    return spark.createDataFrame(rows, SHAPES)


def test_compare_methods(samples):
    got = {r["noise_level"]: r.asDict() for r in an.compare_methods(samples, "a", "b", "noise_level").collect()}
    names = set()
    for level, (a, b) in shaped().items():
        if min(len(a), len(b)) < 2:
            assert level not in got
            continue
        want = plain.compare(a, b)
        names.add(want["test_name"])
        for k, v in want.items():
            assert got[level][k] == (pytest.approx(v, rel=1e-9, abs=1e-12) if isinstance(v, float) else v), (level, k)
    assert names == {"t-test", "Welch's t-test", "Mann-Whitney U"} and 0.9 not in got
    assert an.compare_methods(samples.where("false"), "a", "b", "noise_level").count() == 0
    whole = an.compare_methods(samples.where("noise_level = 0.3D"), "a", "b").first()
    assert whole["p_value"] == pytest.approx(got[0.3]["p_value"])


def test_shapiro(spark, samples):
    got = {(r["noise_level"], r["method"]): r for r in an.shapiro(samples, "noise_level", "method").collect()}
    eleven = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    for level, pair in shaped().items():
        for m, x in zip("ab", pair):
            w, p = plain.shapiro(x)
            r = got[level, m]
            assert r["n"] == len(x), (level, m)
            if math.isnan(w):  # under three values, or all equal
                assert r["w"] is r["p_value"] is None and not r["is_normal"], (level, m)
            else:
                assert r["w"] == pytest.approx(w, rel=1e-9) and r["p_value"] == pytest.approx(p, rel=1e-6, abs=1e-12), (level, m)
    for n in (3, 4, 5, 6, 11):
        r = an.shapiro(spark.createDataFrame([(float(v),) for v in eleven[-n:]], "time_ms double")).first()
        assert (r["w"], r["p_value"]) == pytest.approx(plain.shapiro(np.array(eleven[-n:])), rel=1e-9)
    assert an.shapiro(samples.where("false"), "method").count() == 0


def test_normal_quantile(spark):
    p = [1e-300, 1e-12, 1e-5, 0.01, 0.074, 0.076, 0.3, 0.5, 0.8, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(normal_quantile(F.col("p")).alias("z"), "p").collect()
    for r in got:
        assert r["z"] == pytest.approx(st.normal_quantile(r["p"]), rel=1e-13, abs=1e-15)


@pytest.mark.parametrize("few", [1, 100, selection.FEW])  # by rounds alone, by both, by numbering alone
def test_quantiles_of_any_values(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = np.random.default_rng(4)
    groups = {
        "wide": 10.0 ** rng.uniform(-300, 300, 700), "signs": np.concatenate((-(10.0 ** rng.uniform(-300, 300, 300)), 10.0 ** rng.uniform(-300, 300, 301), np.zeros(50))), "ties": rng.integers(0, 3, 500), "one": [3.5], "two": [-1, 4],
        "close": 1 + np.arange(300) * 2.0**-52, "zeros": [0.0, -0.0, 0.0], "huge": [-1.7e308, 1.7e308, 1.6e308], "negative": -rng.exponential(1, 400), None: rng.normal(size=333),
    }
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("one", None), ("one", float("nan")), ("none", None), ("inf", float("inf")), ("inf", 1.0), ("inf", 2.0), ("inf", float("-inf"))], "g string, v double")
    got = {r["g"]: r for r in quantiles(df, "v", {"low": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p999": 0.999, "high": 1.0}, "g").collect()}
    assert set(got) == {*groups, "inf"} and (got["inf"]["low"], got["inf"]["median"], got["inf"]["high"]) == (float("-inf"), 1.5, float("inf"))
    for g, x in groups.items():
        x = np.sort(np.asarray(x, dtype=float))
        for name, p in (("low", 0.0), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p999", 0.999), ("high", 1.0)):
            at = p * (len(x) - 1)
            lo, hi = x[math.floor(at)], x[math.ceil(at)]
            assert got[g][name] == (lo if lo == hi else lo + (at - math.floor(at)) * (hi - lo)), (g, name)
    assert quantiles(df, "v", {"m": 0.5}).first()["n"] == sum(map(len, groups.values())) + 4
    assert quantiles(df.where("false"), "v", {"m": 0.5}, "g").count() == 0


def test_tie_ranks(spark):
    rows = [(k % 3 if k % 3 else None, float(k * k % 17), k % 2) for k in range(400)] + [(1, None, 1), (1, float("nan"), 1)]
    got = tie_ranks(spark.createDataFrame(rows, "g int, v double, odd int"), "v", {"mine": F.col("odd") == 1}, "g").collect()
    want = {}
    for g, v, odd in rows[:400]:
        own = [r for r in rows[:400] if r[0] == g]
        same = [r for r in own if r[1] == v]
        want[g, v] = (len(same), sum(r[2] for r in same), sum(r[1] < v for r in own))
    assert {(r["g"], r["v"]): (r["n"], r["mine"], r["below"]) for r in got} == want and len(got) == len(want)


# ---------------------------------------------------------------- resampling


def drawn(x, resamples, seed, stream):
    """The resampled sums and medians that hashed weights must give, from whole arrays."""
    x = np.sort(x)
    w = rs.weights(rs.row_hash(np.arange(len(x)), seed), rs.draw_hash(np.arange(resamples), stream)).astype(int)
    return w.sum(axis=0), x @ w, [np.median(np.repeat(x, w[:, b])) if w[:, b].any() else None for b in range(resamples)]


def test_weights_are_poisson():
    w = rs.weights(rs.row_hash(np.arange(3000), 42), rs.draw_hash(np.arange(600), 0))
    share = np.bincount(w.ravel(), minlength=6) / w.size
    assert share[:5] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(5)], abs=2e-3)
    assert abs(np.corrcoef(w[0].astype(float), w[1])[0, 1]) < 0.12 and w.sum(axis=0).std() == pytest.approx(math.sqrt(3000), rel=0.15)
    assert not (w == rs.weights(rs.row_hash(np.arange(3000), 42), rs.draw_hash(np.arange(600), 1))).all()


@pytest.mark.parametrize("wide", [rs.WIDE, 0])
def test_resampling(spark, wide):
    """Weighted sums and medians of every resample; a window of no width finds its medians by widening."""
    groups = {"x": np.random.default_rng(5).exponential(1, 150), "few": np.array([3.0, 1.0]), "one": np.array([7.0]), "ties": np.arange(60) % 4.0}
    df = spark.createDataFrame([(g, 0, float(v)) for g, x in groups.items() for v in x], "g string, stream int, x double")
    rows = rs.ranked(df)
    sums = {(r["g"], r["b"]): r for r in rs.resampled_sums(rows, resamples=700, seed=3).collect()}
    medians = {(r["g"], r["b"]): r["median"] for r in rs.resampled_medians(rows, resamples=700, seed=3, wide=wide or 1).collect()}
    for g, x in groups.items():
        total, weighted, middle = drawn(x, 700, 3, 0)
        for b in range(700):
            assert sums[g, b]["total"] == total[b] and sums[g, b]["weighted"] == pytest.approx(weighted[b])
            assert medians.get((g, b)) == middle[b]


def test_intervals_are_those_of_drawing_whole_samples(spark):
    """Ends within a twelfth of the interval's width of those from drawing n values each time."""
    x = np.random.default_rng(6).exponential(5, 400)
    df = spark.createDataFrame([("m", float(v)) for v in x], "method string, time_ms double")
    for name, f in (("mean", lambda s: s.mean(axis=1)), ("median", lambda s: np.median(s, axis=1))):
        r = an.bootstrap_ci(df, "method", statistic=name, resamples=4000).first()
        lo, hi = plain.bootstrap(x, f, 4000)
        assert r["n"] == 400 and abs(r["ci_low"] - lo) < (hi - lo) / 12 and abs(r["ci_high"] - hi) < (hi - lo) / 12
        assert r[name] == pytest.approx(float(np.mean(x) if name == "mean" else np.median(x)))
    with pytest.raises(ValueError):
        an.bootstrap_ci(df, "method", statistic="mode")
    assert an.bootstrap_ci(df.where("false"), "method").count() == 0


def test_normality_from_moments(spark):
    """Sums over groups say what the whole sample does; small and constant samples never pass."""
    rng = np.random.default_rng(3)
    groups = {"n": rng.normal(5, 2, 60), "e": rng.exponential(1, 60), "few": rng.normal(size=7), "same": np.ones(20), "t": rng.standard_t(3, 300)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("n", None)], "method string, time_ms double")
    for r in an.normality(df, "method").collect():
        want = plain.normality(groups[r["method"]])
        assert r["n"] == len(groups[r["method"]]) and r["is_normal"] == (want > 0.05)
        assert r["p_value"] == pytest.approx(want, rel=1e-9, nan_ok=True)


def test_groups(spark):
    rows = [(0.1, m, i, 10.0 + (m == "b") + 0.1 * (i % 7)) for m in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "noise_level double, method string, iteration long, time_ms double")
    assert an.compare_methods(df, "a", "b", "noise_level").first()["significant"]
    r = an.bootstrap_ci(df, "method", resamples=200).orderBy("method").first()
    assert r["ci_low"] <= r["median"] <= r["ci_high"]
    p = an.parametric_ci(df, "method").orderBy("method").first()
    assert p["ci_low"] < p["mean"] < p["ci_high"] and p["n"] == 40
    s = an.speedup_ci(df, "a", "b").first()
    t = an.bootstrap_speedup_ci(df, "a", "b", "noise_level", resamples=500).first()
    assert s["ci_low"] < s["speedup"] < s["ci_high"] and t["speedup"] == pytest.approx(s["speedup"])
    assert an.location_measure(an.normality(df, "method")).first()["measure"] in ("mean", "median")
    assert an.mean_speedup(df, "a", "b").first()["speedup"] < 1


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, 1.0 + i) for i in range(3)], "iteration int, time_ms double")
    folder = sinks.run_folder("grid", 8, 8, 8, 0.001, dt.datetime(2025, 8, 21, 16, 32, 9, 715000))
    assert folder == "grid_8_8_8_0.001000_20250821_163209_715"
    sinks.save_csv(sinks.hybrid_measurements(df, {"execCOOGPU": True}), str(tmp_path / folder))
    sinks.save_csv(sinks.baseline_measurements(df), str(tmp_path / "other"))
    back = src.read_measurements(spark, str(tmp_path / "*"), "iteration int, time_ms double, " + ", ".join(f"{f} int" for f in sinks.FLAGS))
    assert [(r["iteration"], r["time_ms"], r["noise_level"], r["execCOOGPU"], r["folder"]) for r in back.orderBy("iteration").collect()] == [(i, 1.0 + i, 0.001, 1, folder) for i in range(3)]
