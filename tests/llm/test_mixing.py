import random

import pytest
from pyspark.sql import functions as F

from sparsemill.llm import mixing, native


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by the rounds of the definition."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(make, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(30))), None, rng.choice(["a", "b", "B", "é", None, "z"][: 2 + 2 * seed])) for i in range(400)]
    got = mixing.mix(make(rows)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = filled(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and len(r["positions"]) * r["size"] == r["taken"]
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 30
    assert len(got) == 400
    again = mixing.mix(make(rows[::-1])).collect()
    assert sorted(map(repr, ((r["doc_id"], r["taken"], r["positions"]) for r in again))) == sorted(map(repr, ((r["doc_id"], r["taken"], r["positions"]) for r in got)))
    order = [r["position"] for r in mixing.in_training_order(mixing.mix(make(rows))).collect()]
    assert order == sorted(order) and len(order) == sum(len(r["positions"]) for r in got)


def test_schedule(spark):
    """Inverting the integral of a weight gives the time back."""
    for knots in mixing.SCHEDULES:
        def integral(t, knots=knots):
            out = 0.0
            for (a, v), (b, w) in zip(knots, knots[1:]):
                x = min(max(t - a, 0), b - a)
                out += v * x + (w - v) / (b - a) * x * x / 2
            return out

        ts = [k / 20 for k in range(21)]
        df = spark.createDataFrame([(t, integral(t) / integral(1.0)) for t in ts], "t double, y double")
        assert all(abs(r["t"] - r["x"]) < 1e-9 for r in df.withColumn("x", mixing.invert_demand(F.col("y"), knots)).collect())


def test_odd_rows(make, odd):
    got = mixing.mix(make(odd)).collect()
    assert len(got) == len(odd) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(make([])).count() == 0
    assert [(r["target"], r["taken"]) for r in mixing.mix(make([(1, None), (2, "")])).collect()] == [(0, 0)] * 2


def test_running_sum_over_many_ranges(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("k"), F.col("id").alias("i"), native.md5_number(F.col("id").cast("string")).alias("o"), (F.col("id") % 7).alias("v"))
    got = native.running_sum(df, "k", "o", "v", "s", 3000, ["i"]).collect()
    for key in ("hot", "cold"):
        total = 0
        for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["o"]):
            assert r["s"] == total
            total += r["v"]


def test_query_has_sql(spark):
    import duckdb

    from tests.conftest import SF

    got = mixing.op9_curriculum_mix(spark, SF).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(mixing.OP9_SQL).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (x.sort_values("doc_id").reset_index(drop=True)[sorted(x.columns)] for x in (got, want))
    assert got.equals(want)
