import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsemill.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    v = {}
    out = {}
    good = []
    for i, x, *_ in rows:
        if i is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        good.append((i, [int(np.floor(256 * float(np.float32(c)))) for c in x]))
    for i, x in sorted(good):
        if i % every == 0:
            v.setdefault(i, x)
    for q, x in v.items():
        s = {(-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q}
        out[q] = [(i, -s) for s, i in sorted(s)[:k]]
    return out


def check(spark, rows, every=5, k=3, **kw):
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("_id") % every == 0, k=k, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == {q: x for q, x in brute(rows, every, k).items() if x}


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 8)) * rng.exponential(size=(300, 1)) * (1 if seed else 0.01)
    rows = [(int(i), [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]
    check(spark, rows, query_block=17, seeds=20)


def test_ties_copies_and_odd_rows(spark):
    same = [0.5, -0.25, 1.0]
    rows = [(i, same, 0) for i in range(40)] + [(7, same, 0), (10, same, 1), (10, [9.0, 9.0, 9.0], 1), (None, same, 0), (50, None, 0), (55, [1.0, None, 2.0], 0), (60, [float("nan"), 1.0, 1.0], 0), (65, [float("inf"), 0.0, 0.0], 0), (70, [], 0), (71, [2.0], 0), (75, [0.0, 0.0, 0.0], 0)]
    check(spark, rows)


def test_few_and_none(spark):
    check(spark, [(0, [1.0, 2.0], 0), (1, [3.0, 4.0], 0)], k=5)
    check(spark, [(1, [1.0], 0)])
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("_id") % 5 == 0).count() == 0


def test_bounds_prune():
    """Short vectors are not scored once long ones fill the places."""
    rng = np.random.default_rng(5)
    x = np.sort(np.abs(rng.normal(size=20_000)))[::-1, None] * rng.normal(size=(20_000, 16))
    x = np.floor(256 * x)
    x = x[np.argsort(-(x * x).sum(axis=1))]
    _, basis = np.linalg.eigh(x.T @ x)
    block = topk._Block(np.arange(50), x[::400].copy(), basis[:, ::-1].copy(), 12, 5)
    block.run(np.arange(50, 20_050), x)
    assert block.exact < 0.25 * 50 * 20_000


def test_scores_beyond_doubles_are_exact(spark):
    """Components of 30 and more bits: sums of products round in doubles, and scores that differ by 1 change places."""
    rng = random.Random(6)
    rows = [(i, [rng.randrange(1 << 30) / 256 for _ in range(4)], 0) for i in range(60)]
    wide = "vec_id long, embedding array<double>, label int"
    got = topk.top_k(spark.createDataFrame(rows, wide), F.col("_id") % 5 == 0, k=4).collect()
    v = {i: [int(c * 256) for c in x] for i, x, _ in rows}
    assert max(sum(c * c for c in x) for x in v.values()) > 1 << 60
    for q in range(0, 60, 5):
        want = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:4]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in want]
    with pytest.raises(Exception, match="OverflowError|too large|too big"):
        topk.top_k(spark.createDataFrame([(0, [1e17], 0), (1, [1e17], 0)], wide), F.col("_id") == 0).collect()


def test_runs_that_cannot_reach_are_not_rotated():
    rng = np.random.default_rng(7)
    x = np.floor(np.sort(rng.exponential(size=50_000))[::-1, None] ** 3 * rng.normal(size=(50_000, 8)) * 256)
    x = x[np.argsort(-(x * x).sum(axis=1))]
    block = topk._Block(np.arange(20), x[:20].copy(), np.eye(8), 4, 5)
    block.run(np.arange(100, 50_100), x)
    assert block.rotated < 10_000 and block.reach() > 0
