"""The bootstrap as mergeable sums: hashed Poisson weights, so that no group and no resample is ever gathered.

A resample gives each value a weight: how often it is drawn. Weights are Poisson(1) numbers from a hash of the value's rank in its
group and the resample's number, so a task needs its own rows alone, sums of tasks add up, and a recomputed task says
the same. Totals vary by the square root of the group's size, as statistics are ratios of sums they hardly notice: an interval's ends
differ from those of drawing exactly n values by the order of (high - low) / n, besides the noise of resampling itself.

A task holds `resamples` numbers for one group at a time. A resample's median lies within WIDE square roots of n from the
middle rank (ten standard deviations); only the values there are compared with all resamples, in blocks of resamples; groups with a
median elsewhere are done again with a window of twice the width.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsemill.functions.prefix import scan
from sparsemill.sources.shared import materialise

RESAMPLES, SEED = 10_000, 42
#: Resamples of one block of medians, and those that are weighed at once; rows that are weighed at once.
BLOCK, AT_ONCE, ROWS = 500, 16, 64
#: Half the window of ranks in which medians are looked for, in square roots of the group's size.
WIDE = 5
_M = (1 << 32) - 1
_ROW, _HIGH, _SEED, _DRAW, _STREAM = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1
_MIX = ((16, 0x85EBCA6B), (13, 0xC2B2AE35))
#: A weight is the number of these that a 32-bit hash reaches: Poisson's distribution function.
STEPS = [int(2**32 * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(13)]


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in _MIX:
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x ^ (x >> np.uint32(16))


def row_hash(ranks: np.ndarray, seed: int) -> np.ndarray:
    k = ranks.astype(np.uint64)
    return _mix((k * np.uint64(_ROW) + (k >> np.uint64(32)) * np.uint64(_HIGH) + np.uint64(seed * _SEED & _M)).astype(np.uint32))


def draw_hash(draws: np.ndarray, stream: int) -> np.ndarray:
    return _mix((draws.astype(np.uint64) * np.uint64(_DRAW) + np.uint64(stream * _STREAM + 1)).astype(np.uint32))


def weights(rows: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How often each resample draws each row (rows x resamples), from their hashes."""
    h = _mix(rows[:, None] ^ draws[None, :])
    out = (h >= np.uint32(STEPS[0])).astype(np.uint8)
    for step in STEPS[1:]:
        out += h >= np.uint32(step)
    return out


def _sql_mix(x: str, source: str, keep: str) -> str:
    """SELECT keep, h from source, with h the mixed x; for an engine with 64-bit unsigned integers."""
    inner = f"SELECT {keep}, ({x}) % 4294967296::UBIGINT AS h FROM {source}"
    for shift, factor in _MIX:
        inner = f"SELECT {keep}, xor(h, h >> {shift}) * {factor}::UBIGINT % 4294967296::UBIGINT AS h FROM ({inner})"
    return f"SELECT {keep}, xor(h, h >> 16) AS h FROM ({inner})"


def sql_weights(rows: str, keep: str, resamples: int = RESAMPLES, seed: int = SEED) -> str:
    """CTEs hk, hb, hw (keep, b, w) over the rows (keep, k, stream) of another, as an independent engine may state them."""
    u = "::UBIGINT"
    return f"""hk AS ({_sql_mix(f"k{u} % 4294967296{u} * {_ROW}{u} % 4294967296{u} + {seed * _SEED & _M}{u}", rows, keep + ", stream")}),
hb AS ({_sql_mix(f"b{u} * {_DRAW}{u} + s{u} * {_STREAM}{u} + 1{u}", f"(SELECT unnest(range({resamples})) AS b, s FROM (VALUES (0), (1)) v(s))", "b, s")}),
hw AS (SELECT {keep}, b, {" + ".join(f"(h >= {t})::INTEGER" for t in STEPS)} AS w FROM ({_sql_mix("g", f"(SELECT {keep}, b, xor(hk.h, hb.h) AS g FROM hk JOIN hb ON hb.s = hk.stream)", f"{keep}, b")}))"""


def ranked(values: DataFrame) -> DataFrame:
    """values (g, stream, x) with k, the rank within (g, stream) from 0, and n, how many there are."""
    sizes = values.groupBy("g", "stream").agg(F.count("*").alias("n"))
    return materialise(scan(values, {"k": F.lit(1).cast("long")}, order=("x",), by=("g", "stream")).join(sizes, ["g", "stream"]), "ranked")


def _window(wide: int) -> tuple:
    n, root = F.col("n"), F.sqrt(F.col("n").cast("double")) * wide
    return F.greatest(F.lit(0), F.floor(n / 2 - root) - 1).alias("low"), F.least(n, F.ceil(n / 2 + root) + 1).alias("high")


def resampled_sums(rows: DataFrame, *, resamples: int = RESAMPLES, seed: int = SEED, wide: int = WIDE) -> DataFrame:
    """(g, stream, b, total, weighted, below) for b < resamples: sums of weights, of weights x values, and of weights below the window's ranks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, sums = ["g", "stream", "total", "weighted", "below"], None, None

        def done() -> pa.RecordBatch:
            total, weighted, below = (pa.array([v]) for v in sums)
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([held[1]], pa.int32()), total, weighted, below], names=names)

        for b in batches:
            g, stream = b.column("g").to_pylist(), b.column("stream").to_pylist()
            k, x, low = (b.column(c).to_numpy() for c in ("k", "x", "low"))
            cuts = [0, *(i for i in range(1, len(g)) if g[i] != g[i - 1] or stream[i] != stream[i - 1]), len(g)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo and (g[lo], stream[lo]) != held:
                    if held is not None:
                        yield done()
                    held, sums = (g[lo], stream[lo]), (np.zeros(resamples, np.int64), np.zeros(resamples), np.zeros(resamples, np.int64))
                    draws = draw_hash(np.arange(resamples), stream[lo])
                for at in range(lo, hi, ROWS):
                    part = slice(at, min(hi, at + ROWS))
                    w = weights(row_hash(k[part], seed), draws)
                    sums[0][:] += w.sum(axis=0, dtype=np.int64)
                    sums[1][:] += x[part] @ w
                    sums[2][:] += w[k[part] < low[part]].sum(axis=0, dtype=np.int64)
        if held is not None:
            yield done()

    slim = rows.select("g", "stream", "k", "x", _window(wide)[0].cast("long").alias("low"))
    each = slim.mapInArrow(work, "g string, stream int, total array<long>, weighted array<double>, below array<long>")
    every = each.select("g", "stream", F.posexplode(F.arrays_zip("total", "weighted", "below")).alias("b", "s"))
    return every.groupBy("g", "stream", "b").agg(*(F.sum(f"s.{c}").alias(c) for c in ("total", "weighted", "below")))


def resampled_medians(rows: DataFrame, *, resamples: int = RESAMPLES, seed: int = SEED, wide: int = WIDE) -> DataFrame:
    """(g, stream, b, median) of the resamples that draw anything; the middle of the two middle values, as usual."""
    found = None
    for _ in range(64):  # by then a window holds any group
        sums = resampled_sums(rows, resamples=resamples, seed=seed, wide=wide).where("total > 0").withColumn("block", F.expr(f"cast(b div {BLOCK} as int)"))
        low, high = _window(wide)
        near = rows.select("g", "stream", "k", "x", low, high).where("k >= low and k < high")
        spread = near.select("g", "stream", "k", "x", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // BLOCK))).alias("block"))

        def work(values: pa.Table, draws: pa.Table) -> pa.Table:
            b = draws["b"].to_numpy()
            out = np.full(len(b), np.nan)
            if len(b) and values.num_rows:
                order = np.argsort(values["k"].to_numpy())
                k, x = values["k"].to_numpy()[order], values["x"].to_numpy()[order]
                rows_, total, below = row_hash(k, seed), draws["total"].to_numpy(), draws["below"].to_numpy()
                for at in range(0, len(b), AT_ONCE):
                    part = slice(at, at + AT_ONCE)
                    upto = below[part] + np.cumsum(weights(rows_, draw_hash(b[part], draws["stream"][0].as_py())), axis=0, dtype=np.int64)
                    first, last = ((upto <= t).sum(axis=0) for t in ((total[part] - 1) // 2, total[part] // 2))
                    inside = (below[part] <= (total[part] - 1) // 2) & (last < len(k))
                    out[part] = np.where(inside, (x[np.minimum(first, len(k) - 1)] + x[np.minimum(last, len(k) - 1)]) / 2, np.nan)
            return pa.table({"g": draws["g"], "stream": draws["stream"], "b": draws["b"], "median": pa.array(out)})

        keys = ("g", "stream", "block")
        now = materialise(spread.groupBy(*keys).cogroup(sums.groupBy(*keys)).applyInArrow(work, "g string, stream int, b int, median double"), "medians")
        outside = now.where(F.isnan("median")).select("g", "stream").distinct()
        good = now.join(outside, ["g", "stream"], "left_anti")
        found = good if found is None else found.unionByName(good)
        if outside.isEmpty():
            return found
        rows, wide = rows.join(outside, ["g", "stream"], "left_semi"), 2 * wide
    raise RuntimeError("some resample has no median")
