"""A benchmark run, and a sweep over noise levels and thresholds.

A run builds a matrix, lays it out, times the plain and the hybrid product, compares their results, and saves its
tables as CSV: what was built and the histogram always, the measurements only if the results agree.

    python -m sparsemill.plans.run OUT [nx ny nz threshold noise ... max_coo_entries iteration filename] [--sweep]
"""

from __future__ import annotations

import argparse
import datetime as dt
import pathlib
import time
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsemill.functions.costs import entry_facts, matrix_info
from sparsemill.functions.tasks import dealt
from sparsemill.operators import convert, spmv
from sparsemill.schema import BLOCK_WIDTH, Matrix
from sparsemill.sources import matrix as src
from sparsemill.sources import sinks
from sparsemill.sources.shared import drop_tables, materialise, scope

# fixed values: a run's defaults, a sweep's levels, the accuracy that saves measurements, and the stencil's name
GRID, THRESHOLD, NOISE, ITERATIONS, TOLERANCE, STENCIL = (32, 32, 32), 2, 0.1, 100, 1e-6, "3D27Stencil"
SWEEP_GRID, SWEEP_NOISE, SWEEP_THRESHOLDS = (128, 128, 128), (0.0, 0.0001, 0.001, 0.01, 0.1, 0.2, 0.5, 1.0, 2.0, 3.0), (8,)


@dataclass(frozen=True)
class Config:
    grid: tuple[int, int, int] = GRID
    threshold: int = THRESHOLD
    noise: float = NOISE
    flags: dict[str, bool] = field(default_factory=lambda: {f: f == "execCOOGPU" for f in sinks.FLAGS})
    max_fallback: int | None = None
    iteration: int = 0
    filename: str | None = None
    iterations: int = ITERATIONS
    block_width: int = BLOCK_WIDTH

    @property
    def name(self) -> str:
        return pathlib.PurePath(self.filename).stem if self.filename else STENCIL

    def folder(self, now: dt.datetime) -> str:
        if self.filename:
            return f"{self.name}_{self.noise:.6f}_{now:%Y%m%d_%H%M%S}_{now.microsecond // 1000:03d}"
        return sinks.run_folder(self.name, *self.grid, self.noise, now)


@dataclass(frozen=True)
class Tables:
    """What the runs over one matrix share, as tables: its entries (m), its `grouped` entries, facts that no threshold changes, and heavy columns where products ask for them."""

    m: Matrix
    groups: DataFrame
    facts: DataFrame
    heavy: DataFrame | None
    folders: tuple[str, ...]


def source(spark: SparkSession, c: Config) -> Matrix:
    """The matrix of a run, without repeated cells, its entries as a table."""
    with scope() as made:
        m = src.read_mtx(spark, c.filename) if c.filename else src.stencil27(spark, *c.grid, noise=c.noise, iteration=c.iteration)
        coo = materialise(convert.dedup(dealt(m.coo, m.bound, "row", "col")) if c.filename else m.coo, "entries")
    drop_tables(spark, [t for t in made if t != coo._folder])
    return replace(m, coo=coo)


def prepare(spark: SparkSession, c: Config) -> Tables:
    """The tables of a run, which all runs of a sweep over a file read."""
    m = source(spark, c)
    groups = materialise(convert.grouped(m, c.block_width), "groups")
    facts = materialise(entry_facts(convert.to_hybrid(m, block_width=c.block_width, groups=groups), assume_unique=True), "facts")
    heavy = materialise(spmv.heavy_columns(m.coo), "heavy") if m.num_cols > spmv.BROADCAST_ELEMENTS else None
    return Tables(m, groups, facts, heavy, tuple(t._folder for t in (m.coo, groups, facts, heavy) if t is not None))


def build(c: Config, t: Tables) -> Matrix:
    """The matrix of a run with its hybrid layout."""
    return convert.to_hybrid(t.m, block_width=c.block_width, threshold=c.threshold, max_fallback=c.max_fallback, groups=t.groups)


def timed(product: DataFrame, iterations: int) -> tuple[list[tuple[int, float]], DataFrame]:
    """(iteration, milliseconds) of making a table again and again, and the table: the first one warms up, and is the one that is kept."""
    out, began = [], time.perf_counter()
    made = materialise(product, "product")
    for k in range(iterations):
        if k:
            began = time.perf_counter()
            product.write.format("noop").mode("overwrite").save()
        out.append((k, 1000 * (time.perf_counter() - began)))
    return out, made


def mean_time(measured: list[tuple[int, float]]) -> float | None:
    """Mean time without the first iteration."""
    rest = [ms for _, ms in measured[1:]]
    return sum(rest) / len(rest) if rest else None


def run(spark: SparkSession, c: Config, out: str, now: dt.datetime | None = None, tables: Tables | None = None) -> dict:
    """One run: its folder, sizes, greatest error, whether results agree, mean times and speed-up.

    Entries, layout and vector are kept while products are timed, as a solver would keep them. Each product is made once an iteration.
    """
    own, path = tables is None, f"{out}/{c.folder(now or dt.datetime.now())}"
    t = prepare(spark, c) if own else tables
    m, x = build(c, t), src.ramp(spark, t.m.num_cols).df.persist()
    with scope() as made:
        try:
            plain, hybrid = (spmv.spmv_coo(e.select("row", "col", "val"), x, m.num_rows, size=m.num_cols, heavy=t.heavy, bound=m.bound) for e in (m.coo, m.hybrid.entries))
            nx, ny, nz = (0, 0, 0) if c.filename else c.grid
            sinks.save_csv(matrix_info(m, c.name, nx=nx, ny=ny, nz=nz, noise=c.noise, flags=c.flags, facts=t.facts), f"{path}/matrix_info")
            sinks.save_csv(sinks.histogram_rows(convert.block_histogram(m.hybrid)), f"{path}/histogram")
            (first, y), (second, z) = timed(plain, c.iterations), timed(hybrid, c.iterations)
            found = spmv.compare_vectors(*(v.select("idx", F.col("y").alias("x")) for v in (y, z)), tolerance=TOLERANCE).first()
            passed = found["max_abs_error"] < TOLERANCE
            if passed:
                table = lambda rows: spark.createDataFrame(rows, "iteration int, time_ms double")
                sinks.save_csv(sinks.baseline_measurements(table(first)), f"{path}/baseline")
                sinks.save_csv(sinks.hybrid_measurements(table(second), c.flags), f"{path}/hybrid")
            one, two = mean_time(first), mean_time(second)
            return {"folder": path, "noise": c.noise, "threshold": c.threshold, "max_abs_error": found["max_abs_error"], "mismatches": found["mismatches"], "passed": passed,
                    "baseline_mean_ms": one, "hybrid_mean_ms": two, "speedup": one / two if passed and one and two else None}
        finally:
            x.unpersist()
            drop_tables(spark, [*made, *(t.folders if own else ())])


def sweep(spark: SparkSession, c: Config, out: str, noises: Iterable[float] = SWEEP_NOISE, thresholds: Iterable[int] = SWEEP_THRESHOLDS, repeats: int = 1) -> list[dict]:
    """Runs at every noise level and threshold, and as many iterations of the noise."""
    t = prepare(spark, c) if c.filename else None  # a file is the same at all levels
    try:
        return [run(spark, replace(c, noise=n, threshold=k, iteration=i), out, tables=t) for n in noises for k in thresholds for i in range(repeats)]
    finally:
        drop_tables(spark, list(t.folders) if t else [])


def read_info(spark: SparkSession, out: str) -> DataFrame:
    """What all runs under a folder have built: one row each, with the noise level in the folder's name."""
    return src.read_measurements(spark, f"{out}/*/matrix_info", None)


def parse(args: list[str]) -> tuple[str, Config, bool]:
    p = argparse.ArgumentParser(description="time the plain and the hybrid product of one matrix")
    p.add_argument("out")
    for name, kind, value in (("nx", int, GRID[0]), ("ny", int, GRID[1]), ("nz", int, GRID[2]), ("threshold", int, THRESHOLD), ("noise", float, NOISE)):
        p.add_argument(name, type=kind, nargs="?", default=value)
    for f in sinks.FLAGS:
        p.add_argument(f, type=int, nargs="?", default=int(f == "execCOOGPU"))
    p.add_argument("max_coo_entries", type=int, nargs="?")
    p.add_argument("iteration", type=int, nargs="?", default=0)
    p.add_argument("filename", nargs="?")
    p.add_argument("--iterations", type=int, default=ITERATIONS)
    p.add_argument("--sweep", action="store_true", help="all noise levels and thresholds of a sweep; the grid is the one given")
    a = p.parse_args(args)
    c = Config((a.nx, a.ny, a.nz), a.threshold, a.noise, {f: bool(getattr(a, f)) for f in sinks.FLAGS}, a.max_coo_entries, a.iteration, a.filename, a.iterations)
    return a.out, c, a.sweep


def main(args: list[str] | None = None) -> list[dict]:
    out, c, several = parse(args)
    spark = SparkSession.builder.appName("run").getOrCreate()
    done = sweep(spark, c, out) if several else [run(spark, c, out)]
    for r in done:
        print(", ".join(f"{k} {v:.6g}" if isinstance(v, float) else f"{k} {v}" for k, v in r.items()))
    return done


if __name__ == "__main__":
    main()
