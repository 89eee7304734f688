"""A benchmark run from its arguments to its files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sparsemill.functions import tasks
from sparsemill.operators import convert, spmv
from sparsemill.plans import registry, run
from sparsemill.sources import shared
from sparsemill.sources import sinks


def test_arguments():
    out, c, several = run.parse(["/out"])
    assert (out, c, several) == ("/out", run.Config(), False) and (c.grid, c.threshold, c.noise, c.iterations, c.max_fallback) == ((32, 32, 32), 2, 0.1, 100, None)
    _, c, several = run.parse("/out 8 9 10 4 0.5 1 0 0 0 1 0 77 3 /m/some.mtx --sweep --iterations 5".split())
    assert several and (c.grid, c.threshold, c.noise, c.max_fallback, c.iteration, c.iterations) == ((8, 9, 10), 4, 0.5, 77, 3, 5)
    assert [f for f in sinks.FLAGS if c.flags[f]] == ["execCOOCPU", "unifiedMemory_managedMalloc"]
    now = dt.datetime(2025, 8, 21, 16, 32, 9, 715000)
    assert c.name == "some" and c.folder(now) == "some_0.500000_20250821_163209_715" and run.Config().folder(now) == "3D27Stencil_32_32_32_0.100000_20250821_163209_715"


def test_a_run_saves_measurements_only_if_results_agree(spark, tmp_path, monkeypatch):
    c = run.Config((4, 4, 4), noise=0.1, iterations=3)
    one = run.run(spark, c, str(tmp_path / "good"))
    assert one["passed"] and one["speedup"] > 0 and sorted(os.listdir(one["folder"])) == ["baseline", "histogram", "hybrid", "matrix_info"]
    assert [r["iteration"] for r in spark.read.csv(f"{one['folder']}/hybrid", header=True, inferSchema=True).orderBy("iteration").collect()] == [0, 1, 2]
    info = run.read_info(spark, str(tmp_path / "good")).first()
    assert (info["name"], info["nx"], info["noise_level"], info["execCOOGPU"]) == ("3D27Stencil", 4, 0.1, 1)
    plain = spmv.spmv_coo
    calls = []

    def wrong(*args, **kw):
        calls.append(1)  # the two products differ by 1
        return plain(*args, **kw).selectExpr("idx", f"y + {len(calls)}.0D as y")

    monkeypatch.setattr(spmv, "spmv_coo", wrong)
    two = run.run(spark, c, str(tmp_path / "bad"))
    assert not two["passed"] and two["speedup"] is None and sorted(os.listdir(two["folder"])) == ["histogram", "matrix_info"]


def test_a_product_is_made_once_an_iteration(spark, tmp_path, monkeypatch):
    """Results are compared as tables, not made again for each aggregation; all thresholds of a file read one table of groups."""
    made, plain, groups, real = spark.sparkContext.accumulator(0), spmv.spmv_coo, [], convert.grouped

    def seen(y):
        made.add(1)
        return y

    monkeypatch.setattr(spmv, "spmv_coo", lambda *a, **kw: plain(*a, **kw).select("idx", F.udf(seen, "double")("y").alias("y")))
    monkeypatch.setattr(convert, "grouped", lambda *a: groups.append(a) or real(*a))
    f = tmp_path / "m.mtx"
    f.write_text("%%MatrixMarket matrix coordinate real general\n5 5 4\n1 1 2\n2 3 4\n3 3 1\n3 3 1\n")
    before = set(shared._tables)
    done = run.sweep(spark, run.Config(filename=str(f), iterations=3), str(tmp_path / "out"), (0.0,), (1, 2))
    assert [r["passed"] for r in done] == [True, True] and made.value == 2 * 2 * 3 * 5
    assert len(groups) == 1 and set(shared._tables) == before


def test_a_sweep_joins_where_the_vector_is_long(spark, tmp_path, monkeypatch):
    """Entries are dealt by bound and not sorted, and the heavy columns are found once for all runs."""
    monkeypatch.setattr(spmv, "BROADCAST_ELEMENTS", 20)
    monkeypatch.setattr(tasks, "ROWS_A_TASK", 100)
    found, real, plans, product = [], spmv.heavy_columns, [], spmv.spmv_coo
    monkeypatch.setattr(spmv, "heavy_columns", lambda e: found.append(1) or real(e))
    monkeypatch.setattr(spmv, "spmv_coo", lambda *a, **kw: plans.append(product(*a, **kw)) or plans[-1])
    f = tmp_path / "m.mtx"
    cells = sorted({(k * 7 % 60, k * k % 60) for k in range(900)})
    f.write_text(f"%%MatrixMarket matrix coordinate real general\n60 60 {len(cells)}\n" + "".join(f"{r + 1} {c + 1} 2\n" for r, c in cells))
    done = run.sweep(spark, run.Config(filename=str(f), iterations=2), str(tmp_path / "out"), (0.0,), (1, 2))
    assert [r["passed"] for r in done] == [True, True] and [r["mismatches"] for r in done] == [0, 0]
    assert len(found) == 1 and len(plans) == 4


@pytest.mark.parametrize("cap", [None, 3, 40])
def test_a_layout_of_groups_is_the_layout(spark, tmp_path, cap):
    m = registry.square(spark, "/root/testdata/sf0.001")
    m = run.replace(m, coo=convert.dedup(m.coo).unionByName(spark.createDataFrame([(40, c, 1.0) for c in range(300, 330)], m.coo.schema)).groupBy("row", "col").agg(F.sum("val").alias("val")))
    want = convert.to_hybrid(m, block_width=32, threshold=2, max_fallback=cap, assume_unique=True).hybrid
    got = convert.to_hybrid(m, block_width=32, threshold=2, max_fallback=cap, groups=convert.grouped(m, 32)).hybrid
    for k in ("kept", "counts", "entries"):
        one, two = getattr(got, k), getattr(want, k)
        assert sorted(map(tuple, one.select(*two.columns).collect())) == sorted(map(tuple, two.collect()))


def test_no_local_folder_on_a_cluster():
    class Cluster:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster
        conf = {}

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session)
    Session.conf = {"spark.checkpoint.dir": "hdfs://all"}
    assert shared.shared_dir(Session) == "hdfs://all"
