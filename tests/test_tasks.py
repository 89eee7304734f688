"""Many rows are dealt over more tasks than the session has, with the same results."""

import pytest

import __spark_entry__
from sparsemill.functions import tasks
from sparsemill.operators import convert
from sparsemill.plans import registry, run
from sparsemill.sources import matrix as src
from tests.test_queries import SF, db, rows  # noqa: F401


@pytest.mark.parametrize(
    "name", ["data_ranges", "distributed_layout", "halo_sizes", "owner_ranges", "vector_offsets", "hybrid_round_trip", "hybrid_cap", "hybrid_coo_fallback", "spmv_stencil_blocks", "run_sweep"]
)
def test_queries_over_more_tasks(spark, db, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(tasks, "ROWS_A_TASK", 400)
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), db.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_tasks_grow_with_the_entries(spark, monkeypatch):
    monkeypatch.setattr(tasks, "ROWS_A_TASK", 400)
    m = registry.square(spark, SF)
    want = -(-m.coo.count() // 400)
    assert m.bound == m.coo.count() and want > 4
    assert convert.to_hybrid(m, threshold=2).hybrid.entries.rdd.getNumPartitions() == want
    assert registry.distributed_layout(spark, SF).rdd.getNumPartitions() == want


def test_a_sweep_reads_its_file_once(spark, tmp_path, monkeypatch):
    f, read = tmp_path / "m.mtx", []
    f.write_text("%%MatrixMarket matrix coordinate real general\n%\n3 3 3\n1 1 2\n\n2   3\t4 \n3 3 1\n")
    real = src.read_mtx
    monkeypatch.setattr(src, "read_mtx", lambda *a, **kw: read.append(a) or real(*a, **kw))
    done = run.sweep(spark, run.Config(filename=str(f), iterations=2), str(tmp_path / "out"), (0.0,), (1, 2))
    assert [r["passed"] for r in done] == [True, True] and len(read) == 1
