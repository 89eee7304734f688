"""A product kept up to date over files that arrive one after another."""

import pytest

from sparsemill.operators.spmv import spmv_coo
from sparsemill.schema import ENTRY
from sparsemill.sources.matrix import ramp
from sparsemill.streaming import streaming_spmv


@pytest.mark.parametrize("size", [5, None])
def test_stream(spark, tmp_path, size):
    rows = [(k % 7, k % 5, float(k)) for k in range(50)]
    x = ramp(spark, 5, 1)
    for k in range(3):
        spark.createDataFrame(rows[k::3], ENTRY).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = streaming_spmv(stream, x.df, size=size).writeStream.outputMode("complete").format("memory").queryName(f"y{size}").start()
    q.processAllAvailable()
    q.stop()
    want = {r["idx"]: r["y"] for r in spmv_coo(spark.createDataFrame(rows, ENTRY), x.df, 7).collect()}
    assert {r["idx"]: r["y"] for r in spark.table(f"y{size}").collect()} == want
