"""CSV sinks of a benchmark run, and MatrixMarket text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsemill.functions.tasks import tasks
from sparsemill.operators.convert import dedup

# fixed values: the columns of a run's flags
FLAGS = ("execCOOCPU", "execCOOGPU", "unifiedMemory", "unifiedMemory_malloc", "unifiedMemory_managedMalloc", "unifiedMemory_NumaAllocOnNode")


def save_csv(df: DataFrame, path: str) -> None:
    """Comma-separated rows in as many parts as df has, each with the header; parts and rows are in df's order, if it is sorted."""
    df.write.mode("overwrite").csv(path, header=True, quote="", escapeQuotes=False)


def baseline_measurements(df: DataFrame) -> DataFrame:
    return df.select(F.col("iteration").cast("int").alias("iteration"), F.col("time_ms").cast("double").alias("time_ms")).orderBy("iteration")


def hybrid_measurements(df: DataFrame, flags: dict[str, bool]) -> DataFrame:
    """Measurements with the six run flags as 0 or 1."""
    return baseline_measurements(df).select("*", *(F.lit(int(bool(flags.get(f)))).alias(f) for f in FLAGS))


def histogram_rows(histogram: DataFrame) -> DataFrame:
    return histogram.where("blocks_with_diagonals > 0 or nnz_in_blocks > 0").orderBy("diagonal_count")


def stamp(ts: Column) -> Column:
    """%Y%m%d_%H%M%S_mmm."""
    return F.date_format(ts, "yyyyMMdd_HHmmss_SSS")


def run_folder(name: str, nx: int, ny: int, nz: int, noise: float, now: dt.datetime) -> str:
    return f"{name}_{nx}_{ny}_{nz}_{noise:.6f}_{now:%Y%m%d_%H%M%S}_{now.microsecond // 1000:03d}"


def save_mtx(m, path: str, duplicates: str | None = None) -> None:
    """MatrixMarket text, 1-based, general and real: a folder of parts whose names follow the order of rows and columns. The first is
    the header, so they are one file when put behind one another; `read_mtx` takes the folder. duplicates: how repeated cells become one, as `dedup` takes it."""
    spark = m.coo.sparkSession
    body = m.coo.repartitionByRange(tasks(spark, m.bound), "row", "col")
    if duplicates:
        body = dedup(body, duplicates)  # in the same ranges
    body = body.select("row", "col", "val").sortWithinPartitions("row", "col").persist()  # the header has their number
    try:
        head = spark.createDataFrame([(f"%%MatrixMarket matrix coordinate real general\n{m.num_rows} {m.num_cols} {body.count()}",)], "value string").coalesce(1)
        lines = body.select(F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, F.col("val")).alias("value"))
        head.unionByName(lines).write.mode("overwrite").text(path)
    finally:
        body.unpersist()
