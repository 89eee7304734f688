"""Bytes that each layout takes: 8 a value, 4 an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsemill.operators.convert import dedup, nnz_per_row, num_diagonals
from sparsemill.schema import Matrix


def entry_facts(m: Matrix, *, assume_unique: bool = False) -> DataFrame:
    """One row of what does not depend on a threshold: entries, rows of all slices, diagonals."""
    rows = nnz_per_row(m.coo if assume_unique else dedup(m.coo))
    slices = rows.groupBy(F.expr(f"row div {m.hybrid.block_width}").alias("s")).agg(F.max("nnz").alias("m"), F.sum("nnz").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return slices.agg(total("n").alias("nnz"), total("m").alias("slice_rows")).join(num_diagonals(m.hybrid.counts))  # one row each


def storage_cost(m: Matrix, *, assume_unique: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """One row: the sizes of the hybrid layout of m, the bytes of five layouts, and ratios to coordinates. facts: the `entry_facts` of m, if they are at hand."""
    layout, w = m.hybrid, m.hybrid.block_width
    kept = layout.kept.agg(F.count("*").alias("kept"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("_in"))
    joined = (entry_facts(m, assume_unique=assume_unique) if facts is None else facts).join(kept)  # one row each
    joined = joined.withColumn("fallback", F.col("nnz") - F.col("_in"))  # all entries outside kept groups
    c = F.col
    costs = joined.select(
        "nnz", "num_diagonals", F.lit(layout.num_blocks).cast("long").alias("num_blocks"), (c("kept") * w).alias("stored_cells"), c("fallback").alias("fallback_entries"),
        (c("kept") * (8 * w) + 4 * (layout.num_blocks + 1) + c("kept") * 4 + c("fallback") * 16).alias("hybrid_cost_bytes"),
        (c("nnz") * 16).alias("coo_cost_bytes"),
        (c("num_diagonals") * (8 * min(m.num_rows, m.num_cols) + 4)).alias("dia_cost_bytes"),
        (c("slice_rows") * (12 * w) + 4 * -(-m.num_rows // w)).alias("sell_cost_bytes"),
        (c("nnz") * 12 + 4 * (m.num_rows + 1)).alias("csr_cost_bytes"),
    )
    return costs.select("*", *((c(f"{k}_cost_bytes") / c("coo_cost_bytes")).alias(f"{k}_vs_coo") for k in ("hybrid", "dia", "csr", "sell")))


def matrix_info(m: Matrix, name: str, *, nx: int = 0, ny: int = 0, nz: int = 0, noise: float = 0.0, flags: dict[str, bool] | None = None, facts: DataFrame | None = None) -> DataFrame:
    """The report row of a benchmark run: what was built, its costs, and the run's flags."""
    from sparsemill.sources.sinks import FLAGS

    lit, layout = F.lit, m.hybrid
    costs = storage_cost(m, facts=facts)
    given = {"name": lit(name), "nx": lit(nx), "ny": lit(ny), "nz": lit(nz), "noise": lit(float(noise)), "rows": lit(m.num_rows), "cols": lit(m.num_cols)}
    more = {"block_width": lit(layout.block_width), "threshold": lit(layout.threshold), "max_coo_entries": lit(layout.max_fallback).cast("long")}
    return costs.select(
        *(v.alias(k) for k, v in given.items()), "nnz", "num_diagonals", "num_blocks", *(v.alias(k) for k, v in more.items()), F.col("fallback_entries").alias("coo_fallback_entries"),
        F.col("stored_cells").alias("hybrid_data_size"), *(f"{k}_cost_bytes" for k in ("hybrid", "coo", "dia", "sell", "csr")), *(f"{k}_vs_coo" for k in ("hybrid", "dia", "csr", "sell")),
        *(lit(int(bool((flags or {}).get(f)))).alias(f) for f in FLAGS),
    )
