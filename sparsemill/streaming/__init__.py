"""Products over matrices that arrive as a stream of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsemill.operators.spmv import partial_products


def streaming_spmv(entries: DataFrame, x: DataFrame, *, size: int | None = None) -> DataFrame:
    """idx, y of all entries so far, for a writer in update or complete mode: a change of an entry comes as its difference.

    The state is one sum a row. Rows that no entry has touched are absent.
    """
    return partial_products(entries, x, size=size).groupBy(F.col("row").alias("idx")).agg(F.sum("y").alias("y"))
