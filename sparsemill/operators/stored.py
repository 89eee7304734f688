"""A matrix kept on disk for repeated products: only the vector moves.

Entries are written once in buckets of the column, sorted by it, so a product joins them where they are; x alone is dealt into
as many buckets, and products are summed by row before they are sent. Heavy columns would make a heavy bucket: their
entries are stored apart, without buckets, and meet their few elements of x by broadcast.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsemill.operators.spmv import _product, heavy_columns, total
from sparsemill.schema import Matrix, Vector
from sparsemill.sources.shared import materialise, new_path

#: Bytes of entries that one bucket should have, and bytes an entry.
BUCKET_BYTES, ENTRY_BYTES = 128 << 20, 24


@dataclass(frozen=True)
class StoredMatrix:
    """name: the bucketed table of entries outside heavy columns; heavy: col, row, val of those in them; columns: the heavy ones."""

    spark: SparkSession
    name: str
    heavy: DataFrame
    columns: DataFrame
    num_rows: int
    num_cols: int

    def products(self, x: DataFrame) -> DataFrame:
        """row, y of every entry that x has an element for."""
        rest = self.spark.table(self.name).join(x.hint("merge"), F.col("col") == F.col("idx"))
        elements = x.join(F.broadcast(self.columns), F.col("idx") == F.col("col")).select("idx", "x")
        heavy = self.heavy.join(F.broadcast(elements), F.col("col") == F.col("idx"))
        return rest.select("row", _product(F.col("val"), F.col("x")).alias("y")).unionByName(heavy.select("row", _product(F.col("val"), F.col("x")).alias("y")))

    def multiply(self, x: Vector) -> Vector:
        if x.size < self.num_cols:
            raise ValueError("the vector is shorter than the matrix is wide")
        return Vector(total(self.products(x.df), self.num_rows).withColumnRenamed("y", "x"), self.num_rows)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def store(m: Matrix, *, buckets: int | None = None) -> StoredMatrix:
    """Write a matrix's entries in buckets of the column; the number of buckets follows the number of entries."""
    spark, coo = m.coo.sparkSession, m.coo.select("row", "col", "val")
    columns = materialise(heavy_columns(coo), "heavy-columns")
    few = F.broadcast(columns)
    heavy = materialise(coo.join(few, "col").select("row", "col", "val"), "heavy-entries")
    buckets = buckets or max(1, -(-coo.count() * ENTRY_BYTES // BUCKET_BYTES), spark.sparkContext.defaultParallelism)
    name = f"sparsemill_{uuid.uuid4().hex[:12]}"
    rest = coo.join(few, "col", "left_anti").select("row", "col", "val").repartition(buckets, "col")  # one file a bucket
    rest.write.option("path", new_path(spark, name)).bucketBy(buckets, "col").sortBy("col").saveAsTable(name)
    return StoredMatrix(spark, name, heavy, columns, m.num_rows, m.num_cols)
