"""The data model: matrices and vectors as DataFrames of triples and pairs.

entries: row, col (0-based longs), val (double), and for shards global_row. None of them may be null.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("val", T.DoubleType())])
VECTOR = T.StructType([T.StructField("idx", T.LongType()), T.StructField("x", T.DoubleType())])
# fixed values: default block width and threshold
BLOCK_WIDTH, THRESHOLD = 32, 1
#: The largest number of cells that a dense encoding may have.
MOST_CELLS = 100_000_000_000
#: Cells of one row of a diagonal layout: 512 KB.
SEGMENT = 1 << 16
ENCODINGS = ("coo", "dia", "hybrid")


def reject(df: DataFrame, checks: dict[str, tuple], columns: tuple[str, ...]) -> None:
    """One aggregation over df: raise for null columns (ValueError) or any named check that a row meets."""
    bad = {"null": F.expr(" or ".join(f"{c} is null" for c in columns)), **{k: c for k, (c, _) in checks.items()}}
    found = df.agg(*(F.sum(F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)).alias(k) for k, c in bad.items())).first()
    if found["null"]:
        raise ValueError(f"{found['null']} rows have a null in {', '.join(columns)}")
    for k, (_, error) in checks.items():
        if found[k]:
            raise error(f"{found[k]} rows: {k}")


@dataclass(frozen=True)
class HybridLayout:
    """Blocked diagonals and the entries outside them.

    kept: block, offset, n; counts: the same of all groups; entries: block, offset, lane, row, col, val and
    whether the entry's group is kept, so that one pass over them serves both parts.
    """

    kept: DataFrame
    entries: DataFrame
    counts: DataFrame
    num_rows: int
    num_cols: int
    block_width: int
    threshold: int
    max_fallback: int | None
    bound: int | None = None

    @property
    def cells(self) -> DataFrame:
        """Entries in kept groups."""
        return self.entries.where("kept").drop("kept")

    @property
    def fallback(self) -> DataFrame:
        """All other entries: row, col, val."""
        return self.entries.where("not kept").select("row", "col", "val")

    @property
    def num_blocks(self) -> int:
        return num_blocks(self.num_rows, self.num_cols, self.block_width)


@dataclass(frozen=True)
class Matrix:
    """A matrix in one or more encodings. Methods return new matrices.

    bound: a number that coo's rows do not exceed, where one is known without counting them; operators deal rows over tasks by it.
    """

    num_rows: int
    num_cols: int
    coo: DataFrame | None = None
    dia: DataFrame | None = None
    hybrid: HybridLayout | None = None
    global_rows: int | None = None
    global_cols: int | None = None
    global_nnz: int | None = None
    part: int = -1
    parts: int = -1
    dia_segment: int = SEGMENT
    bound: int | None = None

    @staticmethod
    def empty(spark) -> "Matrix":
        return Matrix(0, 0, spark.createDataFrame([], ENTRY))

    @staticmethod
    def from_df(df: DataFrame, *, num_rows: int | None = None, num_cols: int | None = None, check: bool = True, bound: int | None = None) -> "Matrix":
        """Entries with inferred (greatest index + 1) or given dimensions, which bound the indices."""
        given = num_rows is not None or num_cols is not None
        if given and (num_rows is None or num_cols is None or num_rows <= 0 or num_cols <= 0):
            raise ValueError("both dimensions must be positive")
        keep = ["row", "col", "val", *(c for c in ("seq", "global_row") if c in df.columns)]
        kinds = {"val": "double"}
        df = df.select(*(F.col(c).cast(kinds.get(c, "long")).alias(c) for c in keep))
        if not given:
            num_rows, num_cols = (x + 1 for x in df.agg(F.coalesce(F.max("row"), F.lit(-1)), F.coalesce(F.max("col"), F.lit(-1))).first())
        if check:
            outside = F.expr(f"row < 0 or col < 0 or row >= {num_rows} or col >= {num_cols}")
            reject(df, {"an index is outside the matrix": (outside, IndexError)}, ("row", "col", "val"))
        return Matrix(num_rows, num_cols, df, bound=bound)

    @property
    def partial(self) -> bool:
        return self.global_rows is not None

    @property
    def nnz(self) -> int:
        return self.coo.count()

    def has(self, encoding: str) -> bool:
        return getattr(self, encoding) is not None

    def without(self, encoding: str) -> "Matrix":
        """The matrix less one encoding; the last one stays."""
        if encoding not in ENCODINGS:
            raise ValueError(f"no encoding {encoding}")
        if self.has(encoding) and sum(map(self.has, ENCODINGS)) == 1:
            raise ValueError("the last encoding cannot be dropped")
        return replace(self, **{encoding: None})

    def with_row_map(self, row_map: DataFrame) -> "Matrix":
        """row_map: row, global_row, one row for each local row."""
        rows = row_map.agg(F.count("*"), F.countDistinct("row"), F.min("row"), F.max("row")).first()
        if (rows[0], rows[1]) != (self.num_rows, self.num_rows) or (self.num_rows and (rows[2], rows[3]) != (0, self.num_rows - 1)):
            raise ValueError("the row map must have each local row once")
        return replace(self, coo=self.coo.drop("global_row").join(row_map.select("row", "global_row"), "row"))

    def as_shard(self, part: int, parts: int, global_rows: int, global_cols: int, global_nnz: int) -> "Matrix":
        return replace(self, part=part, parts=parts, global_rows=global_rows, global_cols=global_cols, global_nnz=global_nnz)


def num_blocks(num_rows: int, num_cols: int, block_width: int) -> int:
    return -(-min(num_rows, num_cols) // block_width)


@dataclass(frozen=True)
class Vector:
    """idx, x; indices that are absent are 0 for a product and stay absent otherwise."""

    df: DataFrame
    size: int
    halo: tuple[int, int] = field(default=(0, 0))

    @staticmethod
    def from_df(df: DataFrame, *, size: int | None = None) -> "Vector":
        df = df.select(F.col("idx").cast("long").alias("idx"), F.col("x").cast("double").alias("x"))
        if size is None:
            size = df.agg(F.coalesce(F.max("idx"), F.lit(-1))).first()[0] + 1
        reject(df, {"an index is outside the vector": (F.expr(f"idx < 0 or idx >= {size}"), IndexError)}, ("idx", "x"))
        return Vector(df, size)
