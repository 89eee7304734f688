"""Row partitions, halo ranges and what lies where in a shard's vector.

Rows are dealt in contiguous runs of rows div parts; the last part takes the remainder. The same rule
deals vectors and owns columns, so finding an owner is arithmetic and needs no join.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsemill.functions.prefix import running_total
from sparsemill.functions.tasks import dealt as deal
from sparsemill.operators.convert import dedup, with_offsets
from sparsemill.operators.spmv import total
from sparsemill.schema import Matrix, Vector

# fixed values: what stands for an index that is in no buffer
NOT_FOUND = -(1 << 31)
#: Columns that one stretch covers: of the gaps-and-islands step and running sums, and of the search for a range.
STRETCH, SEARCH = 65536, 1024


class Partitioner(Protocol):
    """The extension point: how rows are dealt."""

    def part(self, row: Column) -> Column: ...
    def bounds(self, part: int) -> tuple[int, int]: ...


class RowWise:
    """Contiguous runs of rows."""

    def __init__(self, rows: int, parts: int):
        if parts <= 0:
            raise ValueError("the number of parts must be positive")
        self.rows, self.parts, self.each = rows, parts, rows // parts

    def part(self, row: Column) -> Column:
        if not self.each:
            return F.lit(self.parts - 1).cast("long")
        return F.least(F.call_function("div", row, F.lit(self.each)), F.lit(self.parts - 1)).cast("long")

    def start(self, part: Column) -> Column:
        return part * self.each

    def bounds(self, part: int) -> tuple[int, int]:
        return part * self.each, self.rows if part == self.parts - 1 else (part + 1) * self.each

    def table(self, spark) -> DataFrame:
        """part, first, last (half open): as many rows as parts."""
        last = F.when(F.col("id") == self.parts - 1, F.lit(self.rows)).otherwise((F.col("id") + 1) * self.each)
        return spark.range(self.parts).select(F.col("id").alias("part"), (F.col("id") * self.each).alias("first"), last.cast("long").alias("last"))


def partitioner(rows: int, parts: int, strategy: str = "row_wise") -> Partitioner:
    if strategy != "row_wise":
        raise ValueError(f"no strategy {strategy}")
    return RowWise(rows, parts)


# ---------------------------------------------------------------- parts


def partition_rows(coo: DataFrame, num_rows: int, parts: int, strategy: str = "row_wise") -> DataFrame:
    """part, row (local), global_row, col, val."""
    p = partitioner(num_rows, parts, strategy)
    dealt = coo.withColumn("part", p.part(F.col("row")))
    return dealt.select("part", (F.col("row") - p.start(F.col("part"))).alias("row"), F.col("row").alias("global_row"), "col", "val")


def unique_parts(m: Matrix, parts: int, block_width: int) -> DataFrame:
    """The matrix in parts without repeated cells, with offset, block (of local rows) and lane: one exchange by (part, block, offset) for many entries."""
    placed = with_offsets(partition_rows(m.coo, m.num_rows, parts), block_width)
    return dedup(deal(placed, m.bound, "part", "block", "offset"))


def co_located(parts_df: DataFrame, parts: int) -> DataFrame:
    """Each part in one Spark partition, as a shard is on one node."""
    return parts_df.repartition(parts, "part")


def shard(m: Matrix, parts: int, part: int) -> Matrix:
    """One part as a matrix of local rows and global columns."""
    rows = RowWise(m.num_rows, parts)
    first, last = rows.bounds(part)
    local = partition_rows(m.coo, m.num_rows, parts).where(F.col("part") == part).drop("part")
    return Matrix(last - first, m.num_cols, local).as_shard(part, parts, m.num_rows, m.num_cols, m.nnz)


def row_partition_stats(coo: DataFrame, num_rows: int, num_cols: int, parts: int) -> DataFrame:
    """part, global and local rows, columns and entries; parts without entries too."""
    p = RowWise(num_rows, parts)
    counts = partition_rows(coo, num_rows, parts).groupBy("part").agg(F.count("*").alias("n"))
    every = p.table(coo.sparkSession).join(counts, "part", "left").withColumn("local_nnz", F.coalesce("n", F.lit(0)).cast("long"))
    return every.select(
        "part", F.lit(num_rows).cast("long").alias("global_rows"), F.lit(num_cols).cast("long").alias("global_cols"), F.sum("local_nnz").over(Window.partitionBy()).alias("global_nnz"),
        (F.col("last") - F.col("first")).alias("local_rows"), F.lit(num_cols).cast("long").alias("local_cols"), "local_nnz",
    )


def partition_vector(x: DataFrame, size: int, parts: int) -> DataFrame:
    """part, pos (local index), idx, x."""
    if size <= 0:
        raise ValueError("an empty vector cannot be dealt")
    p = RowWise(size, parts)
    dealt = x.withColumn("part", p.part(F.col("idx")))
    return dealt.select("part", (F.col("idx") - p.start(F.col("part"))).alias("pos"), "idx", "x")


def gather(dealt: DataFrame) -> DataFrame:
    """The whole vector again, in order."""
    return dealt.select("idx", "x").orderBy("idx")


# ---------------------------------------------------------------- halo ranges


def part_layout(dealt: DataFrame, num_rows: int, num_cols: int, parts: int, block_width: int, threshold: int, *, assume_unique: bool = False) -> DataFrame:
    """part, block (of local rows), offset (from the global row), n, kept: each part's own hybrid layout. Entries of `unique_parts` are taken as they lie."""
    p = RowWise(num_rows, parts)
    local_rows = F.when(F.col("part") == parts - 1, F.lit(num_rows - (parts - 1) * p.each)).otherwise(F.lit(p.each))
    blocks_here = F.ceil(F.least(local_rows, F.lit(num_cols)) / block_width)
    placed = dealt if {"block", "offset"} <= set(dealt.columns) else with_offsets(dealt, block_width)
    counts = (placed if assume_unique else dedup(placed)).where(F.col("block") < blocks_here).groupBy("part", "block", "offset").agg(F.count("*").alias("n"))
    return counts.withColumn("kept", F.col("n") >= threshold)


def needed_columns(dealt: DataFrame, layout: DataFrame | None, num_rows: int, num_cols: int, parts: int, block_width: int) -> DataFrame:
    """part, lo, hi (half open) runs of needed columns: of entries, and of all lanes of kept groups within real rows and columns."""
    own = dealt.select("part", F.col("col").alias("lo"), (F.col("col") + 1).alias("hi"))
    if layout is None:
        return own.distinct()
    p = RowWise(num_rows, parts)
    first = p.start(F.col("part")) + F.col("block") * block_width
    end = F.when(F.col("part") == parts - 1, F.lit(num_rows)).otherwise((F.col("part") + 1) * p.each)
    lanes = layout.where("kept").select(
        "part", F.greatest(first + F.col("offset"), F.lit(0)).alias("lo"), F.least(F.least(first + block_width, end) + F.col("offset"), F.lit(num_cols)).alias("hi")
    )
    return own.unionByName(lanes.where("lo < hi")).distinct()


def data_ranges(needed: DataFrame) -> DataFrame:
    """part, range_start, range_end: the union of the runs as separate ranges.

    Runs are cut where stretches of columns meet, and joined within each stretch, so no part's columns are all in one task.
    Of the results only those that touch an end of their stretch, two a stretch at most, are joined over the whole part.
    """

    def merged(df: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("lo", "hi")
        reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = df.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
        return marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")

    over = needed.withColumn("stretch", F.explode(F.sequence(F.expr(f"lo div {STRETCH}"), F.expr(f"(hi - 1) div {STRETCH}"))))
    begin, end = F.col("stretch") * STRETCH, (F.col("stretch") + 1) * STRETCH
    near = merged(over.select("part", "stretch", F.greatest("lo", begin).alias("lo"), F.least("hi", end).alias("hi")), ["part", "stretch"])
    at_end = (F.col("lo") == begin) | (F.col("hi") == end)
    ranges = near.where(~at_end).drop("stretch").unionByName(merged(near.where(at_end).drop("stretch"), ["part"]))
    return ranges.withColumnsRenamed({"lo": "range_start", "hi": "range_end"})


def owner_ranges(ranges: DataFrame, num_cols: int, parts: int) -> DataFrame:
    """part, owner, range_start, range_end: ranges cut where the owner changes; the last owner has no end."""
    p = RowWise(num_cols, parts)
    cut = ranges.withColumn("owner", F.explode(F.sequence(p.part(F.col("range_start")), p.part(F.col("range_end") - 1))))
    start = F.greatest("range_start", p.start(F.col("owner")))
    end = F.when(F.col("owner") == parts - 1, F.col("range_end")).otherwise(F.least(F.col("range_end"), p.start(F.col("owner") + 1)))
    return cut.select("part", "owner", start.alias("range_start"), end.alias("range_end"))


def halo_sizes(owned: DataFrame, spark, parts: int) -> DataFrame:
    """part, left_size, right_size: elements from owners before and after, and the whole buffer."""
    length = F.col("range_end") - F.col("range_start")
    amount = lambda c: F.coalesce(F.sum(F.when(c, length)), F.lit(0)).cast("long")
    sums = owned.groupBy("part").agg(amount(F.col("owner") < F.col("part")).alias("l"), amount(F.col("owner") > F.col("part")).alias("r"), amount(F.lit(True)).alias("t"))
    every = spark.range(parts).withColumnRenamed("id", "part").join(sums, "part", "left")
    return every.select("part", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in (("l", "left_size"), ("r", "right_size"), ("t", "total_buffer_size"))))


def buffer_positions(owned: DataFrame, sizes: DataFrame, num_rows: int, parts: int) -> DataFrame:
    """part, range_start, range_end, base: where each foreign range lies in [left, local, right]."""
    p = RowWise(num_rows, parts)
    length = F.col("range_end") - F.col("range_start")
    side = F.col("owner") > F.col("part")
    # owners follow one another as their columns do, so the order of starts is the order of (owner, start)
    foreign = running_total(owned.where("owner != part").withColumn("_side", side), "range_start", length, "before", span=STRETCH, by=("part", "_side"))
    local = F.when(F.col("part") == parts - 1, F.lit(num_rows - (parts - 1) * p.each)).otherwise(F.lit(p.each))
    return foreign.join(sizes.select("part", "left_size"), "part").select("part", "range_start", "range_end", (F.col("before") + F.when(side, F.col("left_size") + local).otherwise(0)).alias("base"))


def vector_offsets(layout: DataFrame, owned: DataFrame, num_rows: int, parts: int, block_width: int) -> DataFrame:
    """part, block, offset, position of a kept group's first element in [left, local, right].

    Indices before the matrix stay as they are (negative); what no range has is NOT_FOUND.
    """
    p = RowWise(num_rows, parts)
    spark = layout.sparkSession
    sizes = halo_sizes(owned, spark, parts)
    first = p.start(F.col("part"))
    end = F.when(F.col("part") == parts - 1, F.lit(num_rows)).otherwise(first + p.each)
    asked = layout.where("kept").select("part", "block", "offset").withColumn("idx", first + F.col("block") * block_width + F.col("offset")).join(sizes.select("part", "left_size"), "part")
    # a range is listed in every stretch that it touches; a part's ranges do not overlap, so at most one is found
    last = F.expr(f"(range_end - 1) div {SEARCH}")
    ranges = buffer_positions(owned, sizes, num_rows, parts).withColumn("_at", F.explode(F.sequence(F.expr(f"range_start div {SEARCH}"), last))).withColumnRenamed("part", "_part")
    local = (F.col("idx") >= first) & (F.col("idx") < end)
    asked = asked.withColumn("_own", F.expr(f"idx div {SEARCH}"))
    found = asked.join(ranges, (F.col("part") == F.col("_part")) & (F.col("_own") == F.col("_at")) & (F.col("idx") >= F.col("range_start")) & (F.col("idx") < F.col("range_end")), "left")
    position = F.when(local, F.col("left_size") + F.col("idx") - first).when(F.col("idx") < 0, F.col("idx")).otherwise(F.coalesce(F.col("base") + F.col("idx") - F.col("range_start"), F.lit(NOT_FOUND)))
    return found.select("part", "block", "offset", position.cast("long").alias("position"))


# ---------------------------------------------------------------- exchange and the distributed product


def halo(x: DataFrame, dealt: DataFrame, size: int, parts: int) -> DataFrame:
    """part, owner, idx, x: the elements that each part needs from others."""
    p = RowWise(size, parts)
    needed = dealt.select("part", F.col("col").alias("idx")).distinct()
    return needed.join(x, "idx").withColumn("owner", p.part(F.col("idx"))).where("owner != part").select("part", "owner", "idx", "x")


def verify_halo(exchanged: DataFrame) -> DataFrame:
    """part, elements and how many are not their own index (for the ramp x_i = i)."""
    return exchanged.groupBy("part").agg(F.count("*").alias("elements"), F.sum(F.when(F.col("x") != F.col("idx"), 1).otherwise(0)).cast("long").alias("wrong"))


def distributed_spmv(m: Matrix, x: Vector, parts: int) -> DataFrame:
    """y from each part's entries with its own and its exchanged elements; equals the plain product."""
    dealt = partition_rows(dedup(m.coo), m.num_rows, parts)
    own = partition_vector(x.df, x.size, parts).select("part", "idx", "x")
    seen = own.unionByName(halo(x.df, dealt, x.size, parts).select("part", "idx", "x"))
    joined = dealt.join(seen.withColumnsRenamed({"idx": "col"}), ["part", "col"])
    return total(joined.select(F.col("global_row").alias("row"), F.when(F.col("val") == 0, 0.0).otherwise(F.col("val") * F.col("x")).alias("y")), m.num_rows)
