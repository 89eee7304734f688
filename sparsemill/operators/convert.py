"""Conversions between coordinate, diagonal and hybrid blocked-diagonal layouts.

Blocks are cut by row: block = row div width, lane = row % width, offset = col - global row. Only the
first ceil(min(rows, cols) / width) blocks hold diagonals; entries of later rows fall back.
Duplicates are summed unless the last writer is asked for, which needs a seq column.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsemill.functions.arrays import sorted_cells, zero_filled
from sparsemill.functions.exact import repeatable_sums
from sparsemill.functions.prefix import running_total, scan
from sparsemill.functions.tasks import dealt
from sparsemill.schema import BLOCK_WIDTH, MOST_CELLS, SEGMENT, THRESHOLD, HybridLayout, Matrix, num_blocks

#: Blocks or rows that one stretch of a running sum covers.
STRETCH = 4096
#: The widest block whose lanes are columns of an aggregation; wider ones are gathered as lists.
LANE_COLUMNS = 64


def dedup(coo: DataFrame, duplicates: str = "sum", *, repeatable: bool = False) -> DataFrame:
    """One entry for each cell: the sum of its entries (zero sums stay), or the one written last (of those the largest, where seq ties). repeatable: sums with the same bits in any order."""
    if duplicates == "last":
        if "seq" not in coo.columns:
            raise ValueError("the last writer needs a seq column")
        value = F.max_by("val", F.struct("seq", "val"))
    elif duplicates == "sum":
        value = F.sum("val")
    else:
        raise ValueError(f"no way {duplicates} to treat duplicates")
    keys = ["row", "col", *(c for c in ("part", "global_row", "offset", "block", "lane") if c in coo.columns)]
    if repeatable and duplicates == "sum":
        return repeatable_sums(coo, keys, val=F.col("val"))
    return coo.groupBy(*keys).agg(value.alias("val"))


def with_offsets(coo: DataFrame, block_width: int = BLOCK_WIDTH) -> DataFrame:
    """coo with offset, block and lane."""
    row = "global_row" if "global_row" in coo.columns else "row"
    return coo.withColumns({"offset": F.col("col") - F.col(row), "block": F.expr(f"row div {block_width}"), "lane": F.expr(f"row % {block_width}")})


def diagonals(coo: DataFrame) -> DataFrame:
    """offset and its number of entries."""
    return with_offsets(coo).groupBy("offset").agg(F.count("*").alias("n"))


def dia_long(m: Matrix, *, assume_unique: bool = False) -> DataFrame:
    """offset, pos, val of the diagonal layout; rows from min(rows, cols) on are left out."""
    coo = m.coo if assume_unique else dedup(m.coo)
    return with_offsets(coo).where(F.col("row") < min(m.num_rows, m.num_cols)).select("offset", F.col("row").alias("pos"), "val")


def to_dia(m: Matrix, *, assume_unique: bool = False, segment: int = SEGMENT) -> Matrix:
    """m with dia: offset, seg and the zero-filled array of its rows seg * segment and on. Every offset of an entry is kept.

    A diagonal is cut into segments of bounded length, so it may be of any length; segments without an entry are
    not stored (an offset whose entries are all left out has one of zeros), and stand for zeros.
    """
    if m.has("dia") or not m.has("coo"):
        return m
    if segment < 1:
        raise ValueError("a segment must have a cell")
    coo, length = m.coo if assume_unique else dedup(m.coo), min(m.num_rows, m.num_cols)
    inside = F.col("row") < length
    offs = with_offsets(coo).withColumn("seg", F.when(inside, F.expr(f"row div {segment}")).otherwise(0))
    stored = offs.groupBy("offset", "seg").agg(sorted_cells(F.when(inside, F.expr(f"row % {segment}")), F.col("val")).alias("cells"))
    size = F.least(F.lit(segment), F.lit(length) - F.col("seg") * segment)
    return replace(m, dia=stored.select("offset", "seg", zero_filled(F.col("cells"), size).alias("diag")), dia_segment=segment)


def dia_to_coo(dia: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The entries of a diagonal layout that are not zero."""
    every = dia.select("offset", "seg", F.posexplode("diag").alias("at", "val")).where("val != 0")
    row = F.col("seg") * segment + F.col("at")
    return every.select(row.alias("row"), (row + F.col("offset")).alias("col"), "val")


def block_offset_counts(coo: DataFrame, num_rows: int, num_cols: int, block_width: int = BLOCK_WIDTH, by: tuple[str, ...] = ()) -> DataFrame:
    """block, offset, n of the entries in blocks that hold diagonals."""
    inside = with_offsets(coo, block_width).where(F.col("block") < num_blocks(num_rows, num_cols, block_width))
    return inside.groupBy(*by, "block", "offset").agg(F.count("*").alias("n"))


def keep_rule(counts: DataFrame, threshold: int, max_fallback: int | None, bound: int | None = None) -> DataFrame:
    """counts with kept: dense enough, or the entries that fell back before already reach the cap.

    In the order of (block, offset) the cap is a running sum of the groups under the threshold: up to
    the cut all of them fall back, and beyond it the sum stays at or over the cap.
    """
    dense = F.col("n") >= threshold
    if max_fallback is None:
        return counts.withColumn("kept", dense)
    summed = scan(counts, {"_before": F.when(dense, 0).otherwise(F.col("n")).cast("long")}, order=("block", "offset"), bound=bound)
    return summed.withColumn("kept", dense | (F.col("_before") >= max_fallback)).drop("_before")


def grouped(m: Matrix, block_width: int = BLOCK_WIDTH) -> DataFrame:
    """The entries of m, without repeated cells, with block, offset and lane, the number n of their group's entries, and whether they are its first one.

    Layouts at any threshold are scans of this table. A group has as many entries as a block has rows at most.
    """
    w = Window.partitionBy("block", "offset")
    placed = dealt(with_offsets(m.coo.select("row", "col", "val"), block_width), m.bound, "block", "offset")
    return placed.withColumns({"n": F.count("*").over(w), "first": F.col("lane") == F.min("lane").over(w)})


def to_hybrid(m: Matrix, *, block_width: int = BLOCK_WIDTH, threshold: int = THRESHOLD, max_fallback: int | None = None, assume_unique: bool = False, duplicates: str = "sum", groups: DataFrame | None = None) -> Matrix:
    """m with its hybrid layout: cells in kept (block, offset) groups, all other entries as fallback. groups: a table of `grouped` entries of m at this width."""
    if block_width < 1:
        raise ValueError("the block width must be positive")
    if groups is not None:
        inside = F.col("block") < num_blocks(m.num_rows, m.num_cols, block_width)
        counts = groups.where(inside & F.col("first")).select("block", "offset", "n")
        ruled = keep_rule(counts, threshold, max_fallback, m.bound)
        entries = groups.withColumn("kept", inside & (F.col("n") >= threshold))
        if max_fallback is not None:
            entries = groups.join(ruled.select("block", "offset", "kept"), ["block", "offset"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
        entries = entries.select("block", "offset", "lane", "row", "col", "val", "kept")
        return replace(m, hybrid=HybridLayout(ruled.where("kept").select("block", "offset", "n"), entries, counts, m.num_rows, m.num_cols, block_width, threshold, max_fallback, m.bound))
    # many entries are dealt by (block, offset) at once: duplicates, counts, the join and the lanes all take that exchange
    placed = dealt(with_offsets(m.coo, block_width), m.bound, "block", "offset")
    coo = placed if assume_unique else dedup(placed, duplicates)
    counts = coo.where(F.col("block") < num_blocks(m.num_rows, m.num_cols, block_width)).groupBy("block", "offset").agg(F.count("*").alias("n"))
    ruled = keep_rule(counts, threshold, max_fallback, m.bound)
    # without a cap, counts are dealt by (block, offset) already, so this join shuffles the entries alone
    entries = coo.join(ruled.select("block", "offset", "kept"), ["block", "offset"], "left")
    entries = entries.select("block", "offset", "lane", "row", "col", "val", F.coalesce("kept", F.lit(False)).alias("kept"))
    kept = ruled.where("kept").select("block", "offset", "n")
    return replace(m, hybrid=HybridLayout(kept, entries, counts, m.num_rows, m.num_cols, block_width, threshold, max_fallback, m.bound))


def check_storage(layout: HybridLayout) -> int:
    """Stored cells (kept groups x width); raises beyond the limit."""
    cells = layout.kept.count() * layout.block_width
    if cells > MOST_CELLS:
        raise ValueError(f"the hybrid layout would have {cells} cells")
    return cells


def blocks(layout: HybridLayout) -> DataFrame:
    """block, offset, lanes: zero-filled arrays of the block width."""
    width, groups = layout.block_width, layout.cells.groupBy("block", "offset")  # dealt by (block, offset) already
    if width > LANE_COLUMNS:
        return groups.agg(sorted_cells(F.col("lane"), F.col("val")).alias("cells")).select("block", "offset", zero_filled(F.col("cells"), width).alias("lanes"))
    lanes = groups.agg(*(F.sum(F.when(F.col("lane") == k, F.col("val"))).alias(f"l{k}") for k in range(width)))
    return lanes.select("block", "offset", F.array(*(F.coalesce(f"l{k}", F.lit(0.0)) for k in range(width))).alias("lanes"))


def hybrid_to_coo(layout: HybridLayout) -> DataFrame:
    """The entries of a hybrid layout that are not zero."""
    every = blocks(layout).select("block", "offset", F.posexplode("lanes").alias("lane", "val")).where("val != 0")
    row = F.col("block") * layout.block_width + F.col("lane")
    return every.select(row.alias("row"), (row + F.col("offset")).alias("col"), "val").unionByName(layout.fallback.where("val != 0"))


def fallback_row_ptr(fallback: DataFrame, num_rows: int) -> DataFrame:
    """row 0..num_rows and the number of fallback entries in the rows before it."""
    spine = fallback.sparkSession.range(num_rows + 1).withColumnRenamed("id", "row")
    counted = spine.join(fallback.groupBy("row").agg(F.count("*").alias("n")), "row", "left")
    total = running_total(counted, "row", F.coalesce("n", F.lit(0)).cast("long"), "ptr", span=STRETCH)
    return total.select("row", F.col("ptr").cast("long").alias("ptr"))


def block_sizes(kept: DataFrame, blocks_in_all: int) -> DataFrame:
    """block, block_size for every block, empty ones too."""
    spine = kept.sparkSession.range(blocks_in_all).withColumnRenamed("id", "block")
    return spine.join(kept.groupBy("block").agg(F.count("*").alias("block_size")), "block", "left").select("block", F.coalesce("block_size", F.lit(0)).cast("long").alias("block_size"))


def block_directory(kept: DataFrame, blocks_in_all: int) -> DataFrame:
    """block, block_start, block_size; one more row (size 0) has the total."""
    sizes = block_sizes(kept, blocks_in_all)
    end = kept.sparkSession.range(blocks_in_all, blocks_in_all + 1).select(F.col("id").alias("block"), F.lit(0).cast("long").alias("block_size"))
    total = running_total(sizes.unionByName(end), "block", F.coalesce("block_size", F.lit(0)).cast("long"), "block_start", span=STRETCH)
    return total.select("block", F.col("block_start").cast("long").alias("block_start"), "block_size")


def flattened_offsets(kept: DataFrame) -> DataFrame:
    """pos, block, offset: kept offsets in storage order."""
    total = scan(kept.select("block", "offset"), {"pos": F.lit(1).cast("long")}, order=("block", "offset"))
    return total.select(F.col("pos").cast("long").alias("pos"), "block", "offset")


def block_histogram(layout: HybridLayout) -> DataFrame:
    """diagonal_count, blocks with so many kept offsets, and the entries stored in them."""
    sizes = block_sizes(layout.kept, layout.num_blocks)
    stored = layout.kept.groupBy("block").agg(F.sum("n").alias("nnz"))
    joined = sizes.join(stored, "block", "left")
    return joined.groupBy(F.col("block_size").alias("diagonal_count")).agg(
        F.count("*").alias("blocks_with_diagonals"), F.coalesce(F.sum("nnz"), F.lit(0)).cast("long").alias("nnz_in_blocks")
    )


def num_diagonals(counts: DataFrame) -> DataFrame:
    """The number of offsets in blocks that hold diagonals, kept or not."""
    return counts.agg(F.countDistinct("offset").alias("num_diagonals"))


def nnz_per_row(coo: DataFrame) -> DataFrame:
    return coo.groupBy("row").agg(F.count("*").alias("nnz"))
