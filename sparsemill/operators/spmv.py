"""Products of a matrix and a vector, vector sums, and comparisons of vectors.

A stored zero adds exactly 0, also where x is NaN or infinite. Results cover every row; rows without
entries are 0. An index that x does not have counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsemill.functions.arrays import sorted_cells, zero_filled
from sparsemill.functions.exact import largest, repeatable_sums, sum_columns
from sparsemill.functions.tasks import dealt, tasks
from sparsemill.operators.convert import dedup
from sparsemill.schema import HybridLayout, Matrix, Vector
from sparsemill.sources.shared import materialise

#: Most elements of x that are broadcast: 16 bytes each, so 32 MB.
BROADCAST_ELEMENTS = 2_000_000
#: A column is heavy with more than one in HEAVY of all entries, so fewer are; columns that the sketch which finds them tracks.
HEAVY, TRACKED = 1000, 16_000


def _product(val: Column, x: Column) -> Column:
    return F.when(val == 0, F.lit(0.0)).otherwise(val * x)


def heavy_columns(entries: DataFrame) -> DataFrame:
    """col of all that hold more than one in HEAVY of the entries, from a sketch of bounded size; 3/2 HEAVY rows at most.

    The sketch's counts are off by under 4 / TRACKED of all entries, a quarter of that share, so fewer than 4/3 HEAVY columns can rank
    before one that is heavy, and none that is heavy is missed; a column of half that share may be listed too.
    """
    sketch = entries.agg(F.count("*").alias("_n"), F.expr(f"approx_top_k(col, {HEAVY * 3 // 2}, {TRACKED})").alias("_top"))
    return sketch.select("_n", F.inline("_top")).where(F.col("count") > 0.75 * F.col("_n") / HEAVY).select(F.col("item").alias("col"))


def partial_products(entries: DataFrame, x: DataFrame, *, size: int | None = None, heavy: DataFrame | None = None, bound: int | None = None) -> DataFrame:
    """row, y of each entry. x is broadcast only where its size is known to be small.

    Elsewhere entries and x meet in a join on the column. A column with a large share of all entries would put those in one task, so the
    elements of heavy columns alone, 3/2 HEAVY of them at most, are broadcast, and their entries stay where they are. heavy: a table of these columns, if it is at hand.
    bound: of entries, by which they are dealt. Where a task's share of x is known to be small, it is held as a hash table, so that entries
    are not sorted. A stream is not counted beforehand: its source bounds a batch.
    """
    product = lambda e, side: e.join(side, e["col"] == side["idx"]).select("row", _product(F.col("val"), F.col("x")).alias("y"))
    if size is not None and size <= BROADCAST_ELEMENTS:
        return product(entries, F.broadcast(x))
    if entries.isStreaming:
        return product(entries, x)
    heavy = materialise(heavy_columns(entries), "heavy") if heavy is None else heavy
    elements = x.join(F.broadcast(heavy), x["idx"] == heavy["col"]).select("idx", "x")
    rest = dealt(entries.join(F.broadcast(heavy), "col", "left_anti"), bound, "col")
    held = size is not None and size <= BROADCAST_ELEMENTS * tasks(entries.sparkSession, None)
    return product(rest, x.hint("shuffle_hash") if held else x).unionByName(product(entries, F.broadcast(elements)))


def total(partial: DataFrame, num_rows: int, *, repeatable: bool = False) -> DataFrame:
    """idx, y for every row. repeatable: the same bits for any order and number of tasks, at the price of one more pass for the largest product."""
    spine = partial.sparkSession.range(num_rows).withColumnRenamed("id", "idx")
    rows = partial.select(F.col("row").alias("idx"), "y")
    sums = repeatable_sums(rows, ["idx"], y=F.col("y")) if repeatable else rows.groupBy("idx").agg(F.sum("y").alias("y"))
    return spine.join(sums, "idx", "left").select("idx", F.coalesce("y", F.lit(0.0)).alias("y"))


def spmv_coo(coo: DataFrame, x: DataFrame, num_rows: int, *, size: int | None = None, repeatable: bool = False, heavy: DataFrame | None = None, bound: int | None = None) -> DataFrame:
    return total(partial_products(coo, x, size=size, heavy=heavy, bound=bound), num_rows, repeatable=repeatable)


def segments(x: DataFrame, width: int) -> DataFrame:
    """seg, s: x in zero-filled runs of the block width. A missing run is zero, which is the rule for columns outside the matrix."""
    runs = x.groupBy(F.expr(f"idx div {width}").alias("seg")).agg(sorted_cells(F.expr(f"idx % {width}"), F.col("x")).alias("cells"))
    return runs.select("seg", zero_filled(F.col("cells"), width).alias("s"))


def segment_products(entries: DataFrame, x: DataFrame, width: int) -> DataFrame:
    """row, y of entries, each with its element of a broadcast segment of x; nothing is shuffled."""
    both = entries.withColumn("seg", F.expr(f"col div {width}")).join(F.broadcast(segments(x, width)), "seg")
    return both.select("row", _product(F.col("val"), F.get("s", F.expr(f"int(col % {width})"))).alias("y"))


def block_products(layout: HybridLayout, x: DataFrame, *, size: int | None = None) -> DataFrame:
    """row, y of the lanes that hold entries; empty lanes add nothing.

    x comes in segments of the block width. Where it is known to be small they are broadcast, and each lane finds its
    element in one; nothing is shuffled. Otherwise the lanes of a (block, offset) travel as one row: its window of x
    spans two segments at most.
    """
    w = layout.block_width
    if size is not None and size <= BROADCAST_ELEMENTS:
        return segment_products(layout.cells, x, w)
    kept = layout.cells.groupBy("block", "offset").agg(F.collect_list(F.struct("lane", "val")).alias("cells"))  # dealt by (block, offset) already
    return _window_products(kept, x, F.col("block") * w, w, bound=layout.bound)


def _window_products(groups: DataFrame, x: DataFrame, first: Column, w: int, *, bound: int | None = None) -> DataFrame:
    """row, y of groups (offset, cells of lane and val) of up to w rows from `first` on: their window of x spans two segments of w at most. bound: of all cells, by which groups are dealt."""
    runs, start = segments(x, w), first + F.col("offset")
    placed = groups.withColumn("first", first).withColumn("seg", F.floor(start / w).cast("long")).withColumn("shift", F.pmod(start, F.lit(w)))
    one = dealt(placed, bound, "seg").join(runs.withColumnRenamed("s", "s0"), "seg", "left").withColumn("seg", F.col("seg") + 1)
    two = dealt(one, bound, "seg").join(runs.withColumnRenamed("s", "s1"), "seg", "left")
    at = lambda c: (F.col("shift") + c["lane"]).cast("int")
    element = lambda c: F.coalesce(F.when(at(c) < w, F.get("s0", at(c))).otherwise(F.get("s1", at(c) - w)), F.lit(0.0))
    products = F.transform("cells", lambda c: F.struct((F.col("first") + c["lane"]).alias("row"), _product(c["val"], element(c)).alias("y")))
    return two.select(F.inline(products))


def spmv_dia(m: Matrix, x: DataFrame) -> DataFrame:
    """The product of a diagonal layout, segment by segment: a segment's window of x spans two of x's. Rows that the layout leaves out are 0."""
    w = m.dia_segment
    cells = F.transform("diag", lambda v, i: F.struct(i.alias("lane"), v.alias("val")))
    groups = m.dia.select("offset", (F.col("seg") * w).alias("_first"), F.filter(cells, lambda c: c["val"] != 0).alias("cells"))
    return total(_window_products(groups, x, F.col("_first"), w), m.num_rows)


def spmv_hybrid(layout: HybridLayout, x: DataFrame, *, strategy: str = "join", size: int | None = None) -> DataFrame:
    """Block and fallback products together, under one final sum; one pass over both parts where nothing is grouped."""
    if strategy == "block" and size is not None and size <= BROADCAST_ELEMENTS:
        both = segment_products(layout.entries, x, layout.block_width)
    elif strategy == "block":
        both = block_products(layout, x, size=size).unionByName(partial_products(layout.fallback, x, size=size))
    else:
        both = partial_products(layout.entries.select("row", "col", "val"), x, size=size)
    return total(both, layout.num_rows)


def spmv(a: Matrix, x: Vector, *, strategy: str = "auto") -> Vector:
    """y = A x. strategy: join (entry by entry), block (lane by lane, needs the hybrid layout) or auto.

    auto takes the join, from the coordinates where there are some: measured over kept layouts, it was as fast as the block
    form for scattered entries and twice as fast for a stencil of 7 million entries, whose groups are full.
    """
    if strategy not in ("auto", "join", "block"):
        raise ValueError(f"no strategy {strategy}")
    if x.size < a.num_cols:
        raise ValueError("the vector is shorter than the matrix is wide")
    if strategy == "block" and not a.has("hybrid"):
        raise ValueError("the block strategy needs the hybrid layout")
    if strategy == "block":
        y = spmv_hybrid(a.hybrid, x.df, strategy="block", size=x.size)
    elif a.has("coo"):
        y = spmv_coo(a.coo, x.df, a.num_rows, size=x.size)
    else:
        y = spmv_hybrid(a.hybrid, x.df, size=x.size)
    return Vector(y.withColumnRenamed("y", "x"), a.num_rows)


def vector_add(a: DataFrame, b: DataFrame, *, repeatable: bool = False) -> DataFrame:
    """idx, x: the sum; an index in one of them only keeps its value."""
    both = a.unionByName(b)
    return repeatable_sums(both, ["idx"], x=F.col("x")) if repeatable else both.groupBy("idx").agg(F.sum("x").alias("x"))


def compare_vectors(a: DataFrame, b: DataFrame, *, tolerance: float = 1e-6) -> DataFrame:
    """One row: elements, greatest absolute error, sums of absolute values (the same bits in any order), mismatches over the tolerance, relative error of the sums."""
    both = a.join(b.withColumnRenamed("x", "_x"), "idx", "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("_x", F.lit(0.0)).alias("_x"))
    error = F.abs(F.col("x") - F.col("_x"))
    (one, first), (two, second) = (sum_columns(F.abs(c), largest(both, F.col(c)), c) for c in ("x", "_x"))
    sums = both.agg(F.count("*").alias("n"), F.coalesce(F.max(error), F.lit(0.0)).alias("max_abs_error"), *one, *two, F.coalesce(F.sum(F.when(error > tolerance, 1).otherwise(0)), F.lit(0)).cast("long").alias("mismatches"))
    sums = sums.select("n", "max_abs_error", F.coalesce(first, F.lit(0.0)).alias("sum_abs_a"), F.coalesce(second, F.lit(0.0)).alias("sum_abs_b"), "mismatches")
    relative = F.when(F.col("sum_abs_a") == 0, F.col("sum_abs_b")).otherwise(F.abs(F.col("sum_abs_a") - F.col("sum_abs_b")) / F.col("sum_abs_a"))
    return sums.withColumn("relative_error", relative)


def accurate(a: DataFrame, b: DataFrame, *, tolerance: float = 1e-6) -> bool:
    """The gate before measurements are saved."""
    return compare_vectors(a, b, tolerance=tolerance).first()["max_abs_error"] < tolerance


def reference_spmv(coo: DataFrame, x: DataFrame, num_rows: int) -> DataFrame:
    """The baseline: duplicates summed first, then the plain product."""
    return spmv_coo(dedup(coo), x, num_rows)
