"""Dense arrays from sorted positions, in time linear in their length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_filled(cells: Column, length: int | Column) -> Column:
    """`length` doubles: the val of each (pos, val) struct at its pos, 0.0 elsewhere. cells are sorted and their positions distinct."""
    before = lambda i: F.coalesce(F.get(cells, i - 1)["pos"], F.lit(-1))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    runs = F.transform(cells, lambda c, i: F.concat(zeros(c["pos"] - before(i) - 1), F.array(c["val"])))
    return F.concat(F.flatten(runs), zeros(F.lit(length) - 1 - before(F.size(cells))))


def sorted_cells(pos: Column, val: Column) -> Column:
    """An aggregate: the group's (pos, val) structs by position; null positions are left out."""
    return F.sort_array(F.collect_list(F.when(pos.isNotNull(), F.struct(pos.cast("long").alias("pos"), val.alias("val")))))
