"""Text reports of matrices and vectors, from bounded heads of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsemill.operators import convert
from sparsemill.operators.partition import NOT_FOUND
from sparsemill.schema import HybridLayout, Matrix, Vector

# fixed values: how much of each part is shown
HEAD, BLOCKS, OFFSETS, LANES, DIAGONALS, POSITIONS, RANGES, DENSE, NUMERIC = 10, 5, 10, 8, 10, 50, 3, 100, 20


def _number(v: float, digits: int = 2) -> str:
    return "." if v == 0 else f"{v:.{digits}f}"


def _row(cells: list[str]) -> str:
    width = max([4, *map(len, cells)])
    return " ".join(c.rjust(width) for c in cells)


def coo_head(coo: DataFrame, n: int = HEAD) -> DataFrame:
    """The first n entries by (row, col), or as they were read where there is a seq column."""
    order = ["seq"] if "seq" in coo.columns else ["row", "col"]
    return coo.orderBy(*order).limit(n).select("row", "col", "val")


def density(m: Matrix) -> DataFrame:
    """Cells, entries and the percentage of cells that are not zero."""
    cells = m.num_rows * m.num_cols
    n = convert.dedup(m.coo).where("val != 0").agg(F.count("*").alias("nnz"))
    return n.select(F.lit(cells).cast("long").alias("cells"), "nnz", F.try_divide(F.col("nnz") * F.lit(100.0), F.lit(float(cells))).alias("density_percent"))


def header(m: Matrix) -> str:
    lines = [f"{m.num_rows} x {m.num_cols}"]
    if m.partial:
        lines.append(f"part {m.part} of {m.parts}; whole: {m.global_rows} x {m.global_cols}, {m.global_nnz} entries")
    return "\n".join(lines)


def formats(m: Matrix) -> str:
    return "encodings: " + (", ".join(e for e in ("coo", "dia", "hybrid") if m.has(e)) or "none")


def coo(m: Matrix) -> str:
    rows = coo_head(m.coo, HEAD + 1).collect()
    lines = ["row\tcol\tvalue", *(f"{r['row']}\t{r['col']}\t{_number(r['val'], 6)}" for r in rows[:HEAD])]
    return "\n".join(lines + ["... and more entries"] * (len(rows) > HEAD))


def dia(m: Matrix, block_width: int = 0) -> str:
    """The first diagonals and positions, with a bar at each block's end; symbols where there are many diagonals."""
    n = m.dia.count()
    rows = m.dia.orderBy("offset").limit(DIAGONALS).select("offset", F.slice("diag", 1, POSITIONS).alias("d"), F.size("diag").alias("n")).collect()
    lines = [f"{n} diagonals"]
    for r in rows:
        cells = [("*" if v else ".") if n > 20 else _number(v) for v in r["d"]]
        parts = [_row(cells[i : i + block_width]) for i in range(0, len(cells), block_width)] if block_width else [_row(cells)]
        lines.append(f"offset {r['offset']:>6}: " + " | ".join(parts) + (" ..." if r["n"] > POSITIONS else ""))
    return "\n".join(lines + [f"... and {n - DIAGONALS} more diagonals"] * (n > DIAGONALS))


def hybrid(layout: HybridLayout) -> str:
    w = layout.block_width
    sizes = layout.kept.groupBy("block").agg(F.count("*").alias("n"))
    active, groups = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shown = {r["block"]: r["n"] for r in sizes.orderBy("block").limit(BLOCKS).collect()}
    left = layout.fallback.count()
    lines = [f"block width {w}, threshold {layout.threshold}, {groups * w} stored cells, {left} fallback entries"]
    few = HybridLayout(layout.kept.where(F.col("block").isin(*shown)), layout.entries.where(F.col("block").isin(*shown)), layout.counts, layout.num_rows, layout.num_cols, w, layout.threshold, layout.max_fallback)
    lanes = convert.blocks(few).select("block", "offset", F.slice("lanes", 1, LANES).alias("v")).orderBy("block", "offset").collect() if shown else []
    for b, n in shown.items():
        own = [r for r in lanes if r["block"] == b]
        lines.append(f"block {b} (rows {b * w}-{(b + 1) * w - 1}): offsets {' '.join(str(r['offset']) for r in own)}")
        lines += [f"  offset {r['offset']:>6}: " + _row([_number(v) for v in r["v"]]) + (" ..." if w > LANES else "") for r in own[:OFFSETS]]
        lines += [f"  ... and {n - OFFSETS} more offsets"] * (n > OFFSETS)
    lines += [f"... and {active - BLOCKS} more active blocks"] * (active > BLOCKS)
    lines.append(f"{active} active blocks of {layout.num_blocks}")
    rows = layout.fallback.orderBy("row", "col").limit(HEAD).collect()
    lines += [f"{r['row']}\t{r['col']}\t{_number(r['val'], 6)}" for r in rows]
    return "\n".join(lines + [f"... and {left - HEAD} more fallback entries"] * (left > HEAD))


def dense_cells(m: Matrix) -> DataFrame:
    """row, col, val of what m holds, from the first encoding of coo, dia, hybrid that it has."""
    if m.has("coo"):
        return convert.dedup(m.coo).select("row", "col", "val")
    return convert.dia_to_coo(m.dia, m.dia_segment) if m.has("dia") else convert.hybrid_to_coo(m.hybrid)


def dense(m: Matrix) -> str:
    """Numbers up to 20 columns, symbols up to 100 x 100, beyond that the density alone."""
    cells = dense_cells(m)
    if m.num_rows > DENSE or m.num_cols > DENSE:
        n, every = cells.where("val != 0").count(), m.num_rows * m.num_cols
        return f"density {100 * n / every:.4f} %"
    at = {(r["row"], r["col"]): r["val"] for r in cells.collect()}
    show = (lambda v: _number(v)) if m.num_cols <= NUMERIC else (lambda v: "*" if v else ".")
    text = [[show(at.get((r, c), 0.0)) for c in range(m.num_cols)] for r in range(m.num_rows)]
    if m.num_cols > NUMERIC:
        return "\n".join("".join(r) for r in text)
    width = max([4, *(len(c) for r in text for c in r)])
    return "\n".join(" ".join(c.rjust(width) for c in r) for r in text)


def ranges(data_ranges: DataFrame, owned: DataFrame | None = None, limit: int | None = RANGES) -> str:
    """The first (or all) ranges of each part, their totals, and the amounts by owner."""
    length = F.col("range_end") - F.col("range_start")
    totals = {r["part"]: (r["n"], r["t"]) for r in data_ranges.groupBy("part").agg(F.count("*").alias("n"), F.sum(length).alias("t")).collect()}
    lines = []
    for p in sorted(totals):
        n, t = totals[p]
        own = data_ranges.where(F.col("part") == p).orderBy("range_start")
        rows = (own if limit is None else own.limit(limit)).collect()
        lines.append(f"part {p}: {n} ranges, {t} elements: " + " ".join(f"[{r['range_start']},{r['range_end']})" for r in rows) + (" ..." if len(rows) < n else ""))
    if owned is not None:
        for r in owned.groupBy("part", "owner").agg(F.count("*").alias("n"), F.sum(length).alias("t")).orderBy("part", "owner").collect():
            lines.append(f"part {r['part']} from {r['owner']}: {r['n']} ranges, {r['t']} elements")
    return "\n".join(lines)


def flattened(layout: HybridLayout, positions: DataFrame | None = None) -> str:
    """Heads of the storage arrays."""
    directory = convert.block_directory(layout.kept, layout.num_blocks).orderBy("block").limit(HEAD).collect()
    offsets = convert.flattened_offsets(layout.kept).orderBy("pos").limit(HEAD).collect()
    lines = ["block starts: " + " ".join(str(r["block_start"]) for r in directory), "block sizes: " + " ".join(str(r["block_size"]) for r in directory if r["block"] < layout.num_blocks), "offsets: " + " ".join(str(r["offset"]) for r in offsets)]
    if positions is not None:
        head = positions.orderBy("part", "block", "offset").limit(HEAD).collect()
        lines.append("vector offsets: " + " ".join("-" if r["position"] == NOT_FOUND else str(r["position"]) for r in head))
    return "\n".join(lines)


def vector(v: Vector, n: int = HEAD) -> str:
    rows = v.df.orderBy("idx").limit(n).collect()
    left, right = v.halo
    head = " ".join(_number(r["x"], 6) for r in rows)
    return f"{v.size} elements, layout [left {left}, local {v.size}, right {right}]\n{head}" + (" ..." if v.size > n else "")


def describe(m: Matrix, data_ranges: DataFrame | None = None, owned: DataFrame | None = None) -> str:
    """The full report, in the order header, encodings, each encoding, ranges, storage arrays, picture."""
    parts = [header(m), formats(m)]
    if m.has("coo"):
        parts.append(coo(m))
    if m.has("hybrid"):
        parts.append(hybrid(m.hybrid))
    if m.has("dia"):
        parts.append(dia(m))
    if data_ranges is not None:
        parts.append(ranges(data_ranges, owned))
    if m.has("hybrid"):
        parts.append(flattened(m.hybrid))
    return "\n\n".join([*parts, dense(m)])
