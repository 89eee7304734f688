"""Layouts and products against golden values, plain Python and each other."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparsemill.functions.costs import matrix_info, storage_cost
from sparsemill.functions.exact import repeatable_sums
from sparsemill.functions.prefix import scan
from sparsemill.operators import convert as cv
from sparsemill.operators import partition as pt
from sparsemill.operators import spmv as mv
from sparsemill.operators import stored
from sparsemill.plans import report
from sparsemill.schema import ENTRY, VECTOR, Matrix, Vector
from sparsemill.sources import matrix as src
from sparsemill.sources import sinks

SMALL = [(0, 0, 1), (0, 2, 2), (1, 0, 3), (1, 1, 4), (1, 2, 5), (2, 1, 6), (2, 2, 7)]


def entries(spark, rows):
    return spark.createDataFrame([(int(r), int(c), float(v)) for r, c, v in rows], ENTRY)


def vec(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], VECTOR)


def banded():
    out = [(i, i, 5 + 0.1 * i) for i in range(20)] + [(i, i + 1, 2 + 0.05 * i) for i in range(19)] + [(i, i - 1, 1 + 0.05 * i) for i in range(1, 20)]
    return out + [(i, i + 2, 0.5 + 0.02 * i) for i in range(0, 18, 3)] + [(r, c, 0.3) for r, c in ((2, 15), (5, 18), (10, 3), (15, 8), (18, 19))]


def triples(df):
    return sorted((r["row"], r["col"], round(r["val"], 9)) for r in df.collect())


def ys(df):
    return [r["y"] for r in df.orderBy("idx").collect()]


def test_small(spark):
    m = Matrix.from_df(entries(spark, SMALL))
    assert (m.num_rows, m.num_cols, m.nnz) == (3, 3, 7)
    d = cv.to_dia(m)
    assert {r["offset"]: r["diag"] for r in d.dia.collect()} == {-1: [0, 3, 6], 0: [1, 4, 7], 1: [0, 5, 0], 2: [2, 0, 0]}
    h = cv.to_hybrid(m, block_width=4, threshold=2)
    assert {r["offset"]: r["lanes"] for r in cv.blocks(h.hybrid).collect()} == {-1: [0, 3, 6, 0], 0: [1, 4, 7, 0]}
    assert triples(h.hybrid.fallback) == [(0, 2, 2), (1, 2, 5)]
    assert ys(mv.spmv(h, src.ramp(spark, 3), strategy="block").df.withColumnRenamed("x", "y")) == [4, 14, 20]
    assert ys(mv.spmv(m, src.ramp(spark, 3, 1)).df.withColumnRenamed("x", "y")) == [7, 26, 33]
    assert triples(cv.dia_to_coo(d.dia)) == triples(m.coo)


def test_banded(spark):
    m = cv.to_hybrid(Matrix.from_df(entries(spark, banded()), num_rows=20, num_cols=20), block_width=8, threshold=3)
    assert sorted(r["offset"] for r in cv.diagonals(m.coo).collect()) == [-7, -1, 0, 1, 2, 13]
    assert sorted((r["block"], r["offset"]) for r in m.hybrid.kept.collect()) == [(0, -1), (0, 0), (0, 1), (0, 2), (1, -1), (1, 0), (1, 1), (1, 2), (2, -1), (2, 0), (2, 1)]
    assert (cv.check_storage(m.hybrid), m.hybrid.cells.count()) == (88, 64)
    assert triples(m.hybrid.fallback) == [(2, 15, 0.3), (5, 18, 0.3), (10, 3, 0.3), (15, 8, 0.3)]
    assert sorted(map(tuple, cv.block_histogram(m.hybrid).collect())) == [(3, 1, 11), (4, 2, 53)]
    golden = [300, 920, 2230, 2960, 3620, 5140, 6116, 6680, 7780, 9668, 10190, 11320, 13616, 13880, 15220, 18200, 18020, 19480, 21550, 16620]
    for strategy in ("join", "block"):
        assert [round(100 * y) for y in ys(mv.spmv_hybrid(m.hybrid, src.ramp(spark, 20).df, strategy=strategy))] == golden


@pytest.mark.parametrize("n, nnz, total, first", [(8, 10648, 254154564, -7314), (16, 97336, 15767632260, -33514)])
def test_stencil(spark, n, nnz, total, first):
    m = cv.to_hybrid(src.stencil27(spark, n, n, n, scale=1), threshold=2, assume_unique=True)
    assert m.nnz == nnz == (3 * n - 2) ** 3
    y = ys(mv.spmv_hybrid(m.hybrid, src.ramp(spark, n**3, 1).df, strategy="block"))
    assert (sum(y), y[0]) == (total, first)
    assert m.hybrid.fallback.count() == 0


def test_stencil_shapes_and_noise(spark):
    m = src.stencil27(spark, 3, 4, 5)
    assert m.nnz == 7 * 10 * 13
    assert m.coo.where("row = 31 and col = 31").first()["val"] == pytest.approx(26.1)
    a, b = (src.stencil27(spark, 4, 4, 4, noise=0.2).coo for _ in range(2))
    assert triples(a) == triples(b)
    clean = {(r, c) for r, c, _ in triples(src.stencil27(spark, 4, 4, 4).coo)}
    added = [t for t in triples(a) if (t[0], t[1]) not in clean]
    assert 0 < len(added) <= int(27 * 64 * 0.2) and all(-1 < v < 1 for _, _, v in added)
    assert len({(r, c) for r, c, _ in triples(a)}) == a.count()


def greedy(groups, threshold, cap):
    kept, fell = [], 0
    for b, o, n in sorted(groups):
        if n >= threshold or fell >= cap:
            kept.append((b, o))
        else:
            fell += n
    return kept


@pytest.mark.parametrize("shape", [(12, 12), (3, 10), (40, 3), (33, 33)])
@pytest.mark.parametrize("width, threshold, cap", [(8, 2, None), (4, 2, 0), (4, 3, 7)])
def test_layout_does_not_change_the_product(spark, shape, width, threshold, cap):
    rng = random.Random(f"{shape}{width}{threshold}{cap}")
    rows = [(rng.randrange(shape[0]), rng.randrange(shape[1]), rng.randint(-3, 3)) for _ in range(60)]
    m = cv.to_hybrid(Matrix.from_df(entries(spark, rows), num_rows=shape[0], num_cols=shape[1]), block_width=width, threshold=threshold, max_fallback=cap)
    x = [rng.randint(-5, 5) for _ in range(shape[1])]
    want = [0.0] * shape[0]
    for r, c, v in rows:
        want[r] += v * x[c]
    for strategy in ("join", "block"):
        assert ys(mv.spmv_hybrid(m.hybrid, vec(spark, x), strategy=strategy)) == want
    cells = {(r, c) for r, c, _ in rows}
    assert m.hybrid.cells.count() + m.hybrid.fallback.count() == len(cells)
    if cap is not None:
        groups = [(r["block"], r["offset"], r["n"]) for r in m.hybrid.counts.collect()]
        assert sorted((r["block"], r["offset"]) for r in m.hybrid.kept.collect()) == greedy(groups, threshold, cap)
    ptr = [r["ptr"] for r in cv.fallback_row_ptr(m.hybrid.fallback, shape[0]).orderBy("row").collect()]
    per_row = [sum(1 for t in triples(m.hybrid.fallback) if t[0] == r) for r in range(shape[0])]
    assert ptr == [sum(per_row[:k]) for k in range(shape[0] + 1)]


def test_zero_times_nan(spark):
    m = cv.to_hybrid(Matrix.from_df(entries(spark, [(0, 0, 0), (0, 1, 2)]), num_rows=2, num_cols=2), block_width=2)
    x = vec(spark, [float("nan"), 3])
    for y in (mv.spmv_coo(m.coo, x, 2), mv.spmv_hybrid(m.hybrid, x, strategy="block")):
        assert ys(y) == [6, 0]


def test_empty_and_errors(spark):
    m = cv.to_hybrid(cv.to_dia(Matrix.empty(spark)))
    assert m.hybrid.kept.count() == 0 and m.dia.count() == 0 and cv.block_directory(m.hybrid.kept, 0).count() == 1
    with pytest.raises(ValueError):
        Matrix.from_df(entries(spark, SMALL), num_rows=0, num_cols=3)
    with pytest.raises(IndexError):
        Matrix.from_df(entries(spark, SMALL), num_rows=2, num_cols=3)
    with pytest.raises(ValueError):
        Matrix.from_df(spark.createDataFrame([(0, None, 1.0)], ENTRY))
    with pytest.raises(ValueError):
        Matrix.from_df(entries(spark, SMALL)).without("coo")
    both = cv.to_dia(Matrix.from_df(entries(spark, SMALL)))
    assert not both.without("coo").has("coo") and both.has("coo")
    with pytest.raises(ValueError):
        both.with_row_map(spark.createDataFrame([(0, 5)], "row long, global_row long"))


def test_last_writer(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 1), (0, 0, 5.0, 3), (0, 0, 2.0, 2)], "row long, col long, val double, seq long")
    assert triples(cv.dedup(df, "last")) == [(0, 0, 5)] and triples(cv.dedup(df)) == [(0, 0, 8)]


@pytest.mark.parametrize("parts, want", [
    (2, {0: [(0, 329)], 1: [(183, 512)]}),
    (3, {0: [(0, 243)], 1: [(97, 413)], 2: [(267, 512)]}),
])
def test_halo_of_the_stencil(spark, parts, want):
    m = src.stencil27(spark, 8, 8, 8, scale=1)
    dealt = pt.partition_rows(m.coo, 512, parts)
    layout = pt.part_layout(dealt, 512, 512, parts, 32, 2)
    ranges = pt.data_ranges(pt.needed_columns(dealt, layout, 512, 512, parts, 32))
    got = {}
    for r in ranges.orderBy("part", "range_start").collect():
        got.setdefault(r["part"], []).append((r["range_start"], r["range_end"]))
    assert got == want
    owned = pt.owner_ranges(ranges, 512, parts)
    assert owned.selectExpr("sum(range_end - range_start)").first()[0] == ranges.selectExpr("sum(range_end - range_start)").first()[0]
    y = pt.distributed_spmv(m, src.ramp(spark, 512), parts)
    assert mv.compare_vectors(y.withColumnRenamed("y", "x"), mv.spmv_coo(m.coo, src.ramp(spark, 512).df, 512).withColumnRenamed("y", "x")).first()["max_abs_error"] == 0
    assert pt.verify_halo(pt.halo(src.ramp(spark, 512).df, dealt, 512, parts)).where("wrong > 0").count() == 0
    if parts == 2:
        assert sorted((r["part"], r["owner"], r["range_start"], r["range_end"]) for r in owned.collect()) == [(0, 0, 0, 256), (0, 1, 256, 329), (1, 0, 183, 256), (1, 1, 256, 512)]
        assert pt.vector_offsets(layout, owned, 512, 2, 32).where(f"position = {pt.NOT_FOUND}").count() == 0


def test_more_parts_than_rows(spark):
    m = Matrix.from_df(entries(spark, SMALL))
    stats = pt.row_partition_stats(m.coo, 3, 3, 5).orderBy("part").collect()
    assert [(r["local_rows"], r["local_nnz"]) for r in stats] == [(0, 0)] * 4 + [(3, 7)]
    assert ys(pt.distributed_spmv(m, src.ramp(spark, 3), 5)) == [4, 14, 20]
    with pytest.raises(ValueError):
        pt.partition_vector(vec(spark, []), 0, 2)
    with pytest.raises(ValueError):
        pt.partition_rows(m.coo, 3, 0)
    s = pt.shard(m, 2, 1)
    assert (s.num_rows, s.partial, triples(s.coo)[0]) == (2, True, (0, 0, 3.0))
    assert [r["offset"] for r in cv.diagonals(s.coo).orderBy("offset").collect()] == [-1, 0, 1]


MTX = "%%MatrixMarket matrix coordinate {kind}\n% note\n\n3 3 {n}\n1 1 2.5\n3 1 4\nbad line\n2 3 -1\n"


@pytest.mark.parametrize("kind, want", [
    ("real general", [(0, 0, 2.5), (1, 2, -1), (2, 0, 4)]),
    ("real symmetric", [(0, 0, 2.5), (0, 2, 4), (1, 2, -1), (2, 0, 4), (2, 1, -1)]),
    ("real skew-symmetric", [(0, 0, 2.5), (0, 2, -4), (1, 2, -1), (2, 0, 4), (2, 1, 1)]),
])
def test_mtx(spark, tmp_path, kind, want):
    f = tmp_path / "a.mtx"
    f.write_text(MTX.format(kind=kind, n=3))
    assert triples(src.read_mtx(spark, str(f)).coo) == want
    f.write_text(MTX.format(kind=kind, n=1))
    assert src.read_mtx(spark, str(f)).coo.where("row = 0 and col = 0").count() == 1
    assert src.read_mtx(spark, str(f)).coo.count() == 1
    assert src.read_mtx(spark, str(f), num_rows=9, num_cols=9).num_rows == 9
    f.write_text(MTX.format(kind=kind, n=3))
    with pytest.raises(IndexError):
        src.read_mtx(spark, str(f), num_rows=2, num_cols=2)


def test_mtx_pattern_and_errors(spark, tmp_path):
    f = tmp_path / "b.mtx"
    f.write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 2\n1 2\n2 1\n")
    assert triples(src.read_mtx(spark, str(f)).coo) == [(0, 1, 1), (1, 0, 1)]
    f.write_text("%%MatrixMarket matrix array real general\n2 2\n1\n2\n")
    with pytest.raises(ValueError):
        src.read_mtx(spark, str(f))
    with pytest.raises(FileNotFoundError):
        src.read_mtx(spark, str(tmp_path / "none.mtx"))


def test_costs(spark):
    m = cv.to_hybrid(src.stencil27(spark, 8, 8, 8, scale=1), threshold=2, assume_unique=True)
    r = storage_cost(m).first()
    assert [r[f"{k}_cost_bytes"] for k in ("hybrid", "coo", "csr", "sell", "dia")] == [103028, 170368, 129828, 152128, 110700]
    info = matrix_info(m, "grid", nx=8, ny=8, nz=8, flags={"execCOOCPU": True}).first()
    assert (info["rows"], info["execCOOCPU"], info["execCOOGPU"], info["hybrid_data_size"]) == (512, 1, 0, 12672)


def test_reports(spark):
    m = cv.to_dia(cv.to_hybrid(Matrix.from_df(entries(spark, SMALL)), block_width=4, threshold=2))
    text = report.describe(m)
    assert "3 x 3" in text and "coo, dia, hybrid" in text and "1 active blocks of 1" in text and "2 fallback entries" in text
    assert report.dense(m.without("coo")) == report.dense(m) == report.dense(m.without("coo").without("dia"))
    assert "density" in report.dense(src.stencil27(spark, 8, 8, 8))
    assert report.vector(src.ramp(spark, 12)).startswith("12 elements")
    assert "*" in report.dense(Matrix.from_df(entries(spark, SMALL), num_rows=3, num_cols=30))


def test_vectors(spark):
    v = Vector.from_df(vec(spark, [1, 2, 3]))
    assert sorted(map(tuple, mv.vector_add(v.df, vec(spark, [1, 1])).collect())) == [(0, 2), (1, 3), (2, 3)]
    assert not mv.accurate(v.df, vec(spark, [1, 2, 4])) and mv.accurate(v.df, v.df)
    with pytest.raises(ValueError):
        mv.spmv(Matrix.from_df(entries(spark, SMALL)), Vector(v.df, 2))
    p = pt.partition_vector(v.df, 3, 2)
    assert [r["x"] for r in pt.gather(p).collect()] == [1, 2, 3]


def test_diagonals_in_segments(spark):
    """Segments of any length give the matrix and the product back; those without entries are not stored."""
    rng = random.Random(11)
    rows = [(rng.randrange(40), rng.randrange(30), float(rng.choice([0, 1, 2, 5]))) for _ in range(90)] + [(39, 0, 4.0), (35, 29, 1.5)]
    m = Matrix.from_df(entries(spark, rows), num_rows=40, num_cols=30)
    x = [1.0 + k * k for k in range(30)]
    want, sums = [0.0] * 40, {}
    for r, c, v in rows:
        sums[r, c] = sums.get((r, c), 0.0) + v
        want[r] += v * x[c] if r < 30 else 0.0  # rows beyond min(rows, columns) are left out
    vector = spark.createDataFrame(list(enumerate(x)), "idx long, x double")
    for segment in (1, 7, 16, 1000):
        d = cv.to_dia(m, segment=segment)
        stored = d.dia.collect()
        assert {(r["offset"], r["seg"]) for r in stored} == {(c - r, r // segment if r < 30 else 0) for r, c in sums}
        assert all(len(r["diag"]) == min(segment, 30 - r["seg"] * segment) for r in stored)
        assert triples(cv.dia_to_coo(d.dia, segment)) == sorted((r, c, v) for (r, c), v in sums.items() if r < 30 and v)
        got = {r["idx"]: r["y"] for r in mv.spmv_dia(d, vector).collect()}
        assert [got[k] for k in range(40)] == pytest.approx(want)
    with pytest.raises(ValueError):
        cv.to_dia(m, segment=0)


def test_heavy_columns(spark):
    """A column in half of all entries is found, its entries are not joined on it, and the product is as ever."""
    rng = random.Random(12)
    rows = [(rng.randrange(500), 7 if k % 2 else rng.randrange(5000), float(rng.randrange(9))) for k in range(6000)]
    coo, x = entries(spark, rows), spark.createDataFrame([(k, float(k % 13)) for k in range(0, 5000, 3)] + [(7, 2.0)], "idx long, x double")
    heavy = {r["col"] for r in mv.heavy_columns(coo).collect()}
    assert 7 in heavy and len(heavy) <= mv.HEAVY * 3 // 2
    assert mv.heavy_columns(coo.where("false")).count() == 0
    at = {k: float(k % 13) for k in range(0, 5000, 3)} | {7: 2.0}
    want = [0.0] * 500
    for r, c, v in rows:
        want[r] += v * at.get(c, 0.0)
    got = {r["idx"]: r["y"] for r in mv.spmv_coo(coo, x, 500).collect()}
    assert [got[k] for k in range(500)] == pytest.approx(want)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = mv.partial_products(coo, x)
        assert [got[k] for k in range(500)] == pytest.approx([r["y"] for r in mv.total(parts, 500).orderBy("idx").collect()])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_scan_of_one_hot_block(spark):
    """Running sums over (block, offset) where one block has nearly all groups, in ranges that are bounded by rows."""
    rng = random.Random(13)
    rows = [(0 if k % 20 else k, k * 7919 % 100_003, rng.randrange(4)) for k in range(3000)]
    df = spark.createDataFrame(rows, "block long, offset long, n long")
    got = scan(df, {"before": F.col("n"), "pos": F.lit(1).cast("long")}, order=("block", "offset")).collect()
    want, at = {}, 0
    for k, (b, o, n) in enumerate(sorted(rows)):
        want[b, o] = (at, k)
        at += n
    assert {(r["block"], r["offset"]): (r["before"], r["pos"]) for r in got} == want
    by = scan(df, {"before": F.col("n")}, order=("offset",), by=("block",)).collect()
    for r in by:
        assert r["before"] == sum(n for b, o, n in rows if b == r["block"] and o < r["offset"]) or r["block"]
    assert scan(df.where("false"), {"before": F.col("n")}, order=("block", "offset")).count() == 0


def test_mtx_odd_blanks(spark, tmp_path):
    """Any run of blanks parts a line; a blank that is not trimmed before the row makes it one that does not parse."""
    f = tmp_path / "odd.mtx"
    lines = ["1 1 2", "2   3\t4", " \t3 1 5 ", "1 2", "\f1 3 9", "2\f2 7", "2 1\v1 3", "x y z", "3 2 1e1 more", "3 3 abc", "4", "", "1 4 0x", "4 4 -1.5"]
    f.write_text("%%MatrixMarket matrix coordinate real general\n% skew lines\n4 4 14\n" + "\n".join(lines) + "\n")
    assert triples(src.read_mtx(spark, str(f)).coo) == [(0, 0, 2), (0, 1, 1), (1, 0, 1), (1, 1, 7), (1, 2, 4), (2, 0, 5), (2, 1, 10), (3, 3, -1.5)]


def test_mtx_sums_repeated_cells(spark, tmp_path):
    """Cells are summed in the ranges that the file is written in, with no exchange before."""
    m = Matrix.from_df(entries(spark, [(k % 7, k % 3, 1.0) for k in range(210)]), num_rows=7, num_cols=3, bound=210)
    sinks.save_mtx(m, str(tmp_path / "m"), "sum")
    assert triples(src.read_mtx(spark, str(tmp_path / "m")).coo) == [(r, c, 10) for r in range(7) for c in range(3)]


def test_mtx_in_many_parts(spark, tmp_path):
    """Parts put behind one another are one file; the folder reads back as it is, with its header in the first part."""
    rng = random.Random(14)
    rows = sorted({(rng.randrange(60), rng.randrange(50)): float(rng.randrange(1, 9)) for _ in range(700)}.items())
    m = Matrix.from_df(entries(spark, [(r, c, v) for (r, c), v in rows]), num_rows=60, num_cols=50)
    path = str(tmp_path / "m.mtx")
    sinks.save_mtx(m, path)
    parts = sorted(p for p in (tmp_path / "m.mtx").iterdir() if p.name.startswith("part-"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert len(parts) > 1 and lines[0].startswith("%%MatrixMarket") and lines[1] == f"60 50 {len(rows)}"
    assert lines[2:] == [f"{r + 1} {c + 1} {v}" for (r, c), v in rows]
    whole = tmp_path / "one.mtx"
    whole.write_text("\n".join(lines) + "\n")
    for p in (path, str(whole)):
        back = src.read_mtx(spark, p)
        assert (back.num_rows, back.num_cols) == (60, 50) and triples(back.coo) == [(r, c, v) for (r, c), v in rows]
    sinks.save_mtx(Matrix.from_df(entries(spark, []), num_rows=3, num_cols=4), str(tmp_path / "none"))
    assert src.read_mtx(spark, str(tmp_path / "none")).coo.count() == 0


def test_sums_are_the_same_bits_in_any_order(spark):
    """For any number of partitions and any order, and as close as exact addition; odd values as plain addition has them."""
    rng = random.Random(15)
    rows = [(k % 5, rng.choice([-1, 1]) * 10.0 ** rng.uniform(-12, 12)) for k in range(4000)] + [(5, 0.1)] * 1000 + [(6, 1e300), (6, -1e300), (6, 1e290)] + [(7, float("inf")), (7, 1.0), (8, float("nan")), (8, 2.0), (9, None)]
    seen = set()
    for parts in (1, 3, 16):
        df = spark.createDataFrame(rng.sample(rows[:5000], 5000), "row long, y double").repartition(parts)
        seen.add(tuple((r["row"], r["y"]) for r in repeatable_sums(df, ["row"], y=F.col("y")).orderBy("row").collect()))
    assert len(seen) == 1
    for row, y in next(iter(seen)):
        own = [v for r, v in rows[:5000] if r == row]
        assert y == pytest.approx(math.fsum(own), rel=1e-15, abs=len(own) * 2.0**-90 * 1e12)
    odd = {r["row"]: r["y"] for r in repeatable_sums(spark.createDataFrame(rows[5000:], "row long, y double"), ["row"], y=F.col("y")).collect()}
    assert odd[6] == 1e290 and odd[7] == float("inf") and math.isnan(odd[8]) and odd[9] is None
    cells = spark.createDataFrame([(k % 3, 0, v) for k, (_, v) in enumerate(rows[:900])], ENTRY)
    assert len({tuple(sorted(map(tuple, cv.dedup(cells.repartition(p), repeatable=True).collect()))) for p in (1, 7)}) == 1
    v = spark.createDataFrame([(k, v) for k, (_, v) in enumerate(rows[:500])], "idx long, x double")
    assert len({tuple(mv.compare_vectors(v.repartition(p), v).first()) for p in (1, 2, 9)}) == 1
    assert mv.vector_add(v, v, repeatable=True).where("idx = 3").first()["x"] == 2 * rows[3][1]
    assert mv.compare_vectors(v.where("false"), v.where("false")).first()["sum_abs_a"] == 0.0


def test_stored_matrix(spark):
    """Products over buckets on disk: right, with a heavy column too, and without an exchange of entries."""
    rng = random.Random(16)
    rows = [(rng.randrange(60), 3 if k % 3 == 0 else rng.randrange(80), float(rng.randrange(5))) for k in range(900)]
    m = Matrix.from_df(entries(spark, rows), num_rows=60, num_cols=80)
    kept = stored.store(m, buckets=4)
    for shift in (1, 2):
        x = [float(k * shift % 11) for k in range(80)]
        want = [0.0] * 60
        for r, c, v in rows:
            want[r] += v * x[c]
        got = kept.multiply(Vector(vec(spark, x), 80)).df.orderBy("idx").collect()
        assert [r["x"] for r in got] == pytest.approx(want)
    wide = stored.StoredMatrix(spark, kept.name, kept.heavy, kept.columns, 60, 80).products(vec(spark, range(80)))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1  # that of x
    with pytest.raises(ValueError):
        kept.multiply(Vector(vec(spark, [1.0]), 1))
    kept.drop()
    assert not spark.catalog.tableExists(kept.name)
