"""All queries of the sparse-matrix operators over the driver's tables, and their SQL."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsemill.functions import normal
from sparsemill.functions import resampling as rs
from sparsemill.functions import statistics as st
from sparsemill.functions.costs import matrix_info, storage_cost
from sparsemill.operators import analysis as an
from sparsemill.operators import convert as cv
from sparsemill.operators import partition as pt
from sparsemill.operators import spmv as mv
from sparsemill.operators import stored
from sparsemill.plans import report, run
from sparsemill.schema import Matrix
from sparsemill.sources import matrix as src
from sparsemill.sources import sinks
from sparsemill.sources.shared import materialise, new_path

WIDTH, DENSE, CAP, PARTS, SHARD_WIDTH = 32, 2, 20_000, 4, 16


def _load(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def square(spark: SparkSession, d: str) -> Matrix:
    """Order key modulo the number of parts x part key: quantity."""
    n, lines = _load(spark, d, "part").count(), _load(spark, d, "lineitem")
    coo = lines.select((F.col("l_orderkey") % n).alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))
    return Matrix.from_df(coo, num_rows=n, num_cols=n, check=False, bound=lines.count())


def wide(spark: SparkSession, d: str) -> Matrix:
    """Supplier x part: quantity, with repeated cells."""
    coo = _load(spark, d, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))
    return Matrix.from_df(coo, num_rows=_load(spark, d, "supplier").count(), num_cols=_load(spark, d, "part").count(), check=False)


def tall(spark: SparkSession, d: str) -> Matrix:
    """User x hour of day: events."""
    coo = _load(spark, d, "events").select(F.col("user_id").alias("row"), F.hour("ts").alias("col"), F.lit(1.0).alias("val"))
    rows = (_load(spark, d, "events").agg(F.max("user_id")).first()[0] or 0) + 1  # one empty row where there are no events
    return Matrix.from_df(coo, num_rows=rows, num_cols=24, check=False)


def tall_squared(spark: SparkSession, d: str) -> Matrix:
    """The user x hour matrix with empty columns (or rows) up to a square, so that diagonals reach every row."""
    m = tall(spark, d)
    n = max(m.num_rows, m.num_cols)
    return Matrix.from_df(m.coo, num_rows=n, num_cols=n, check=False)


def sizes_vector(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("x"))


def laid_out(spark: SparkSession, d: str, cap: int | None = CAP) -> Matrix:
    return cv.to_hybrid(square(spark, d), block_width=WIDTH, threshold=DENSE, max_fallback=cap)


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """Events as measurements of two methods at five noise levels."""
    e = _load(spark, d, "events")
    method = F.when(F.col("event_type") == "click", "baseline").when(F.col("event_type") == "view", "hybrid")
    rows = e.select(((F.col("user_id") % 5) / 10.0).alias("noise_level"), F.expr("event_id div 100").alias("iteration"), F.col("value").alias("time_ms"), method.alias("method"), "event_id")
    return rows.where("method is not null")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when Python ends at the latest."""
    return new_path(spark, name)


def _parts(spark: SparkSession, d: str) -> tuple[Matrix, DataFrame, DataFrame]:
    """The square matrix, its entries in parts, and its parts' layouts."""
    m = square(spark, d)
    dealt = pt.unique_parts(m, PARTS, SHARD_WIDTH)
    return m, dealt, pt.part_layout(dealt, m.num_rows, m.num_cols, PARTS, SHARD_WIDTH, DENSE, assume_unique=True)


def _shards(spark: SparkSession, d: str) -> tuple[Matrix, DataFrame, DataFrame, DataFrame]:
    """The square matrix in parts, its parts' layouts, needed ranges and their owners."""
    m, dealt, layout = _parts(spark, d)
    needed = pt.needed_columns(dealt, layout, m.num_rows, m.num_cols, PARTS, SHARD_WIDTH)
    ranges = materialise(pt.data_ranges(needed), "ranges")  # few rows, which the queries read several times
    return m, layout, ranges, pt.owner_ranges(ranges, m.num_cols, PARTS)


# ---------------------------------------------------------------- queries

QUERIES: dict = {}
ORACLES: dict = {}
_U = 'e AS (SELECT l_orderkey % (SELECT count(*) FROM part) AS "row", l_partkey AS col, l_quantity AS val FROM lineitem), u AS (SELECT "row", col, sum(val) AS val FROM e GROUP BY 1, 2)'
_N = "(SELECT count(*) FROM part)"
_K = f"""{_U}, c AS (SELECT "row" // 32 AS block, col - "row" AS off, "row" % 32 AS lane, "row", col, val FROM u),
g AS (SELECT block, off, count(*) AS n FROM c GROUP BY 1, 2),
k AS (SELECT *, n >= 2 OR coalesce(sum(CASE WHEN n < 2 THEN n ELSE 0 END) OVER (ORDER BY block, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 20000 AS kept FROM g)"""
_M = """m AS (SELECT (user_id % 5) / 10.0::DOUBLE AS noise_level, event_id // 100 AS iteration, value AS time_ms, event_id,
  CASE event_type WHEN 'click' THEN 'baseline' WHEN 'view' THEN 'hybrid' END AS method FROM events WHERE event_type IN ('click', 'view'))"""
_P = f"""{_U}, b AS (SELECT {_N} AS n, {_N} // 4 AS r),
p AS (SELECT least("row" // r, 3) AS part, "row", col, val, "row" - least("row" // r, 3) * r AS lr FROM u, b),
l AS (SELECT part, lr // 16 AS block, col - "row" AS off, count(*) AS n, count(*) >= 2 AS kept FROM p GROUP BY 1, 2, 3)"""
_R = f"""{_P}, need AS (
  SELECT DISTINCT part, col FROM p UNION
  SELECT DISTINCT part, c AS col FROM (SELECT part, unnest(generate_series(part * r + block * 16 + off, least(part * r + block * 16 + 16, CASE WHEN part = 3 THEN b.n ELSE (part + 1) * r END) + off - 1)) AS c, b.n AS nn
    FROM l, b WHERE kept) WHERE c >= 0 AND c < nn),
isl AS (SELECT part, col, col - row_number() OVER (PARTITION BY part ORDER BY col) AS i FROM need),
rg AS (SELECT part, min(col) AS range_start, max(col) + 1 AS range_end FROM isl GROUP BY part, i),
ow AS (SELECT part, o AS owner, greatest(range_start, o * r) AS range_start, CASE WHEN o = 3 THEN range_end ELSE least(range_end, (o + 1) * r) END AS range_end
  FROM (SELECT rg.*, r, unnest(generate_series(least(range_start // r, 3), least((range_end - 1) // r, 3))) AS o FROM rg, b)),
hs AS (SELECT q.part, coalesce(sum(CASE WHEN owner < q.part THEN range_end - range_start END), 0)::BIGINT AS left_size,
  coalesce(sum(CASE WHEN owner > q.part THEN range_end - range_start END), 0)::BIGINT AS right_size, coalesce(sum(range_end - range_start), 0)::BIGINT AS total_buffer_size
  FROM (SELECT unnest(generate_series(0, 3)) AS part) q LEFT JOIN ow ON ow.part = q.part GROUP BY q.part)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {_U} SELECT i.i AS idx, coalesce(sum(e.val * p.p_size), 0)::DOUBLE AS y
FROM (SELECT unnest(generate_series(0, {_N} - 1)) AS i) i LEFT JOIN e ON e."row" = i.i LEFT JOIN part p ON p.p_partkey = e.col GROUP BY 1""")
def spmv_coo(spark, d):
    m = square(spark, d)
    return mv.spmv_coo(m.coo, sizes_vector(spark, d), m.num_rows, size=m.num_cols)


@query("SELECT max(l_suppkey) + 1 AS num_rows, max(l_partkey) + 1 AS num_cols, count(*) AS nnz FROM lineitem")
def coo_dims_inferred(spark, d):
    coo = wide(spark, d).coo
    return coo.agg((F.max("row") + 1).alias("num_rows"), (F.max("col") + 1).alias("num_cols"), F.count("*").alias("nnz"))


def part_grid(spark: SparkSession, d: str, noise: float = 0.0) -> Matrix:
    """The stencil of the least cube that holds all parts, part k at point k: rows and columns are part keys."""
    n = _load(spark, d, "part").count()
    edge = next(k for k in range(1, n + 2) if k**3 >= n)
    grid = src.stencil27(spark, edge, edge, edge, noise=noise, scale=1)
    return Matrix(n, n, grid.coo.where((F.col("row") < n) & (F.col("col") < n)), bound=grid.bound)


#: CTEs b, g, o, s, i: the least cube over the parts, its stencil, and the entries between parts.
_STENCIL = f"""b AS (SELECT min(k) AS n, min(k) ** 3 AS cells, {_N} AS parts FROM (SELECT unnest(range(1, {_N} + 2)) AS k) WHERE k * k * k >= {_N}),
g AS (SELECT unnest(generate_series(0, n * n * n - 1)) AS id, n FROM b), o AS (SELECT unnest(generate_series(-1, 1)) AS d),
s AS (SELECT id AS "row", id + x.d + y.d * n + z.d * n * n AS col, (CASE abs(x.d) + abs(y.d) + abs(z.d) WHEN 0 THEN 2610 WHEN 1 THEN -110 WHEN 2 THEN -10 ELSE -1 END)::DOUBLE AS val
  FROM g, o x, o y, o z WHERE id % n + x.d BETWEEN 0 AND n - 1 AND id // n % n + y.d BETWEEN 0 AND n - 1 AND id // (n * n) + z.d BETWEEN 0 AND n - 1),
i AS (SELECT s.* FROM s, b WHERE "row" < parts AND col < parts)"""
_NOISE = """h AS (SELECT k, n * n * n AS m, parts, md5('42-' || k) AS h FROM (SELECT unnest(range(0, floor(27 * n * n * n * 0.1::DOUBLE)::BIGINT)) AS k, n, parts FROM b)),
w AS (SELECT k, parts, ('0x' || substr(h, 1, 10))::BIGINT % m AS "row", ('0x' || substr(h, 11, 10))::BIGINT % m AS col, (('0x' || substr(h, 21, 12))::BIGINT + 0.5::DOUBLE) / 140737488355328 - 1 AS val FROM h),
z AS (SELECT "row", col, min_by(val, k) AS val FROM w WHERE "row" < parts AND col < parts AND NOT EXISTS (SELECT 1 FROM s WHERE s."row" = w."row" AND s.col = w.col) GROUP BY 1, 2)"""


@query(f"WITH {_STENCIL} SELECT * FROM i")
def stencil27(spark, d):
    return part_grid(spark, d).coo


@query(f"WITH {_STENCIL}, {_NOISE} SELECT * FROM i UNION ALL SELECT * FROM z")
def stencil27_noise(spark, d):
    return part_grid(spark, d, noise=0.1).coo


@query(f'WITH {_STENCIL} SELECT i."row" AS idx, sum(val * p_size)::DOUBLE AS y FROM i JOIN part ON p_partkey = col GROUP BY 1')
def spmv_stencil_blocks(spark, d):
    """The stencil over the parts times their sizes, lane by lane."""
    m = cv.to_hybrid(part_grid(spark, d), threshold=8, assume_unique=True)
    return mv.spmv_hybrid(m.hybrid, sizes_vector(spark, d), strategy="block")


@query(f'WITH {_U} SELECT "row", count(*) AS nnz FROM e GROUP BY 1')
def nnz_per_row(spark, d):
    return cv.nnz_per_row(square(spark, d).coo)


@query('SELECT l_suppkey AS "row", l_partkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2')
def coo_dedup_sum(spark, d):
    return cv.dedup(wide(spark, d).coo)


@query("""SELECT "row", col, val FROM (SELECT l_suppkey AS "row", l_partkey AS col, l_quantity AS val,
  row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC, l_quantity DESC) AS k FROM lineitem) WHERE k = 1""")
def coo_dedup_last(spark, d):
    li = _load(spark, d, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return cv.dedup(li, "last")


@query(f'WITH {_U} SELECT col - "row" AS "offset", count(*) AS n FROM e GROUP BY 1')
def diag_offsets(spark, d):
    return cv.diagonals(square(spark, d).coo)


@query('WITH u AS (SELECT l_suppkey AS "row", l_partkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2) SELECT col - "row" AS "offset", "row" AS pos, val FROM u WHERE "row" < (SELECT count(*) FROM supplier)')
def dia_long(spark, d):
    return cv.dia_long(wide(spark, d))


@query('SELECT user_id AS "row", hour(ts)::BIGINT AS col, count(*)::DOUBLE AS val FROM events GROUP BY 1, 2')
def dia_round_trip(spark, d):
    return cv.dia_to_coo(cv.to_dia(tall_squared(spark, d)).dia)


@query("WITH u AS (SELECT user_id AS r, hour(ts)::BIGINT AS c FROM events GROUP BY 1, 2) SELECT r // 8 AS block, c - r AS \"offset\", count(*) AS n FROM u GROUP BY 1, 2")
def block_offset_counts(spark, d):
    m = tall_squared(spark, d)
    return cv.block_offset_counts(cv.dedup(m.coo), m.num_rows, m.num_cols, 8)


@query(f'WITH {_K} SELECT block, off AS "offset", n FROM g WHERE n >= 2')
def hybrid_kept_offsets(spark, d):
    return laid_out(spark, d, None).hybrid.kept


@query(f'WITH {_K} SELECT block, off AS "offset", n FROM k WHERE kept')
def hybrid_cap(spark, d):
    return laid_out(spark, d).hybrid.kept


@query(f'WITH {_K} SELECT c.block, c.off AS "offset", c.lane, c."row", c.col, c.val FROM c JOIN k USING (block, off) WHERE kept')
def hybrid_block_cells(spark, d):
    return laid_out(spark, d).hybrid.cells


@query(f'WITH {_K} SELECT c."row", c.col, c.val FROM c JOIN k USING (block, off) WHERE NOT kept')
def hybrid_coo_fallback(spark, d):
    return laid_out(spark, d).hybrid.fallback


@query(f'WITH {_U} SELECT * FROM u')
def hybrid_round_trip(spark, d):
    return cv.hybrid_to_coo(laid_out(spark, d).hybrid)


@query(f"""WITH {_K}, f AS (SELECT c."row", count(*) AS n FROM c JOIN k USING (block, off) WHERE NOT kept GROUP BY 1), s AS (SELECT unnest(generate_series(0, {_N})) AS r)
SELECT r AS "row", coalesce(sum(n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ptr FROM s LEFT JOIN f ON f."row" = r""")
def fallback_row_ptr(spark, d):
    m = laid_out(spark, d)
    return cv.fallback_row_ptr(m.hybrid.fallback, m.num_rows)


_SIZES = f"""s AS (SELECT b, count(k.block) AS size, coalesce(sum(k.n), 0) AS nnz FROM (SELECT unnest(generate_series(0, ({_N} + 31) // 32 - 1)) AS b) LEFT JOIN (SELECT * FROM k WHERE kept) k ON k.block = b GROUP BY b)"""


@query(f"WITH {_K}, {_SIZES} SELECT size AS diagonal_count, count(*) AS blocks_with_diagonals, sum(nnz)::BIGINT AS nnz_in_blocks FROM s GROUP BY 1")
def block_histogram(spark, d):
    return cv.block_histogram(laid_out(spark, d).hybrid)


@query(f"WITH {_K} SELECT count(DISTINCT off) AS num_diagonals FROM g")
def num_diagonals(spark, d):
    return cv.num_diagonals(laid_out(spark, d).hybrid.counts)


@query(f"""WITH {_K}, {_SIZES}, t AS (SELECT b, size FROM s UNION ALL SELECT ({_N} + 31) // 32, 0)
SELECT b AS block, coalesce(sum(size) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_start, size AS block_size FROM t""")
def block_directory(spark, d):
    m = laid_out(spark, d)
    return cv.block_directory(m.hybrid.kept, m.hybrid.num_blocks)


@query(f'WITH {_K} SELECT row_number() OVER (ORDER BY block, off) - 1 AS pos, block, off AS "offset" FROM k WHERE kept')
def flattened_offsets(spark, d):
    return cv.flattened_offsets(laid_out(spark, d).hybrid.kept)


_Y = f'FROM (SELECT unnest(generate_series(0, {_N} - 1)) AS i) i LEFT JOIN {{}} ON t."row" = i.i LEFT JOIN part p ON p.p_partkey = t.col GROUP BY 1'


@query(f"WITH {_U} SELECT i.i AS idx, coalesce(sum(t.val * p.p_size), 0)::DOUBLE AS y " + _Y.format("u t"))
def spmv_hybrid(spark, d):
    m = laid_out(spark, d)
    return mv.spmv_hybrid(m.hybrid, sizes_vector(spark, d), size=m.num_cols)


@query(f"WITH {_U} SELECT i.i AS idx, coalesce(sum(t.val * p.p_size), 0)::DOUBLE AS y " + _Y.format("u t"))
def spmv_hybrid_block_form(spark, d):
    m = laid_out(spark, d)
    return mv.spmv_hybrid(m.hybrid, sizes_vector(spark, d), strategy="block", size=m.num_cols)


@query(f"WITH {_K} SELECT i.i AS idx, coalesce(sum(t.val * p.p_size), 0)::DOUBLE AS y " + _Y.format("(SELECT c.* FROM c JOIN k USING (block, off) WHERE kept) t"))
def spmv_blocks_only(spark, d):
    m = laid_out(spark, d)
    return mv.total(mv.block_products(m.hybrid, sizes_vector(spark, d), size=m.num_cols), m.num_rows)


@query(f"WITH {_K} SELECT i.i AS idx, coalesce(sum(t.val * p.p_size), 0)::DOUBLE AS y " + _Y.format("(SELECT c.* FROM c JOIN k USING (block, off) WHERE NOT kept) t"))
def spmv_coo_fallback(spark, d):
    m = laid_out(spark, d)
    return mv.spmv_coo(m.hybrid.fallback, sizes_vector(spark, d), m.num_rows, size=m.num_cols)


@query(f"""SELECT i.i AS idx, coalesce(sum(l_quantity * p_size), 0)::DOUBLE AS y FROM (SELECT unnest(generate_series(0, {_N} - 1)) AS i) i
LEFT JOIN (SELECT l_orderkey % {_N} AS "row", CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE l_partkey END AS col, l_quantity FROM lineitem) e ON e."row" = i.i LEFT JOIN part p ON p.p_partkey = e.col GROUP BY 1""")
def spmv_heavy_column(spark, d):
    """Half of all entries lie in one column, and the vector is taken to be too large to broadcast."""
    n = _load(spark, d, "part").count()
    coo = _load(spark, d, "lineitem").select((F.col("l_orderkey") % n).alias("row"), F.when(F.col("l_linenumber") % 2 == 1, 0).otherwise(F.col("l_partkey")).alias("col"), F.col("l_quantity").alias("val"))
    return mv.spmv_coo(coo, sizes_vector(spark, d), n)


@query(f"""SELECT i.i AS idx, round(coalesce(fsum(l_extendedprice * (1 - l_discount) * p_retailprice), 0), 1) AS y FROM (SELECT unnest(generate_series(0, {_N} - 1)) AS i) i
LEFT JOIN lineitem ON l_orderkey % {_N} = i.i LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def spmv_repeatable(spark, d):
    """Discounted prices times retail prices, summed to the same bits in any order."""
    n = _load(spark, d, "part").count()
    coo = _load(spark, d, "lineitem").select((F.col("l_orderkey") % n).alias("row"), F.col("l_partkey").alias("col"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("val"))
    x = _load(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").cast("double").alias("x"))
    return mv.spmv_coo(coo, x, n, size=n, repeatable=True).withColumn("y", F.round("y", 1))


@query(f"""WITH {_U} SELECT i.i AS idx, coalesce(sum(e.val * p.p_size), 0)::DOUBLE AS y
FROM (SELECT unnest(generate_series(0, {_N} - 1)) AS i) i LEFT JOIN e ON e."row" = i.i LEFT JOIN part p ON p.p_partkey = e.col GROUP BY 1""")
def spmv_stored(spark, d):
    """The product of a matrix that lies in buckets on disk."""
    m = square(spark, d)
    return mv.total(stored.store(m).products(sizes_vector(spark, d)), m.num_rows)


@query("""WITH u AS (SELECT user_id AS r, hour(ts)::BIGINT AS c FROM events), n AS (SELECT greatest(max(r) + 1, 24) AS n FROM u)
SELECT i AS idx, coalesce(sum(c + 1), 0)::DOUBLE AS y FROM (SELECT unnest(generate_series(0, n - 1)) AS i FROM n) LEFT JOIN u ON r = i GROUP BY 1""")
def spmv_dia(spark, d):
    """Diagonals in segments of 16 rows, so that there are many of each."""
    m = cv.to_dia(tall_squared(spark, d), segment=16)
    return mv.spmv_dia(m, src.ramp(spark, m.num_cols, 1).df)


@query("SELECT coalesce(a.i, b.i) AS idx, coalesce(a.x, 0) + coalesce(b.x, 0) AS x FROM (SELECT p_partkey AS i, p_size::DOUBLE AS x FROM part) a FULL JOIN (SELECT l_partkey AS i, sum(l_quantity) AS x FROM lineitem GROUP BY 1) b ON a.i = b.i")
def vector_add(spark, d):
    sums = _load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("idx")).agg(F.sum("l_quantity").alias("x"))
    return mv.vector_add(sizes_vector(spark, d), sums)


@query("""WITH b AS (SELECT p_size::DOUBLE AS x, CASE WHEN p_partkey % 10 = 0 THEN p_size + 1.0::DOUBLE ELSE p_size END AS y FROM part)
SELECT count(*) AS n, max(abs(x - y)) AS max_abs_error, sum(x) AS sum_abs_a, sum(y) AS sum_abs_b, sum(CASE WHEN x <> y THEN 1 ELSE 0 END)::BIGINT AS mismatches, round(abs(sum(x) - sum(y)) / sum(x), 9) AS relative_error FROM b""")
def compare_vectors(spark, d):
    x = sizes_vector(spark, d)
    out = mv.compare_vectors(x, x.select("idx", F.when(F.col("idx") % 10 == 0, F.col("x") + 1).otherwise(F.col("x")).alias("x")))
    return out.withColumn("relative_error", F.round("relative_error", 9))


@query(f"""WITH {_P}, w AS (SELECT q.part, count(p.part) AS local_nnz FROM (SELECT unnest(generate_series(0, 3)) AS part) q LEFT JOIN (SELECT least("row" // r, 3) AS part FROM e, b) p ON p.part = q.part GROUP BY 1)
SELECT part, n AS global_rows, n AS global_cols, (SELECT count(*) FROM e) AS global_nnz, CASE WHEN part = 3 THEN n - 3 * r ELSE r END AS local_rows, n AS local_cols, local_nnz FROM w, b""")
def row_partition_stats(spark, d):
    m = square(spark, d)
    return pt.row_partition_stats(m.coo, m.num_rows, m.num_cols, PARTS)


@query(f"WITH b AS (SELECT {_N} // 7 AS r) SELECT least(p_partkey // r, 6) AS part, p_partkey - least(p_partkey // r, 6) * r AS pos, p_partkey AS idx, p_size::DOUBLE AS x FROM part, b")
def vector_partition(spark, d):
    x = sizes_vector(spark, d)
    return pt.partition_vector(x, x.count(), 7)


@query('SELECT p_partkey AS idx, p_size::DOUBLE AS x FROM part')
def gather_vector(spark, d):
    x = sizes_vector(spark, d)
    return pt.gather(pt.partition_vector(x, x.count(), 7))


@query(f'WITH {_P} SELECT part, block, off AS "offset", n, kept FROM l')
def distributed_layout(spark, d):
    return _parts(spark, d)[2]


@query(f"WITH {_R} SELECT * FROM rg")
def data_ranges(spark, d):
    return _shards(spark, d)[2]


@query(f"WITH {_R} SELECT * FROM ow")
def owner_ranges(spark, d):
    return _shards(spark, d)[3]


@query(f"WITH {_R} SELECT * FROM hs")
def halo_sizes(spark, d):
    return pt.halo_sizes(_shards(spark, d)[3], spark, PARTS)


@query(f"""WITH {_R}, f AS (SELECT ow.*, coalesce(sum(range_end - range_start) OVER (PARTITION BY part, owner > part ORDER BY owner, range_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM ow WHERE owner <> part),
q AS (SELECT l.part, block, off, part * r + block * 16 + off AS i, part * r AS s, CASE WHEN part = 3 THEN b.n ELSE (part + 1) * r END AS t, left_size FROM l JOIN hs USING (part), b WHERE kept)
SELECT q.part, block, off AS "offset", (CASE WHEN i >= s AND i < t THEN left_size + i - s WHEN i < 0 THEN i
  ELSE coalesce(bef + (CASE WHEN owner > q.part THEN left_size + t - s ELSE 0 END) + i - range_start, -2147483648) END)::BIGINT AS position
FROM q LEFT JOIN f ON f.part = q.part AND i >= range_start AND i < range_end""")
def vector_offsets(spark, d):
    m, layout, _, owned = _shards(spark, d)
    return pt.vector_offsets(layout, owned, m.num_rows, PARTS, SHARD_WIDTH)


@query(f"WITH {_P} SELECT DISTINCT p.part, least(col // r, 3) AS owner, col AS idx, p_size::DOUBLE AS x FROM p, b, part WHERE p_partkey = col AND least(col // r, 3) <> p.part")
def halo_exchange(spark, d):
    m = square(spark, d)
    return pt.halo(sizes_vector(spark, d), pt.partition_rows(m.coo, m.num_rows, PARTS), m.num_cols, PARTS)


@query(f"WITH {_P} SELECT part, count(DISTINCT col) AS elements, 0::BIGINT AS wrong FROM p, b WHERE least(col // r, 3) <> part GROUP BY 1")
def verify_halo(spark, d):
    m = square(spark, d)
    return pt.verify_halo(pt.halo(src.ramp(spark, m.num_cols).df, pt.partition_rows(m.coo, m.num_rows, PARTS), m.num_cols, PARTS))


@query(f"WITH {_U} SELECT i.i AS idx, coalesce(sum(t.val * p.p_size), 0)::DOUBLE AS y " + _Y.format("u t"))
def distributed_spmv(spark, d):
    from sparsemill.schema import Vector

    m = square(spark, d)
    return pt.distributed_spmv(m, Vector(sizes_vector(spark, d), m.num_cols), PARTS)


_COSTS = f"""{_K}, t AS (SELECT (SELECT count(*) FROM u) AS nnz, (SELECT count(DISTINCT off) FROM g) AS dg, ({_N} + 31) // 32 AS nb, (SELECT count(*) FROM k WHERE kept) AS kk,
  (SELECT coalesce(sum(n), 0)::BIGINT FROM k WHERE NOT kept) AS q, {_N} AS n, (SELECT sum(m)::BIGINT FROM (SELECT max(c) AS m FROM (SELECT "row", count(*) AS c FROM u GROUP BY 1) GROUP BY "row" // 32)) AS sl),
c2 AS (SELECT nnz, dg AS num_diagonals, nb AS num_blocks, kk * 32 AS stored_cells, q AS fallback_entries, kk * 256 + 4 * (nb + 1) + 4 * kk + 16 * q AS hybrid_cost_bytes, 16 * nnz AS coo_cost_bytes,
  dg * (8 * n + 4) AS dia_cost_bytes, sl * 384 + 4 * ((n + 31) // 32) AS sell_cost_bytes, 12 * nnz + 4 * (n + 1) AS csr_cost_bytes FROM t),
c3 AS (SELECT *, hybrid_cost_bytes / coo_cost_bytes AS hybrid_vs_coo, dia_cost_bytes / coo_cost_bytes AS dia_vs_coo, csr_cost_bytes / coo_cost_bytes AS csr_vs_coo, sell_cost_bytes / coo_cost_bytes AS sell_vs_coo FROM c2)"""


@query(f"WITH {_COSTS} SELECT * FROM c3")
def storage_costs(spark, d):
    return storage_cost(laid_out(spark, d))


@query(f"""WITH {_COSTS} SELECT 'square' AS name, 0 AS nx, 0 AS ny, 0 AS nz, 0.0::DOUBLE AS noise, {_N} AS "rows", {_N} AS cols, c3.* EXCLUDE (stored_cells, fallback_entries), 32 AS block_width, 2 AS threshold,
  20000::BIGINT AS max_coo_entries, fallback_entries AS coo_fallback_entries, stored_cells AS hybrid_data_size, {", ".join(f'{int(f == "execCOOGPU")} AS "{f}"' for f in sinks.FLAGS)} FROM c3""")
def run_report(spark, d):
    m = laid_out(spark, d)
    return matrix_info(m, "square", flags={"execCOOGPU": True})


@query(f"""WITH {_K}, s AS (SELECT b, count(k.block) AS size, coalesce(sum(k.n), 0) AS nnz FROM (SELECT unnest(generate_series(0, ({_N} + 31) // 32 - 1)) AS b) LEFT JOIN (SELECT * FROM k WHERE kept) k ON k.block = b GROUP BY b)
SELECT size AS diagonal_count, count(*) AS blocks_with_diagonals, sum(nnz)::BIGINT AS nnz_in_blocks FROM s GROUP BY 1""")
def histogram_file(spark, d):
    path = _scratch(spark, "histogram")
    sinks.save_csv(sinks.histogram_rows(cv.block_histogram(laid_out(spark, d).hybrid)), path)
    return spark.read.csv(path, header=True, schema="diagonal_count long, blocks_with_diagonals long, nnz_in_blocks long")


_SWEPT = (2, 8)


@query(f"""WITH {_U}, c AS (SELECT "row" // 32 AS block, col - "row" AS off, count(*) AS n FROM u GROUP BY 1, 2), t AS (SELECT unnest({list(_SWEPT)}) AS threshold)
SELECT threshold, sum(n)::BIGINT AS nnz, (count(*) FILTER (n >= threshold) * 32)::BIGINT AS stored_cells, coalesce(sum(n) FILTER (n < threshold), 0)::BIGINT AS fallback_entries, true AS passed FROM c, t GROUP BY 1""")
def run_sweep(spark, d):
    """Benchmark runs over a MatrixMarket file of the square matrix, at several thresholds."""
    m, path, out = square(spark, d), _scratch(spark, "square.mtx"), _scratch(spark, "runs")
    sinks.save_mtx(m, path, "sum")
    done = run.sweep(spark, run.Config(filename=path, iterations=2), out, (0.0,), _SWEPT)
    passed = spark.createDataFrame([(r["threshold"], bool(r["passed"])) for r in done], "threshold int, passed boolean")
    info = run.read_info(spark, out).select("threshold", F.col("nnz").cast("long").alias("nnz"), F.col("hybrid_data_size").cast("long").alias("stored_cells"), F.col("coo_fallback_entries").cast("long").alias("fallback_entries"))
    return info.join(passed, "threshold")


@query(f'WITH {_U} SELECT "row", col, val FROM u ORDER BY 1, 2 LIMIT 10')
def coo_head(spark, d):
    return report.coo_head(cv.dedup(square(spark, d).coo))


@query(f"WITH {_U} SELECT {_N} * {_N} AS cells, count(*) AS nnz, round(count(*) * 100.0::DOUBLE / ({_N} * {_N}), 9) AS density_percent FROM u WHERE val <> 0")
def density(spark, d):
    out = report.density(square(spark, d))
    return out.withColumn("density_percent", F.round("density_percent", 9))


@query('SELECT user_id AS "row", hour(ts)::BIGINT AS col, count(*)::DOUBLE AS val FROM events GROUP BY 1, 2')
def mtx_round_trip(spark, d):
    m, path = tall(spark, d), _scratch(spark, "mtx")
    sinks.save_mtx(Matrix(m.num_rows, m.num_cols, cv.dedup(m.coo)), path)
    return src.read_mtx(spark, path).coo


@query("""WITH u AS (SELECT user_id AS r, hour(ts)::BIGINT AS c, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2)
SELECT (SELECT max(user_id) + 8 FROM events) AS num_rows, 30::BIGINT AS num_cols, count(*) AS nnz, max(r) AS last_row, max(c) AS last_col, sum(v) AS total FROM u""")
def mtx_given_dims(spark, d):
    m, path = tall(spark, d), _scratch(spark, "mtx")
    sinks.save_mtx(Matrix(m.num_rows, m.num_cols, cv.dedup(m.coo)), path)
    back = src.read_mtx(spark, path, num_rows=m.num_rows + 7, num_cols=30)
    size = [F.lit(n).cast("long").alias(k) for k, n in (("num_rows", back.num_rows), ("num_cols", back.num_cols))]
    return back.coo.agg(F.count("*").alias("nnz"), F.max("row").alias("last_row"), F.max("col").alias("last_col"), F.sum("val").alias("total")).select(*size, "*")


@query('SELECT vec_id AS "row", count(*) AS nnz FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) WHERE v <> 0 GROUP BY 1')
def dense_to_triples(spark, d):
    return cv.nnz_per_row(src.from_dense(_load(spark, d, "embeddings"), "vec_id", "embedding").coo)


# -- measurements


@query("SELECT event_id, (user_id % 5 / 10.0)::DOUBLE AS noise_level FROM events")
def regex_extract(spark, d):
    e = _load(spark, d, "events")
    folder = F.format_string("grid_8_8_8_%.6f_%s", (F.col("user_id") % 5) / 10.0, sinks.stamp(F.col("ts")))
    return e.select("event_id", src.folder_noise(folder).alias("noise_level"))


@query(f"WITH {_M} SELECT noise_level, iteration, time_ms, method, event_id FROM m")
def measurements_union(spark, d):
    m = measurements(spark, d)
    return an.measurements_union([m.where("method = 'baseline'"), m.where("method = 'hybrid'")])


@query(f"WITH {_M} SELECT noise_level, iteration, time_ms, 1 AS \"execCOOGPU\" FROM m WHERE method = 'hybrid'")
def measurement_files(spark, d):
    """Written in a folder for each noise level, and read again from all of them."""
    m, path = measurements(spark, d).where("method = 'hybrid'"), _scratch(spark, "measured")
    for k in range(5):
        folder = sinks.run_folder("grid", 8, 8, 8, k / 10, dt.datetime(2025, 1, 1))
        sinks.save_csv(sinks.hybrid_measurements(m.where(F.col("noise_level") == k / 10.0), {"execCOOGPU": True}), f"{path}/{folder}")
    return src.read_measurements(spark, f"{path}/*", "iteration long, time_ms double, " + ", ".join(f"{f} int" for f in sinks.FLAGS)).select("noise_level", "iteration", "time_ms", "execCOOGPU")


@query(f"WITH {_M} SELECT event_id FROM m WHERE iteration > 0 AND method = 'hybrid' AND noise_level = 0.2")
def warmup_filter(spark, d):
    return an.without_warmup(measurements(spark, d)).where("method = 'hybrid' and noise_level = 0.2D").select("event_id")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {_M} SELECT noise_level, method, count(*) AS count, round(avg(time_ms), 6) AS mean, round(stddev_samp(time_ms), 6) AS std, min(time_ms) AS min, max(time_ms) AS max FROM m GROUP BY 1, 2")
def runtime_summary(spark, d):
    return _rounded(an.runtime_summary(measurements(spark, d), "noise_level", "method"), "mean", "std")


@query(f"WITH {_M} SELECT method, round(avg(time_ms), 6) AS mean, round(stddev_pop(time_ms), 6) AS std, min(time_ms) AS min, max(time_ms) AS max FROM m GROUP BY 1")
def print_stats(spark, d):
    return _rounded(an.print_stats(measurements(spark, d), "method"), "mean", "std")


_CMP = f"""{_M}, b AS (SELECT noise_level, avg(time_ms) AS x FROM m WHERE method = 'baseline' GROUP BY 1), h AS (SELECT noise_level, avg(time_ms) AS y FROM m WHERE method = 'hybrid' GROUP BY 1),
j AS (SELECT coalesce(b.noise_level, h.noise_level) AS noise_level, x, y FROM b FULL JOIN h ON b.noise_level = h.noise_level)"""


def _comparison(spark, d):
    m = measurements(spark, d)
    return an.runtime_comparison(m.where("method = 'baseline'"), m.where("method = 'hybrid'"))


@query(f"WITH {_CMP} SELECT noise_level, round(x, 6) AS baseline_mean_ms, round(y, 6) AS hybrid_mean_ms, round(x / y, 6) AS speedup, round((x - y) / x * 100, 6) AS hybrid_faster_by_percent FROM j")
def runtime_comparison(spark, d):
    return _rounded(_comparison(spark, d), "baseline_mean_ms", "hybrid_mean_ms", "speedup", "hybrid_faster_by_percent")


@query(f"WITH {_CMP} SELECT round(avg(x / y), 6) AS avg_speedup, round(max(x / y), 6) AS max_speedup, round(min(x / y), 6) AS min_speedup FROM j")
def speedup_extremes(spark, d):
    return _rounded(an.speedup_extremes(_comparison(spark, d)), "avg_speedup", "max_speedup", "min_speedup")


@query(f"WITH {_M} SELECT noise_level, count(*) AS n, round(avg(time_ms), 6) AS mean, round(quantile_cont(time_ms, 0.25), 6) AS p25, round(quantile_cont(time_ms, 0.5), 6) AS median, round(quantile_cont(time_ms, 0.75), 6) AS p75 FROM m GROUP BY 1")
def storage_quartiles(spark, d):
    return _rounded(an.quartiles(measurements(spark, d), "time_ms", "noise_level"), "mean", "p25", "median", "p75")


@query("SELECT l_linenumber AS noise, min_by(t, cost * 1000 + t) AS threshold, min(cost) AS cost FROM (SELECT l_linenumber, round(l_tax * 100)::INTEGER AS t, sum(l_quantity)::BIGINT AS cost FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def best_threshold(spark, d):
    costs = _load(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("noise"), F.round(F.col("l_tax") * 100).cast("int").alias("threshold")).agg(F.sum("l_quantity").cast("long").alias("cost"))
    return an.best_threshold(costs)


@query("SELECT o_orderkey, (o_orderkey * 16) AS coo_cost_bytes, o_orderkey * 16 / 1048576 AS coo_storage_mb FROM orders")
def bytes_to_megabytes(spark, d):
    return an.to_megabytes(_load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 16).alias("coo_cost_bytes")))


@query("SELECT event_id, CASE user_id % 6 WHEN 0 THEN '0%' WHEN 1 THEN '0.01%' WHEN 2 THEN '0.1%' WHEN 3 THEN '1%' WHEN 4 THEN '50%' ELSE '300%' END AS label FROM events")
def percent_labels(spark, d):
    k = F.col("user_id") % 6
    noise = F.when(k == 0, 0.0).when(k == 1, 0.0001).when(k == 2, 0.001).when(k == 3, 0.01).when(k == 4, 0.5).otherwise(3.0)
    return _load(spark, d, "events").select("event_id", an.percent_label(noise).alias("label"))


_SUMS = f"""{_M}, s AS (SELECT noise_level, count(*) FILTER (method = 'baseline') AS n0, avg(time_ms) FILTER (method = 'baseline') AS m0, var_samp(time_ms) FILTER (method = 'baseline') AS v0,
  count(*) FILTER (method = 'hybrid') AS n1, avg(time_ms) FILTER (method = 'hybrid') AS m1, var_samp(time_ms) FILTER (method = 'hybrid') AS v1 FROM m GROUP BY 1)"""


@query(f"""WITH {_SUMS}, c AS (SELECT noise_level, (m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS d FROM s)
SELECT noise_level, round(d, 6) AS cohens_d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect_size FROM c""")
def cohens_d(spark, d):
    return _rounded(an.cohens_d(measurements(spark, d), "baseline", "hybrid", "noise_level"), "cohens_d")


@query(f"""WITH {_SUMS} SELECT noise_level, round(m0 / m1, 6) AS speedup, round(m0 / m1 - 1.959963984540054 * sqrt(v0 / (n0 * m1 ** 2) + m0 ** 2 * v1 / (n1 * m1 ** 4)), 6) AS ci_low,
  round(m0 / m1 + 1.959963984540054 * sqrt(v0 / (n0 * m1 ** 2) + m0 ** 2 * v1 / (n1 * m1 ** 4)), 6) AS ci_high FROM s""")
def speedup_ci(spark, d):
    return _rounded(an.speedup_ci(measurements(spark, d), "baseline", "hybrid", "noise_level"), "speedup", "ci_low", "ci_high")


@query(f"WITH {_M} SELECT round(avg(time_ms) FILTER (method = 'baseline') / avg(time_ms) FILTER (method = 'hybrid'), 6) AS speedup FROM m WHERE iteration > 0")
def mean_speedup(spark, d):
    return _rounded(an.mean_speedup(measurements(spark, d), "baseline", "hybrid"), "speedup")


_T = ", ".join(f"({df + 1}, {st.t_quantile(0.975, df):.12f})" for df in range(1, 29))
_MOMENTS = f"""{_M}, g AS (SELECT noise_level, method, avg(time_ms) AS mu FROM m GROUP BY 1, 2),
q AS (SELECT noise_level, method, count(*)::DOUBLE AS n, avg((time_ms - mu) ** 2) AS m2, avg((time_ms - mu) ** 3) AS m3, avg((time_ms - mu) ** 4) AS m4 FROM m JOIN g USING (noise_level, method) GROUP BY 1, 2),
k AS (SELECT *, m3 / m2 ** 1.5::DOUBLE * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
  (m4 / m2 ** 2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS v,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS r FROM q WHERE n >= 8),
a AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w, 6 + 8 / r * (2 / r + sqrt(1 + 4 / r ** 2)) AS a FROM k),
z AS (SELECT *, asinh(y / sqrt(2 / (w - 1))) / sqrt(0.5::DOUBLE * ln(w)) AS z1, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + v * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM a),
t AS (SELECT noise_level, method, n::BIGINT AS n, exp(-(z1 ** 2 + z2 ** 2) / 2) AS p FROM z)"""


@query(f"""WITH {_M}, t(n, q) AS (VALUES {_T}), s AS (SELECT noise_level, method, count(*) AS n, avg(time_ms) AS mean, stddev_samp(time_ms) AS s FROM m GROUP BY 1, 2)
SELECT noise_level, method, s.n, round(mean, 6) AS mean, round(mean - coalesce(q, 1.959963984540054) * s / sqrt(s.n), 6) AS ci_low, round(mean + coalesce(q, 1.959963984540054) * s / sqrt(s.n), 6) AS ci_high FROM s LEFT JOIN t ON t.n = s.n""")
def parametric_ci(spark, d):
    return _rounded(an.parametric_ci(measurements(spark, d), "noise_level", "method", normal_from=30), "mean", "ci_low", "ci_high")


_RANKED = f"{_M}, v AS (SELECT noise_level, method, time_ms AS x, row_number() OVER (PARTITION BY noise_level, method ORDER BY time_ms) - 1 AS k, 0 AS stream FROM m)"


@query(f"""WITH {_RANKED}, {rs.sql_weights("v", "noise_level, method, x")},
d AS (SELECT noise_level, method, b, median(x) AS y FROM (SELECT noise_level, method, b, x, unnest(range(w)) FROM hw WHERE w > 0) GROUP BY 1, 2, 3),
i AS (SELECT noise_level, method, round(quantile_cont(y, 0.025), 6) AS ci_low, round(quantile_cont(y, 0.975), 6) AS ci_high FROM d GROUP BY 1, 2),
s AS (SELECT noise_level, method, count(*) AS n, round(median(x), 6) AS median FROM v GROUP BY 1, 2)
SELECT noise_level, method, n, median, ci_low, ci_high FROM s JOIN i USING (noise_level, method)""")
def bootstrap_ci(spark, d):
    return _rounded(an.bootstrap_ci(measurements(spark, d), "noise_level", "method"), "median", "ci_low", "ci_high")


@query(f"""WITH {_RANKED}, {rs.sql_weights("v", "noise_level, method, x")},
d AS (SELECT noise_level, method, b, sum(w * x) / nullif(sum(w), 0) AS y FROM hw GROUP BY 1, 2, 3),
i AS (SELECT noise_level, method, round(quantile_cont(y, 0.025), 6) AS ci_low, round(quantile_cont(y, 0.975), 6) AS ci_high FROM d GROUP BY 1, 2),
s AS (SELECT noise_level, method, count(*) AS n, round(avg(x), 6) AS mean FROM v GROUP BY 1, 2)
SELECT noise_level, method, n, mean, ci_low, ci_high FROM s JOIN i USING (noise_level, method)""")
def bootstrap_mean_ci(spark, d):
    return _rounded(an.bootstrap_ci(measurements(spark, d), "noise_level", "method", statistic="mean"), "mean", "ci_low", "ci_high")


@query(f"""WITH {_M}, v AS (SELECT noise_level, method, time_ms AS x, row_number() OVER (PARTITION BY noise_level, method ORDER BY time_ms) - 1 AS k, (method <> 'baseline')::INTEGER AS stream FROM m),
{rs.sql_weights("v", "noise_level, method, x")}, e AS (SELECT noise_level, method, b, sum(w * x) / nullif(sum(w), 0) AS y FROM hw GROUP BY 1, 2, 3),
d AS (SELECT noise_level, p.y / q.y AS y FROM e p JOIN e q USING (noise_level, b) WHERE p.method = 'baseline' AND q.method = 'hybrid'),
s AS (SELECT noise_level, round(avg(x) FILTER (stream = 0) / avg(x) FILTER (stream = 1), 6) AS speedup FROM v GROUP BY 1)
SELECT noise_level, speedup, round(quantile_cont(y, 0.025), 6) AS ci_low, round(quantile_cont(y, 0.975), 6) AS ci_high FROM s JOIN d USING (noise_level) GROUP BY 1, 2""")
def bootstrap_speedup_ci(spark, d):
    return _rounded(an.bootstrap_speedup_ci(measurements(spark, d), "baseline", "hybrid", "noise_level"), "speedup", "ci_low", "ci_high")


@query(f"WITH {_MOMENTS} SELECT noise_level, method, n, round(p, 6) AS p_value, p > 0.05 AS is_normal FROM t")
def normality(spark, d):
    return _rounded(an.normality(measurements(spark, d), "noise_level", "method"), "p_value")


def _series(first: str, ratio: str) -> str:
    """1 + r(0) (1 + r(1) (1 + ...)) with r(k) a text of k."""
    return f"list_reduce(list_prepend(1::DOUBLE, list_transform(range(600, -1, -1), lambda k: k::DOUBLE)), lambda acc, k: 1 + {ratio} * acc) * {first}"


def _normal_upper(z: str) -> str:
    """The normal distribution's upper tail, from the series of its density."""
    return f"(0.5::DOUBLE - {_series(f'({z}) * exp(-0.5::DOUBLE * ({z}) ** 2) / sqrt(2 * pi())', f'({z}) ** 2 / (2 * k + 3)')})"


def _t_two_sided(t2: str, df: str) -> str:
    """Student's two-sided probability from the square of t, by the series of the incomplete beta function."""
    y = f"(({t2}) / (({df}) + ({t2})))"
    front = f"2 * exp(0.5::DOUBLE * ln(greatest({y}, 1e-300)) + ({df}) / 2.0::DOUBLE * ln(1 - {y}) + lgamma((({df}) + 1) / 2.0::DOUBLE) - lgamma(0.5::DOUBLE) - lgamma(({df}) / 2.0::DOUBLE))"
    return f"(1 - {_series(front, f'((({df}) + 1) / 2.0::DOUBLE + k) / (1.5::DOUBLE + k) * {y}')})"


def _normal_score(p: str) -> str:
    poly = lambda c, r: reduce(lambda acc, k: f"({acc} * {r} + {k!r}::DOUBLE)", c[1:], f"{c[0]!r}::DOUBLE")
    ratio = lambda c, r: f"{poly(c[0], r)} / {poly(c[1], r)}"
    q, tail = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(normal.MIDDLE, f'(0.180625::DOUBLE - {q} ** 2)')} WHEN {tail} <= 5 THEN sign({q}) * {ratio(normal.TAIL, f'({tail} - 1.6::DOUBLE)')} ELSE sign({q}) * {ratio(normal.FAR, f'({tail} - 5)')} END"


@query(f"""WITH {_M}, v AS (SELECT noise_level, method, time_ms AS x, row_number() OVER (PARTITION BY noise_level, method ORDER BY time_ms) AS i, count(*) OVER (PARTITION BY noise_level, method) AS n FROM m),
p AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM v), z AS (SELECT *, {_normal_score("p")} AS s FROM p),
g AS (SELECT noise_level, method, n, sum(s * s) AS square, sum(s * x) AS dot, var_pop(x) * n AS dev, max(x) - min(x) AS d1, max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS d2, max(s) AS s1, max(s) FILTER (i = n - 1) AS s2, 1 / sqrt(n) AS u FROM z GROUP BY 1, 2, 3),
h AS (SELECT *, 0.221157 * u - 0.147981 * u ** 2 - 2.07119 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5 + s1 / sqrt(square) AS w1, 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5 + s2 / sqrt(square) AS w2 FROM g WHERE n > 11),
k AS (SELECT *, ((dot - s1 * d1 - s2 * d2) / sqrt((square - 2 * (s1 ** 2 + s2 ** 2)) / (1 - 2 * (w1 ** 2 + w2 ** 2))) + w1 * d1 + w2 * d2) ** 2 / dev AS w, ln(n) AS l FROM h),
t AS (SELECT *, greatest(-20, least(20, (ln(1 - w) - (-1.5861 - 0.31082 * l - 0.083751 * l ** 2 + 0.0038915 * l ** 3)) / exp(-0.4803 - 0.082676 * l + 0.0030302 * l ** 2))) AS y FROM k),
q AS (SELECT noise_level, method, n, w, {_normal_upper("y")} AS p FROM t) SELECT noise_level, method, n, round(w, 6) AS w, round(greatest(p, 0), 6) AS p_value, p >= 0.05 AS is_normal FROM q""")
def shapiro(spark, d):
    return _rounded(an.shapiro(measurements(spark, d), "noise_level", "method"), "w", "p_value")


@query(f"WITH {_MOMENTS} SELECT CASE WHEN coalesce(bool_and(p > 0.05), false) THEN 'mean' ELSE 'median' END AS measure FROM t")
def location_measure(spark, d):
    return an.location_measure(an.normality(measurements(spark, d), "noise_level", "method"))


_COMPARE = f"""{_MOMENTS}, v AS (SELECT noise_level, method = 'baseline' AS a, method, time_ms AS x, median(time_ms) OVER (PARTITION BY noise_level, method) AS mid,
  rank() OVER (PARTITION BY noise_level ORDER BY time_ms) - 1 AS below, count(*) OVER (PARTITION BY noise_level, time_ms) AS c FROM m),
s AS (SELECT noise_level, count(*) FILTER (a)::DOUBLE AS n0, count(*) FILTER (NOT a)::DOUBLE AS n1, avg(x) FILTER (a) AS m0, avg(x) FILTER (NOT a) AS m1, var_samp(x) FILTER (a) AS v0, var_samp(x) FILTER (NOT a) AS v1,
  avg(abs(x - mid)) AS z, avg(abs(x - mid)) FILTER (a) AS z0, avg(abs(x - mid)) FILTER (NOT a) AS z1, var_samp(abs(x - mid)) FILTER (a) AS y0, var_samp(abs(x - mid)) FILTER (NOT a) AS y1,
  sum(below + (c + 1) / 2) FILTER (a) AS ranks, sum(c::DOUBLE ** 2 - 1) AS ties FROM v GROUP BY 1),
f AS (SELECT s.*, coalesce(p0.p > 0.05, true) AS a_normal, coalesce(p1.p > 0.05, true) AS b_normal, (n0 + n1 - 2) * (n0 * (z0 - z) ** 2 + n1 * (z1 - z) ** 2) / ((n0 - 1) * y0 + (n1 - 1) * y1) AS lev,
  ((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) AS pooled, v0 / n0 + v1 / n1 AS apart, ranks - n0 * (n0 + 1) / 2 AS u, sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))) AS sd
  FROM s LEFT JOIN t p0 ON p0.noise_level = s.noise_level AND p0.method = 'baseline' LEFT JOIN t p1 ON p1.noise_level = s.noise_level AND p1.method = 'hybrid' WHERE n0 > 1 AND n1 > 1),
e AS (SELECT *, {_t_two_sided("lev", "n0 + n1 - 2")} > 0.05 AS equal FROM f),
c2 AS (SELECT *, CASE WHEN NOT (a_normal AND b_normal) THEN 'Mann-Whitney U' WHEN equal THEN 't-test' ELSE 'Welch''s t-test' END AS test_name, (m0 - m1) / sqrt(pooled) AS d,
  CASE WHEN equal THEN (m0 - m1) / sqrt(pooled * (1 / n0 + 1 / n1)) ELSE (m0 - m1) / sqrt(apart) END AS tt, CASE WHEN equal THEN n0 + n1 - 2 ELSE apart ** 2 / ((v0 / n0) ** 2 / (n0 - 1) + (v1 / n1) ** 2 / (n1 - 1)) END AS df, least(20, (abs(u - n0 * n1 / 2) - 0.5) / sd) AS z2 FROM e),
r2 AS (SELECT *, CASE test_name WHEN 'Mann-Whitney U' THEN u ELSE tt END AS stat, CASE test_name WHEN 'Mann-Whitney U' THEN least(1, 2 * {_normal_upper("z2")}) ELSE {_t_two_sided("tt ** 2", "df")} END AS p FROM c2)"""


@query(f"""WITH {_COMPARE} SELECT noise_level, test_name, round(stat, 6) AS test_statistic, round(p, 6) AS p_value, round(d, 6) AS cohens_d,
  CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect_size, p < 0.05 AS significant, a_normal, b_normal FROM r2""")
def compare_methods(spark, d):
    return _rounded(an.compare_methods(measurements(spark, d), "baseline", "hybrid", "noise_level"), "test_statistic", "p_value", "cohens_d")
