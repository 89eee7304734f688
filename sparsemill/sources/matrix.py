"""Sources of matrices and vectors: tables, MatrixMarket text, the 27-point stencil, ramps, CSV measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsemill.schema import Matrix, Vector, reject
from sparsemill.sources.shared import materialise

# fixed values: weights of the 27-point stencil by the number of directions that differ, times 100
STENCIL_WEIGHTS = {0: 2610, 1: -110, 2: -10, 3: -1}
NOISE_SEED = 42


def ramp(spark: SparkSession, n: int, first: int = 0) -> Vector:
    """x_i = i + first."""
    return Vector(spark.range(n).select(F.col("id").alias("idx"), (F.col("id") + first).cast("double").alias("x")), n)


def read_mtx(spark: SparkSession, path: str, *, num_rows: int | None = None, num_cols: int | None = None) -> Matrix:
    """A MatrixMarket coordinate file, or a folder of parts in the order of their names.

    Lines of % are comments; the first other line is the header; lines that do not parse are skipped, and
    so are entries beyond the header's number; a missing value is 1 (pattern). Symmetric files are mirrored,
    skew-symmetric ones with the other sign. With given dimensions, entries outside them raise.
    Raises FileNotFoundError where the path has no file, ValueError for kinds that are not supported.
    """
    blanks = F.when(F.col("value").contains("\t") | F.col("value").contains("\r"), F.translate("value", "\r\t", "  ")).otherwise(F.col("value"))
    # lines are split over tasks; (file, start of the split, number within it) is their order
    try:
        read = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k")).alias("ln"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    lines = read.select("ln", F.trim(blanks).alias("line")).where("line != ''")
    comments = lines.where(F.col("line").startswith("%")).select(F.lower("line").alias("c")).where("c rlike 'symmetric|hermitian|complex| array'")
    kinds = ("symmetric", "skew", "hermitian", "complex", " array")
    said = [k for k, found in zip(kinds, comments.agg(*(F.bool_or(F.col("c").contains(k)) for k in kinds)).first()) if found]
    if any(k in said for k in ("hermitian", "complex", " array")):
        raise ValueError("hermitian, complex and array files are not supported")
    body = lines.where(~F.col("line").startswith("%"))
    first = body.orderBy("ln").limit(1).collect()  # each task's first line alone; no other is split for it
    words = spark.createDataFrame(first, body.schema).select("ln", F.transform(F.split("line", r"\s+"), lambda x: x.try_cast("long")).alias("t"))
    head = words.first() or {"t": None}
    if head["t"] is None or len(head["t"]) < 3 or None in head["t"][:3]:
        raise ValueError("there is no header of rows, columns and entries")
    rows, cols, nnz = head["t"][:3]
    at = lambda t, k: F.get(t, F.lit(k))
    whole = lambda t, k: at(t, k).try_cast("long") - 1
    value = lambda t: F.when(at(t, 2).isNull(), F.lit(1.0)).otherwise(at(t, 2).try_cast("double"))
    entry = lambda t: (whole(t, 0).alias("row"), whole(t, 1).alias("col"), value(t).alias("val"))
    later = body.where(F.col("ln") > F.struct(*(F.lit(head["ln"][c]).alias(c) for c in ("file", "at", "k"))))
    # single blanks part nearly all lines, which takes no pattern; the others are split by one
    quick = later.select("ln", "line", F.split("line", " ").alias("t")).select("ln", "line", *entry(F.col("t")))
    odd = F.expr("row is null or col is null or val is null") | F.col("line").contains("\f") | F.col("line").contains("\v")
    both = quick.select("ln", "row", "col", "val", F.when(odd, F.split("line", r"\s+")).alias("t"))
    parsed = both.select("ln", *(F.when(F.col("t").isNull(), F.col(c)).otherwise(e).alias(c) for c, e in zip(("row", "col", "val"), entry(F.col("t")))))
    parsed = materialise(parsed, "lines").where("row is not null and col is not null and val is not null")  # text is parsed once, unparsed lines go after that
    if parsed.count() > nnz:
        parsed = parsed.orderBy("ln").limit(nnz)
    entries = parsed.select("row", "col", "val")
    rows, cols = num_rows or rows, num_cols or cols
    if rows <= 0 or cols <= 0:
        raise ValueError("both dimensions must be positive")
    outside = F.expr(f"row < 0 or col < 0 or row >= {rows} or col >= {cols}")
    reject(entries, {"an index is outside the matrix": (outside, IndexError)}, ("row", "col", "val"))
    if "symmetric" in said:
        sign = -1.0 if "skew" in said else 1.0
        mirror = entries.where("row != col").select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("val") * sign).alias("val"))
        entries = entries.unionByName(mirror)
    return Matrix(rows, cols, entries, bound=max(0, nnz) * (1 + ("symmetric" in said)))


def stencil27(spark: SparkSession, nx: int, ny: int, nz: int, *, noise: float = 0.0, iteration: int = 0, scale: int = 100) -> Matrix:
    """The 27-point stencil of an nx x ny x nz grid, point (z, y, x) at z nx ny + y nx + x.

    Weights are integers times 100 / scale: with the default 100 they are the real ones, with scale 1
    the integers. noise adds that share of 27 n entries at hashed places outside the stencil.
    """
    if min(nx, ny, nz) <= 0:
        raise ValueError("the grid must have a positive size")
    n = nx * ny * nz
    step = lambda: spark.range(3).select((F.col("id") - 1).alias("d"))
    around = step().withColumnRenamed("d", "dx").crossJoin(step().withColumnRenamed("d", "dy")).crossJoin(step().withColumnRenamed("d", "dz"))  # 27 rows
    point = spark.range(n).select(F.col("id").alias("row"), F.expr(f"id % {nx}").alias("x"), F.expr(f"id div {nx} % {ny}").alias("y"), F.expr(f"id div {nx * ny}").alias("z"))
    both = point.join(F.broadcast(around))
    inside = " and ".join(f"{c} + d{c} between 0 and {m - 1}" for c, m in (("x", nx), ("y", ny), ("z", nz)))
    kind = F.abs("dx") + F.abs("dy") + F.abs("dz")
    weight = F.coalesce(*(F.when(kind == k, F.lit(float(v) / scale)) for k, v in STENCIL_WEIGHTS.items()))
    col = F.col("row") + F.col("dx") + F.col("dy") * nx + F.col("dz") * nx * ny
    entries = both.where(inside).select("row", col.alias("col"), weight.alias("val"))
    draws = int(27 * n * noise)
    if draws:
        entries = entries.unionByName(_noise(spark, entries, n, draws, iteration))
    return Matrix(n, n, entries, bound=27 * n + draws)


def _noise(spark: SparkSession, entries: DataFrame, n: int, draws: int, iteration: int) -> DataFrame:
    """Up to draws entries with row, column and value in (-1, 1) from the MD5 of seed and number, none where an entry is; one a cell.

    An MD5 has 128 bits: 40 for the row, 40 for the column, 48 for the value.
    """
    seed = NOISE_SEED + iteration
    number = lambda at, digits: F.conv(F.substring("h", at, digits), 16, 10).cast("long")
    hashed = spark.range(draws).select("id", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")).alias("h"))
    value = (number(21, 12) + F.lit(0.5)) / F.lit(float(1 << 47)) - 1
    drawn = hashed.select(F.pmod(number(1, 10), F.lit(n)).alias("row"), F.pmod(number(11, 10), F.lit(n)).alias("col"), "id", value.alias("val"))
    once = drawn.groupBy("row", "col").agg(F.min_by("val", "id").alias("val"))
    return once.join(entries, ["row", "col"], "left_anti").select("row", "col", "val")


def from_dense(df: DataFrame, row: str, values: str) -> Matrix:
    """A table with an array a row as a matrix; zeros are left out."""
    every = df.select(F.col(row).alias("row"), F.posexplode(values).alias("col", "val")).where("val != 0")
    return Matrix.from_df(every)


# fixed values: how a run's folder is named
FOLDER = r"_(\d+\.\d+)_\d{8}_\d{6}_\d{3}$"
IN_PATH = r"([^/]+_\d+\.\d+_\d{8}_\d{6}_\d{3})/"


def folder_noise(folder: Column) -> Column:
    """The noise level in the name of a run's folder (..._0.001000_20250821_163209_715); null if there is none."""
    found = F.regexp_extract(folder, FOLDER, 1)
    return F.when(found != "", found).cast("double")


def read_measurements(spark: SparkSession, glob: str, schema: str | None = "iteration int, time_ms double") -> DataFrame:
    """All CSV files of a glob, with the run's folder and noise_level; files outside such folders are left out. Without a schema, types are inferred."""
    read = spark.read.csv(glob, header=True, schema=schema, inferSchema=schema is None).withColumn("folder", F.regexp_extract(F.input_file_name(), IN_PATH, 1))
    return read.withColumn("noise_level", folder_noise(F.col("folder"))).where("noise_level is not null")
