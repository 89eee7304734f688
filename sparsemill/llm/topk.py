"""Exact top-k by inner product: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are turned into integers, floor(scale * x). Scores are exact integer inner products: in doubles while the largest
squared length is under 2^53, so that no sum of products can round, and in Python's integers beyond that.

Method. All vectors are range-sorted by length once and kept as a table. The rotation is the right singular basis of all
vectors, from their second moments (summed per task, then over tasks; d x d numbers). Queries are taken in blocks of bounded
bytes. For each block, the vectors of the largest norms give first k-th best scores. Then the table is read in waves of
descending length, each one with the k-th best scores of those before. A wave reads only lengths that can reach a place at all,
and within a task, where |q||x| of the longest vector of a run lies below a query's k-th best score, that query is done with
the run; if all are, the run is not even rotated. Otherwise the first rotated dimensions are multiplied, and only pairs whose
partial sum plus the product of the residual norms reaches the k-th best are scored exactly. Bounds are widened for rounding, so
nothing that could reach a place is dropped. Each task's best k a query are merged by score, then by smaller id.

Distribution. A block of queries (at most QUERY_BLOCK, and BLOCK_BYTES) is broadcast and freed after its waves; candidates are shuffled once, by
length, for all blocks. Tasks send at most k rows for a query and only such as reach its k-th best so far. A block's k best a
query come to the driver between waves (bounded by the block) and go to a table in the shared folder.

Defined results: rows with null id, null vector, or a null or non-finite component take no part;
shorter vectors count as padded with zeros; an empty vector scores 0; rows of a query's own id are
no candidates; equal (id, score) rows count once; of several query rows with one id, the one with
the least vector asks; an empty table gives an empty result; a score that is no 64-bit integer is an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsemill.llm.common import load, materialise, new_path

SCALE, EVERY, K = 256, 50, 5
QUERY_BLOCK, BLOCK_BYTES, SEEDS, RUN = 16_384, 16 << 20, 1024, 1024
#: Shares of the vectors that are shorter than a wave's.
WAVES = (0.99, 0.9)
#: Share of the summed squares that the first rotated dimensions hold; tasks whose moments are added up together.
HEAD, MOMENT_GROUPS = 0.7, 64
#: Under this squared length, sums of products of integers are exact in doubles.
EXACT = float(1 << 53)
LOWEST = np.iinfo(np.int64).min
_RESULT = "query_id long, vec_id long, score long"


def usable(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(_id, _v, _len): integer vectors as doubles, and their lengths, of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(fine)
    whole = lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c)  # noqa: E731  beyond that all doubles are integers
    rows = rows.select(F.col(id_col).cast("long").alias("_id"), F.transform(x, lambda c: whole(c * F.lit(float(scale)))).alias("_v"))
    return rows.withColumn("_len", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, c: a + c * c)))


def by_length(vectors: DataFrame) -> DataFrame:
    """All vectors as a table of files of descending lengths; vectors of equal length are dealt by id."""
    return materialise(vectors.repartitionByRange(F.col("_len").desc(), "_id").sortWithinPartitions(F.col("_len").desc(), "_id"), "by-length")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """List column to rows x dims, short rows padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lens) and (lens == dims).all():
        return flat.reshape(len(lens), dims)
    out = np.zeros((len(lens), dims))
    out[np.arange(dims) < lens[:, None]] = flat
    return out


def _moments(vectors: DataFrame, dims: int) -> np.ndarray:
    """The sum of x x^T over all vectors: one packed row a task, MOMENT_GROUPS rows to the driver at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((dims, dims)), None
        for b in batches:
            x = _matrix(b.column("_v"), dims)
            total += x.T @ x
            if first is None and len(x):
                first = b.column("_id")[0].as_py()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first % MOMENT_GROUPS]), pa.array([total.tobytes()], pa.binary())], names=["at", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in rows["sums"])
        return pa.table({"at": rows["at"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    sums = vectors.mapInArrow(work, "at long, sums binary").groupBy("at").applyInArrow(add, "at long, sums binary").orderBy("at").toArrow()
    return sum((np.frombuffer(x).reshape(dims, dims) for x in sums["sums"].to_pylist()), np.zeros((dims, dims)))


def _merge(score: np.ndarray, ids: np.ndarray, new_score: np.ndarray, new_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists, each pair (id, score) once; best first, ties to smaller id."""
    s, i = np.concatenate((score, new_score)), np.concatenate((ids, new_ids))
    order = np.lexsort((i, ~s))
    s, i = s[order], i[order]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
    return s[keep][:k], i[keep][:k]


class _Block:
    """A block of queries, their best so far, and the rotation."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, basis: np.ndarray, head: int, k: int, exact: bool = True):
        self.ids, self.q, self.basis, self.head, self.k, self.exact_doubles = ids, q, basis, head, k, exact
        self.norm = np.sqrt((q * q).sum(axis=1))
        rotated = q @ basis
        self.front, self.back = rotated[:, :head], np.sqrt((rotated[:, head:] ** 2).sum(axis=1))
        self.score = [np.zeros(0, dtype=np.int64)] * len(ids)
        self.found = [np.zeros(0, dtype=np.int64)] * len(ids)
        self.least = np.full(len(ids), LOWEST)  # what a candidate must reach
        self.tests = self.exact = self.rotated = 0

    def offer(self, k: int, score: np.ndarray, ids: np.ndarray) -> None:
        self.score[k], self.found[k] = _merge(self.score[k], self.found[k], score, ids, self.k)
        if len(self.score[k]) == self.k:
            self.least[k] = max(self.least[k], self.score[k][-1])

    def limit(self) -> np.ndarray:
        """least for bounds in doubles."""
        return np.where(self.least == LOWEST, -np.inf, self.least)

    def reach(self) -> float:
        """No vector shorter than this can reach a place."""
        open_ = self.least <= 0
        if open_.any() or not len(self.ids):
            return -1.0
        return float((self.least / np.maximum(self.norm, 1e-300)).min()) * (1 - 1e-9) - 1e-9

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Inner products of rows, as integers."""
        if self.exact_doubles:
            return np.einsum("ij,ij->i", q, x).astype(np.int64)
        return np.array([sum(int(a) * int(b) for a, b in zip(*r)) for r in zip(q.tolist(), x.tolist())], dtype=np.int64)

    def run(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Offer candidates, given by descending length."""
        norm = np.sqrt((x * x).sum(axis=1))
        for at in range(0, len(ids), RUN):
            part = slice(at, at + RUN)
            slack = 1e-9 * (1 + self.norm * norm[at])
            live = np.flatnonzero(self.norm * norm[at] + slack >= self.limit())
            if not len(live):
                return
            rotated = x[part] @ self.basis
            front, back = rotated[:, : self.head], np.sqrt((rotated[:, self.head :] ** 2).sum(axis=1))
            self.rotated += len(rotated)
            for lo in range(0, len(live), RUN):
                some = live[lo : lo + RUN]
                bound = self.front[some] @ front.T + np.outer(self.back[some], back)
                r, c = np.nonzero(bound + slack[some, None] >= self.limit()[some, None])
                self.tests += bound.size
                self.exact += len(r)
                if self.exact_doubles and 4 * len(r) > bound.size:
                    value = (self.q[some] @ x[part].T)[r, c].astype(np.int64)
                else:
                    value = np.concatenate([np.zeros(0, np.int64), *(self.products(self.q[some[r[i : i + 65536]]], x[part][c[i : i + 65536]]) for i in range(0, len(r), 65536))])
                reach = (value >= self.least[some[r]]) & (ids[part][c] != self.ids[some[r]])
                r, c, value = r[reach], c[reach], value[reach]
                cuts = np.searchsorted(r, np.arange(len(some) + 1))
                for j in np.flatnonzero(np.diff(cuts)).tolist():
                    own = slice(cuts[j], cuts[j + 1])
                    v, i = value[own], ids[part][c[own]]
                    if len(v) > 4 * self.k:  # ties at the k-th stay
                        enough = v >= np.partition(v, -self.k)[-self.k]
                        distinct = len(np.unique(i[enough])) >= self.k
                        v, i = (v[enough], i[enough]) if distinct else (v, i)
                    self.offer(int(some[j]), v, i)

    def rows(self) -> list[np.ndarray]:
        """query ids, ids and scores of what is held."""
        n = np.fromiter(map(len, self.score), np.int64, len(self.score))
        return [np.repeat(self.ids, n), np.concatenate([np.zeros(0, np.int64), *self.found]), np.concatenate([np.zeros(0, np.int64), *self.score])]


def _wave(vectors: DataFrame, block: _Block, dims: int) -> None:
    """Offer these vectors, of the table by length, to a block."""
    spark, k, exact, basis, head = vectors.sparkSession, block.k, block.exact_doubles, block.basis, block.head
    shared = spark.sparkContext.broadcast({"ids": block.ids, "q": block.q, "least": block.least, "basis": basis})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        own = _Block(held["ids"], held["q"], held["basis"], head, k, exact)
        own.least = held["least"].copy()
        for batch in batches:
            x, ids = _matrix(batch.column("_v"), dims), batch.column("_id").to_numpy()
            order = np.argsort(-batch.column("_len").to_numpy(), kind="stable")
            own.run(ids[order], x[order])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in own.rows()], names=["query_id", "vec_id", "score"])

    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = vectors.where(F.col("_len") >= block.reach()).mapInArrow(work, _RESULT).distinct().withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= k)
    got = best.select("query_id", "vec_id", "score").sort("query_id").toArrow()  # k rows a query of the block
    shared.destroy()
    ids, found, score = (got[c].to_numpy() for c in got.schema.names)
    at = {q: j for j, q in enumerate(block.ids.tolist())}
    cuts = [*np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))).tolist(), len(ids)] if len(ids) else [0]
    for a, b in zip(cuts, cuts[1:]):
        block.offer(at[int(ids[a])], score[a:b], found[a:b])


def top_k(
    df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE,
    query_block: int = QUERY_BLOCK, seeds: int = SEEDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates."""
    spark = df.sparkSession
    vectors = by_length(usable(df, id_col, vec_col, scale))
    dims, longest, cuts = vectors.agg(F.coalesce(F.max(F.size("_v")), F.lit(0)), F.max("_len"), F.percentile_approx("_len", list(WAVES))).first()
    path = new_path(spark, "best")
    spark.createDataFrame([], _RESULT).write.parquet(path)
    longest = longest or 0.0
    if not np.isfinite(longest * longest * (1 + 1e-9)):
        raise OverflowError("a vector's squared length is no finite number")
    exact = longest * longest * (1 + 1e-9) < EXACT
    first = vectors.orderBy(F.col("_len").desc(), "_id").limit(seeds).select("_id", "_v").toArrow()
    values, basis = np.linalg.eigh(_moments(vectors, dims)) if dims else (np.zeros(0), np.zeros((0, 0)))
    values, basis = np.maximum(values[::-1], 0), basis[:, ::-1].copy()
    head = min(dims, 1 + int(np.searchsorted(np.cumsum(values), HEAD * values.sum())))
    each = max(1, min(query_block, BLOCK_BYTES // (8 * max(1, dims))))
    asked = vectors.where(is_query).groupBy("_id").agg(F.min("_v").alias("_v"))
    number = asked.count()
    blocks = max(1, -(-number // each))
    asked = materialise(asked.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks))).repartition("_block").sortWithinPartitions("_block"), "queries")
    bounds = [float("inf"), *sorted(set(cuts or []), reverse=True), -1.0]
    for b in range(blocks):
        got = asked.where(F.col("_block") == b).toArrow()
        if not len(got):
            continue
        block = _Block(got["_id"].to_numpy(), _matrix(got["_v"], dims), basis, head, k, exact)
        block.run(first["_id"].to_numpy(), _matrix(first["_v"], dims))
        for high, low in zip(bounds, bounds[1:]):
            _wave(vectors.where((F.col("_len") <= high) & (F.col("_len") > low)), block, dims)
        spark.createDataFrame(pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, block.rows()))))).write.mode("append").parquet(path)
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return spark.read.schema(_RESULT).parquet(path).withColumn("rank", F.row_number().over(place)).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fiftieth vector's five best among all others."""
    return top_k(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("_id") % EVERY == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""
