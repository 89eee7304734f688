"""What the corpus operators share: shared-folder tables, chunking, and vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import inspect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsemill.sources.shared import drop, drop_tables, materialise, new_path, scope  # noqa: F401

#: Words are runs of anything but these six ASCII characters (bytes.split() uses the same set).
WORD = r"[^\x20\x09-\x0D]+"

#: Sort keys for null ids: after every real id.
NULL_ID = (1 << 63) - 1


# ---------------------------------------------------------------- session and shared tables


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch between the JVM and Python, at most: bounds what long texts take in both.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches to BATCH_BYTES, if it is larger; it stays so afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).rstrip("bB")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def lean(work):
    """A group function that hands freed memory back to the system: workers live on between stages."""
    if len(inspect.signature(work).parameters) == 2:
        return lambda left, right: trim(work(left, right))
    return lambda rows: trim(work(rows))


def trim(result=None):
    """Return unused memory of this Python process to the system; gives its argument back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own habits
        pass
    return result


def input_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes that df is read from, by the optimiser's statistics of its sources; counted where they have none."""
    sources = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(sources.apply(k).stats().sizeInBytes())) for k in range(sources.length()))
    if 0 < known < 1 << 55:
        return known
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long") + 16), F.lit(0))).first()[0]


def parts_for(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def in_struct(columns: list[str]) -> Column:
    """These columns as one struct, _rest: no name that an operator uses can meet one of them."""
    return (F.struct(*columns) if columns else F.lit(None).cast("int")).alias("_rest")


def packed(df: DataFrame, *inputs: str) -> DataFrame:
    """df's inputs, and all its other columns in _rest."""
    return df.select(*inputs, in_struct([c for c in df.columns if c not in inputs]))


def unpacked(df: DataFrame, columns: list[str], inputs: tuple[str, ...]) -> list[Column]:
    """These columns of a packed table."""
    return [df[c] if c in inputs else F.col("_rest").getField(c).alias(c) for c in columns]


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def doc_hash(id_col: str, text_col: str) -> Column:
    """A stable hash of (id, text): equal only for repeated rows, whatever order rows arrive in."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def with_chunk(df: DataFrame, id_col: str, text_col: str, chunks: int, name: str = "_chunk") -> DataFrame:
    """Add a chunk number that depends on the row alone, so that a recomputed chunk is the same chunk."""
    return df.withColumn(name, F.pmod(doc_hash(id_col, text_col), F.lit(chunks)).cast("long"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it (any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: str | int, most_bytes: int = 2 << 20):
    """Cut a batch into runs of rows of about most_bytes in one string column; whole rows always."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    trim()


# ---------------------------------------------------------------- vectorised words and hashes

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_SEP = np.zeros(256, dtype=bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x + _GOLDEN
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(256, dtype=U64) + U64(77))
_STEP = U64(0xD6E8FEB86659FD93)


class Words:
    """The words of some texts, as offsets into one buffer.

    buf: bytes of all texts; start, length: of each word; doc: its text's index;
    first: of each text, the index of its first word (one more entry at the end).
    """

    def __init__(self, texts: list[bytes], lower: bool = False, between: np.ndarray = _SEP):
        """between: of each byte (after lower-casing A-Z, if asked), whether it lies between words; a line feed must."""
        self.data = b"\n".join(texts)
        buf = np.frombuffer(self.data, dtype=np.uint8)
        if lower:
            buf = _LOWER[buf]
        self.buf = buf
        edge = np.ones(len(buf) + 2, dtype=bool)
        edge[1:-1] = between[buf]
        turn = np.flatnonzero(edge[1:] != edge[:-1])
        self.start, end = turn[0::2], turn[1::2]
        self.length = end - self.start
        lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.cumsum(lens + 1) - (lens + 1)
        self.first = np.append(np.searchsorted(self.start, begins), len(self.start)).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.start)
        order = np.argsort(np.minimum(self.length, _LONG_WORD + 1).astype(np.uint8), kind="stable")[::-1]
        start, length = self.start[order], self.length[order]
        h = np.zeros(n, dtype=U64)
        long = int(np.count_nonzero(length > _LONG_WORD))
        for k in range(long):
            import xxhash

            at = int(start[k])
            h[k] = xxhash.xxh64_intdigest(self.buf[at : at + int(length[k])].tobytes(), 1)
        steps = np.bincount(np.minimum(length[long:], _LONG_WORD), minlength=_LONG_WORD + 1)
        active = n - long
        for k in range(_LONG_WORD):
            active -= int(steps[k])
            if active <= 0:
                break
            part = slice(long, long + active)
            h[part] = h[part] * _STEP + _BYTE[self.buf[start[part] + k]]
        out = np.empty(n, dtype=U64)
        out[order] = mix(h ^ (length.astype(U64) << U64(48)))
        return out

    def join(self, doc: int, keep: np.ndarray | None = None) -> bytes:
        """The (kept) words of one text joined by single spaces."""
        lo, hi = self.first[doc], self.first[doc + 1]
        picked = np.arange(lo, hi) if keep is None else np.flatnonzero(keep[lo:hi]) + lo
        data = self.data
        return b" ".join([data[a : a + b] for a, b in zip(self.start[picked].tolist(), self.length[picked].tolist())])


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column's values as UTF-8, null as empty, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            return [x for c in column.chunks for x in as_bytes(c)]
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def bucket_runs(sorted_keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(range, where its keys are) for those of equal ranges of the 64-bit space that sorted keys fall into; its time depends on the keys alone."""
    names, begins = np.unique(sorted_keys // U64((1 << 64) // buckets + 1) if buckets > 1 else np.zeros(len(sorted_keys), U64), return_index=True)
    ends = [*begins[1:].tolist(), len(sorted_keys)]
    return zip(names.tolist(), map(slice, begins.tolist(), ends))


def table(schema: pa.Schema, columns: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
