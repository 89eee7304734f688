r"""Spelling variants by a symmetric-delete join.

Words are maximal runs of `[A-Za-zÀ-ÿ]` of whole texts, with A-Z lower-cased, of at least
`least_chars` code points and `least_count` occurrences. Two words are near if they differ by exactly one
inserted, deleted or replaced code point. A word's form is its near word of the largest count (ties: the
smallest in code-point order), if that count is at least twice its own; its root is the last of its forms.

Method. Every word emits itself and its distinct single deletions as keys; words meet in an equi-join on keys. A key is
a 128-bit polynomial hash of its code points, of which all deletions of a word come from two running sums, and
carries the word's length and the run of equal letters that the deletion is taken from. That decides the distance
exactly: under one key, words of equal length whose runs overlap differ by one replaced letter (the deletion at a
common place leaves the same rest), and a word that is another's deletion differs by one letter. Each near pair meets
under exactly one key, so pairs need no second aggregation. Only the pairs that are near leave the join.

Counts double from a word to its form, so forms have no cycles and are at most log2(largest count) long; roots come from
pointer doubling, in as many rounds as that length has binary digits.

Distribution. Occurrences are counted in each Arrow batch before anything is sent, and again before the
shuffle. Words are numbered in code-point order by a range sort, so that keys and pairs carry numbers. A key
belongs to a number of words that the alphabet and its length bound (90 letters at each place), not the data;
a form or root that many words share is a skewed join, which adaptive execution splits.

Defined results: null texts hold no words; rows with null ids count, and their runs are never altered; repeated rows count
as often as they occur; an empty table gives an empty result; runs of any length are whole words; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsemill.llm.common import U64, as_bytes, bounded_batches, load, materialise, mix, slices

LEAST_CHARS, LEAST_COUNT, RATIO = 5, 3, 2
#: One run in so many loses a code point, by the checksum of its document's id and itself.
EVERY = 97
#: Bytes of words whose deletions are made at once.
KEY_BYTES = 1 << 17
_LONG = 64


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC = _crc_table()


# ---------------------------------------------------------------- counts


def letter_runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, starts, ends) of the maximal runs of letters in UTF-8 text."""
    raw = np.frombuffer(data, dtype=np.uint8)
    upper = (raw >= 65) & (raw <= 90)
    buf = np.where(upper, raw + 32, raw).astype(np.uint8)
    lead = raw == 0xC3  # leads U+00C0 to U+00FF, and nothing else
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = upper | ((raw >= 97) & (raw <= 122)) | lead
    inside[2:-1] |= lead[:-1]
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    return buf, turn[0::2], turn[1::2]


def checksums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, carried on from the checksum of what stands before it."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    state, start, size = before[order].astype(np.uint32), starts[order], size[order]
    long = int(np.count_nonzero(size > _LONG))
    for k in range(long):
        state[k] = zlib.crc32(buf[start[k] : start[k] + size[k]].tobytes(), int(state[k]))
    inverted = ~state
    active = len(size) - np.cumsum(np.bincount(np.minimum(size, _LONG + 1), minlength=_LONG + 2))  # runs longer than k
    for k in range(_LONG):
        part = slice(long, int(active[k]))
        if part.stop <= long:
            break
        s = inverted[part]
        inverted[part] = _CRC[(s ^ buf[start[part] + k]) & 255] ^ (s >> np.uint32(8))
    inverted[:long] = ~state[:long]
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = ~inverted
    return out


def count_runs(ids: list[int | None], texts: list[bytes], least_chars: int = LEAST_CHARS, every: int = EVERY) -> tuple[pa.Array, pa.Array]:
    """The distinct words of some texts and their counts; an altered run may be listed beside the same word."""
    buf, starts, ends = letter_runs(b"\n".join(texts))
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    doc = np.searchsorted(text_ends, starts, side="right")
    before = np.array([zlib.crc32(b"%d:" % i) if i is not None else 0 for i in ids], dtype=np.uint32)
    known = np.array([i is not None for i in ids], dtype=bool)
    crc = checksums(buf, starts, ends, before[doc])
    altered = (crc % every == 0) & known[doc]
    heads = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    chars = heads[ends] - heads[starts]
    keep = ~altered & (chars >= least_chars)
    size = (ends - starts)[keep]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    place = np.repeat(starts[keep] - offsets[:-1], size) + np.arange(offsets[-1])
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(buf[place].tobytes()))
    changed = []
    for k in np.flatnonzero(altered & (chars > least_chars)).tolist():
        run, at = buf[starts[k] : ends[k]].tobytes().decode(), int(crc[k]) % int(chars[k])
        changed.append(run[:at] + run[at + 1 :])
    counted = pc.value_counts(pa.chunked_array([words, pa.array(changed, pa.large_string())]))
    return counted.field("values"), counted.field("counts")


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n) of the words that occur least_count times in the whole table."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                words, n = count_runs(part.column("id").to_pylist(), as_bytes(part.column("text")), least_chars, every)
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), n], names=["word", "n"])

    each = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(work, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- the join


def numbered(words: DataFrame) -> DataFrame:
    """words (word, n) with id: their number in code-point order, from 0."""
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(words.repartitionByRange(parts, "word").withColumn("part", F.spark_partition_id()), "words")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = dealt.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("word")) - 1
    return dealt.join(F.broadcast(bases), "part").select("word", "n", (F.col("base") + inside).alias("id"))


_KEYS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])
_KEYS_SQL = "k1 long, k2 long, id long, n long, size int, a int, b int"
_ODD = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def word_keys(words: list[str]) -> dict[str, np.ndarray]:
    """Each word's keys: itself (a = b = -1) and its distinct single deletions, with the run [a, b] of equal letters that each is taken from."""
    chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(U64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(chars)) - first[word]
    begin = np.ones(len(chars), dtype=bool)
    begin[1:] = (chars[1:] != chars[:-1]) | (at[1:] == 0)
    runs = np.flatnonzero(begin)
    last = np.append(runs[1:], len(chars)) - 1
    out = {"word": np.concatenate((np.arange(len(words)), word[runs])), "size": np.concatenate((size, size[word[runs]]))}
    out |= {"a": np.concatenate((np.full(len(words), -1), at[runs])), "b": np.concatenate((np.full(len(words), -1), at[last]))}
    for name, odd in zip(("k1", "k2"), _ODD):
        power = np.concatenate(([U64(1)], np.cumprod(np.full(int(size.max(initial=1)), odd, dtype=U64))))
        sums = np.concatenate(([U64(0)], np.cumsum(mix(chars ^ odd) * power[at])))  # all arithmetic is modulo 2^64
        whole = sums[first + size] - sums[first]
        upto, through = sums[runs] - sums[first[word[runs]]], sums[runs + 1] - sums[first[word[runs]]]
        inverse = U64(pow(int(odd), -1, 1 << 64))
        shorter = upto + (whole[word[runs]] - through) * inverse
        out[name] = mix(np.concatenate((whole, shorter)) ^ mix((out["size"] - (out["a"] >= 0)).astype(U64)))
    return out


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n, id) to (id, n_near, best_n, best): near words counted, and the one of the largest count (ties: smallest id)."""
    bounded_batches(words.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word", KEY_BYTES):
                k = word_keys(part.column("word").to_pylist())
                ids, n = (part.column(c).to_numpy()[k["word"]] for c in ("id", "n"))
                cols = [k["k1"].view(np.int64), k["k2"].view(np.int64), ids, n, k["size"].astype(np.int32), k["a"].astype(np.int32), k["b"].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_KEYS)

    keys = materialise(words.select("word", "n", "id").mapInArrow(work, _KEYS_SQL), "keys")
    x, y = keys.alias("x"), keys.alias("y")
    # lengths and runs tell whether two words of one key are at distance one
    replaced = (F.col("x.size") == F.col("y.size")) & (F.col("x.a") >= 0) & (F.col("y.a") >= 0) & (F.col("x.a") <= F.col("y.b")) & (F.col("y.a") <= F.col("x.b"))
    shorter = F.abs(F.col("x.size") - F.col("y.size")) == 1
    met = x.join(y, (F.col("x.k1") == F.col("y.k1")) & (F.col("x.k2") == F.col("y.k2")) & (F.col("x.id") != F.col("y.id")) & (replaced | shorter))
    best = F.max(F.struct(F.col("y.n").alias("n"), (-F.col("y.id")).alias("id")))
    return met.groupBy(F.col("x.id").alias("id")).agg(F.count("*").alias("n_near"), best.alias("best")).select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.id")).alias("best"))


def last_of(pointers: DataFrame) -> DataFrame:
    """(id, to) without cycles, to (id, last): where the pointers from each id end."""
    done, active = None, materialise(pointers.select("id", "to"), "pointers")
    while not active.isEmpty():
        on = active.select(F.col("id").alias("to"), F.col("to").alias("_next"))
        # all active pointers are of one length; those that cannot be doubled end where the rest of the way is known
        joined = materialise(active.join(on, "to", "left").select("id", "to", "_next"), "pointers")
        ended = joined.where("_next is null").select("id", "to")
        if done is not None:
            way = done.select(F.col("id").alias("to"), F.col("to").alias("_last"))
            ended = ended.join(way, "to", "left").select("id", F.coalesce("_last", "to").alias("to"))
        done = materialise(ended if done is None else done.unionByName(ended), "ends")
        active = joined.where("_next is not null").select("id", F.col("_next").alias("to"))
    return (pointers.select("id", "to") if done is None else done).select("id", F.col("to").alias("last"))


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs."""
    counted = word_counts(docs, id_col=id_col, text_col=text_col, least_chars=least_chars, least_count=least_count, every=every)
    words = materialise(numbered(counted), "numbered")
    near = words.join(near_words(words), "id", "left").withColumn("to", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")))
    near = materialise(near.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "to", "best_n"), "near")
    formed = near.where("to is not null")
    names = words.select(F.col("id").alias("_id"), F.col("word").alias("_word"))
    named = lambda df, by, out: df.join(names, df[by] == names["_id"]).drop("_id").withColumnRenamed("_word", out)
    rooted = named(named(formed.join(last_of(formed), "id"), "to", "form"), "last", "root")
    alone = near.where("to is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return alone.unionByName(rooted.select("word", "form", "root", "n", "n_near", F.col("best_n").alias("form_n")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms and roots."""
    return variants(load(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = r"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
t AS (SELECT doc_id, run, count(*) AS times FROM r GROUP BY 1, 2),
x AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || run)) AS bytes FROM t),
h AS (SELECT *, xor(4294967295::BIGINT, list_reduce(list_transform(generate_series(1, length(bytes), 2), lambda k: ('0x' || substr(bytes, k::BIGINT, 2))::BIGINT),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END), 4294967295::BIGINT)) AS crc FROM x),
o AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, times FROM h),
w AS (SELECT word, sum(times)::BIGINT AS n FROM o WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3),
k AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS key FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS p FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.key = b.key AND a.p = b.p AND a.word <> b.word
  UNION SELECT w.word, k.word, k.n FROM w JOIN k ON k.key = w.word UNION SELECT k.word, w.word, w.n FROM w JOIN k ON k.key = w.word),
g AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS best, max(m) AS m FROM p GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * w.n THEN best END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN g ON g.word = w.word),
z AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, z.root FROM f JOIN z ON f.form = z.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word"""
