"""Substring deduplication by level-wise doubling.

A window is `window` consecutive words of one document. A word is removed if some window that
covers it also starts earlier: in a document with a smaller id, or earlier in the same document.

Method. Windows of a short length are hashed in every document and compared over the whole corpus.
Only windows repeated at that length are candidates for twice the length, since both halves of a
repeated window are repeated; the last level is the asked length. At the last level 128-bit hashes
are compared and each distinct window's first start is found.

Distribution. Documents are dealt into chunks by a hash of (id, text). Per level a chunk sends its
*distinct* candidate hashes (pre-aggregated, so a passage in a third of all documents costs one
entry a chunk), packed into one row for each range of the hash space ("bucket"). A bucket answers
with one bit an entry. Everything is one lazy plan: each step depends on rows alone and can be
recomputed after a lost executor; the exchange of documents by chunk is shared by all levels.
Intermediate levels compare 32 bits within a bucket: a clash there only keeps a candidate longer.

Defined results: null text has no words; null ids count as one id after all others; rows of equal
id are no earlier than one another at equal starts, so repeated rows get equal results; an empty
table gives an empty result; columns named like results are replaced, all others are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparsemill.llm.common import NULL_ID, U64, Words, as_bytes, bounded_batches, bucket_runs, cores, free_name, input_bytes, lean, load, mix, parts_for, with_chunk

WINDOW = 20
BASE = 5
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
#: Bytes of the last level's entry for one window, and bytes a word at the least, for sizing only.
_ENTRY, _WORD_BYTES = 28, 6
_A, _B = U64(0x9FB21C651E98DF25), U64(0xC2B2AE3D27D4EB4F)

_ROWS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])
_ROWS_SQL = "bucket long, chunk long, data binary"


def levels(window: int, base: int = BASE) -> list[int]:
    """base, 2 base, 4 base, ... and at last window itself."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _first_hash(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all n-word runs of one array, whatever documents they cross."""
    size = max(0, len(words) - n + 1)
    h = np.zeros(size, dtype=U64)
    factors = mix(np.arange(n, dtype=U64) + U64(1000 * seed)) | U64(1)
    for k in range(n):
        h += words[k : k + size] * factors[k]
    return mix(h)


def _next_hash(h: np.ndarray, step: int, seed: int) -> np.ndarray:
    """Hashes of runs that are step words longer, from the two runs that cover each."""
    size = max(0, len(h) - step)
    return mix(h[:size] * _A + (h[step : step + size] ^ U64(seed)) * _B)


class _Chunk:
    """One chunk's documents, and the windows that are still candidates at each level."""

    def __init__(self, docs: pa.Table, id_col: str, text_col: str, steps: list[int]):
        self.words = Words(as_bytes(docs[text_col]))
        self.ids = docs[id_col].fill_null(NULL_ID).to_numpy()
        self.steps, self.h = steps, self.words.hashes()
        self.left = np.repeat(self.words.first[1:], np.diff(self.words.first)) - np.arange(len(self.words))

    def hashes(self, level: int, seed: int = 0) -> np.ndarray:
        h = _first_hash(self.h, self.steps[0], seed)
        for a, b in zip(self.steps[:level], self.steps[1 : level + 1]):
            h = _next_hash(h, b - a, seed)
        return h

    def candidates(self, level: int, repeated: np.ndarray | None) -> np.ndarray:
        """Starts of windows of this level whose two halves were repeated at the level before."""
        size = max(0, len(self.words) - self.steps[level] + 1)
        fits = self.left[:size] >= self.steps[level]
        if repeated is not None:
            shift = self.steps[level] - self.steps[level - 1]
            fits &= repeated[:size] & repeated[shift : shift + size]
        return np.flatnonzero(fits)

    def entries(self, level: int, at: np.ndarray) -> dict:
        """The distinct windows at the starts `at`, sorted by hash, as this chunk sends them."""
        h = self.hashes(level)[at]
        if level < len(self.steps) - 1:
            keys, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
            return {"keys": keys, "inverse": inverse, "counts": counts}
        second, ids = self.hashes(level, seed=1)[at], self.ids[self.words.doc[at]]
        starts = at - self.words.first[self.words.doc[at]]
        order = np.lexsort((starts, ids, second, h))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])
        inverse = np.empty(len(order), dtype=np.int64)
        inverse[order] = np.cumsum(new) - 1
        lead = order[new]
        later = (ids != ids[lead][inverse]) | (starts != starts[lead][inverse]) if len(lead) else np.zeros(0, bool)
        return {"keys": h[lead], "second": second[lead], "ids": ids[lead], "starts": starts[lead], "inverse": inverse, "later": later}


def _send(chunk: int, found: dict, buckets: int) -> list[tuple[int, int, bytes]]:
    out = []
    for b, part in bucket_runs(found["keys"], buckets):
        if "second" in found:
            data = b"".join((found["keys"][part].tobytes(), found["second"][part].tobytes(), found["ids"][part].tobytes(), found["starts"][part].astype(np.uint32).tobytes()))
        else:
            data = found["keys"][part].astype(np.uint32).tobytes()
        out.append((b, chunk, data))
    return out


def _bits(found: dict, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """The answers' bits in the order of the entries."""
    out = np.zeros(len(found["keys"]), dtype=bool)
    for b, part in bucket_runs(found["keys"], buckets):
        out[part] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=part.stop - part.start).astype(bool)
    return out


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else ([], [], []), _ROWS)], schema=_ROWS)


def _answer(last: bool):
    """A bucket's answers: which entries are repeated, or at the last level, start earlier elsewhere."""

    def answer(rows: pa.Table) -> pa.Table:
        bucket, chunks, blobs = rows["bucket"][0].as_py(), rows["chunk"].to_pylist(), rows["data"].to_pylist()
        if bucket < 0:  # a chunk's notes to itself
            return rows.select(_ROWS.names)
        each = [len(x) // (_ENTRY if last else 4) for x in blobs]
        ends = np.cumsum(each)
        if last:
            views = [np.frombuffer(x, np.uint8) for x in blobs]
            take = lambda a, b, kind: np.concatenate([v[a * n : b * n].view(kind) for v, n in zip(views, each)])
            one, two, ids, starts = take(0, 8, U64), take(8, 16, U64), take(16, 24, np.int64), take(24, 28, np.uint32)
            order = np.lexsort((starts, ids, two, one))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            lead = order[new][np.cumsum(new) - 1]
            flag = np.zeros(len(order), dtype=bool)
            flag[order] = (ids[order] != ids[lead]) | (starts[order] != starts[lead])
        else:
            keys = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs])
            order = np.argsort(keys)
            same = keys[order][1:] == keys[order][:-1]
            flag = np.zeros(len(keys), dtype=bool)
            flag[order[1:][same]] = True
            flag[order[:-1][same]] = True
        return _table([(bucket, c, np.packbits(flag[e - n : e]).tobytes()) for c, e, n in zip(chunks, ends.tolist(), each)])

    return answer


def _read(answers: pa.Table | None) -> tuple[dict[int, bytes], np.ndarray | None]:
    if answers is None:
        return {}, None
    got = dict(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist()))
    notes = next((got.pop(b) for b in list(got) if b < 0), None)
    return got, None if notes is None else np.unpackbits(np.frombuffer(notes, np.uint8)).astype(bool)


def _in_order(docs: pa.Table, id_col: str, text_col: str) -> pa.Table:
    """The rows in an order of their own: rows equal in both columns have equal words, so any order of these will do."""
    return docs.take(pc.sort_indices(docs.select([id_col, text_col]), sort_keys=[(id_col, "ascending"), (text_col, "ascending")]))


def _step(level: int, steps: list[int], id_col: str, text_col: str, chunk_col: str, buckets: int, finish=None):
    """A chunk's work between two levels: take the answers for level - 1, ask for this level (or finish)."""

    def work(docs: pa.Table, answers: pa.Table | None) -> pa.Table:
        if not docs.num_rows:
            return finish(docs, None, None) if finish else _table([])
        docs = _in_order(docs, id_col, text_col)
        chunk, c = docs[chunk_col][0].as_py(), _Chunk(docs, id_col, text_col, steps)
        got, before = _read(answers)
        repeated = None
        if level:
            at = c.candidates(level - 1, before[: len(c.words)] if before is not None else None)
            found = c.entries(level - 1, at)
            bits = _bits(found, got, buckets)
            if finish:
                return finish(docs, c, at[found["later"] | bits[found["inverse"]]] if len(at) else at)
            repeated = np.zeros(len(c.words) + 1, dtype=bool)
            repeated[at[(bits | (found["counts"] > 1))[found["inverse"]]]] = True
        out = _send(chunk, c.entries(level, c.candidates(level, repeated)), buckets)
        if repeated is not None:
            out.append((-1 - chunk % buckets, chunk, np.packbits(repeated).tobytes()))
        return _table(out)

    if level:
        return work
    return lambda docs: work(docs, None)  # Spark tells the two kinds of group functions by their arguments


def remove_repeats(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, base: int = BASE,
    chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, kept_col: str = "kept_text",
) -> DataFrame:
    """df with n_words, n_removed and the kept words joined by one space in kept_col."""
    bounded_batches(df.sparkSession)
    steps, size = levels(window, base), input_bytes(df, text_col)
    chunks = parts_for(size, chunk_bytes, 2 * cores(df.sparkSession))
    buckets = parts_for(size // _WORD_BYTES * _ENTRY, bucket_bytes, cores(df.sparkSession))
    results = ["n_words", "n_removed", kept_col]
    carried = [c for c in df.columns if c.lower() not in {r.lower() for r in results} or c in (id_col, text_col)]
    added = [r for r in results if r not in carried]
    df = df.select(*carried)
    chunk_col = free_name(df, "_chunk")
    dealt = with_chunk(df, id_col, text_col, chunks, chunk_col)
    out_schema = T.StructType([*df.schema.fields, *(T.StructField(r, T.StringType() if r == kept_col else T.LongType()) for r in added)])

    def finish(docs: pa.Table, c: _Chunk | None, starts: np.ndarray | None) -> pa.Table:
        docs = docs.select(carried)
        n = np.zeros(docs.num_rows, dtype=np.int64)
        gone, kept = n.copy(), [b""] * docs.num_rows
        if c is not None:
            depth = np.zeros(len(c.words) + 1, dtype=np.int32)
            depth += np.bincount(starts, minlength=len(depth)).astype(np.int32)
            depth -= np.bincount(starts + window, minlength=len(depth)).astype(np.int32)
            keep = np.cumsum(depth[:-1]) == 0
            n = np.diff(c.words.first)
            total = np.concatenate(([0], np.cumsum(~keep)))
            gone = total[c.words.first[1:]] - total[c.words.first[:-1]]
            kept = [c.words.join(k, keep) for k in range(docs.num_rows)]
        new = {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), kept_col: pa.array(kept, pa.binary()).view(pa.string())}
        for name in added:
            docs = docs.append_column(name, new[name])
        return docs

    args = (id_col, text_col, chunk_col, buckets)
    asked = dealt.groupBy(chunk_col).applyInArrow(lean(_step(0, steps, *args)), _ROWS_SQL)
    for level in range(1, len(steps) + 1):
        answers = asked.groupBy("bucket").applyInArrow(lean(_answer(level == len(steps))), _ROWS_SQL)
        work, schema = (_step(level, steps, *args), _ROWS_SQL) if level < len(steps) else (_step(level, steps, *args, finish), out_schema)
        asked = dealt.groupBy(chunk_col).cogroup(answers.groupBy("chunk")).applyInArrow(lean(work), schema)
    return asked


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of the whole table: words, removed words, and the digest of the kept words."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    done = remove_repeats(docs)
    digest: Column = F.sha2(F.col("kept_text").cast("binary"), 256)
    return done.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w)::BIGINT - 19)) AS s FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) AS n FROM p),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS pos FROM r WHERE n > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w)::BIGINT)) AS pos FROM d),
g AS (SELECT x.doc_id, count(*) AS n_words, count(c.pos) AS n_removed, string_agg(word, ' ' ORDER BY x.pos) FILTER (c.pos IS NULL) AS kept
  FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.pos = x.pos GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""
