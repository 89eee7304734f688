"""Byte-level BPE encoding and decoding with a public rank file.

Method. A text is cut by the tokenizer's pattern; each distinct piece of a batch is encoded once.
A piece that is itself a token is that token. All other pieces go, by length, into padded matrices
of token ids, one row a piece. Each round looks up the rank of neighbouring pairs in a hash table,
merges every row's leftmost pair of least rank, and closes the gap (compaction); rows without a
pair left leave the matrix. Very long pieces go one a matrix, and there a round merges the whole run of
leftmost least-rank pairs up to the first merge that makes a pair of lower rank, which is what
merging them one by one does.

Ids travel packed: little-endian unsigned 32-bit integers in a binary column.

Defined results: null text is encoded as empty text (no ids), null ids decode to empty bytes;
repeated rows get equal results; other columns are carried along, columns named like the results
are replaced; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparsemill.llm.common import bounded_batches, load, mix, slices

NONE = np.int32((1 << 31) - 1)  # the rank of a pair that never merges
#: Longest piece (bytes) that shares a matrix with others, cells of a matrix, remembered pieces, and the longest of those (characters).
SHARED_WIDTH, CELLS, REMEMBERED, SHORT = 256, 1 << 18, 150_000, 64


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing in two numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64((1 << 64) - 1))
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64((1 << 64) - 1)
            want = todo[free]
            _, firsts = np.unique(slot[want], return_index=True)
            put = want[firsts]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], merged[put]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(20)).astype(np.int64) & self.mask

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids (their ranks), NONE where a pair never merges; negative ids are padding."""
        keys = (left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        slot, out = self._slot(keys), np.full(len(keys), NONE, dtype=np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != np.uint64((1 << 64) - 1))]
            slot[todo] = (slot[todo] + 1) & self.mask
        return out


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        found = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*np.array(found or np.zeros((0, 3)), dtype=np.int32).T)
        self.known: dict[str, bytes] = {}

    # -- merging

    def _shared(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most width bytes: one matrix, a merge in every row a round."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        ids = np.full((n, width), -1, dtype=np.int32)
        ids[np.arange(width) < lens[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((n, width), NONE, dtype=np.int32)
        r, c = np.nonzero(np.arange(width - 1) < (lens - 1)[:, None])
        rank[r, c] = self.pairs.get(ids[r, c], ids[r, c + 1])
        rows, out = np.arange(n), [None] * n
        while len(rows):
            at = rank.argmin(axis=1)  # the leftmost least
            best = rank[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                for k in np.flatnonzero(over).tolist():
                    out[rows[k]] = ids[k, : lens[k]].copy()
                keep = ~over
                most = int(lens[keep].max(initial=1))
                rows, ids, rank, lens, at, best = rows[keep], ids[keep, :most], rank[keep, :most], lens[keep], at[keep], best[keep]
                if not len(rows):
                    break
            width, every = ids.shape[1], np.arange(len(rows))
            source = np.arange(width) + (np.arange(width) > at[:, None])  # compaction: what follows the pair moves left
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), source, axis=1)
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=NONE), source, axis=1)
            lens = lens - 1
            ids[every, at] = best
            right = np.where(at + 1 < lens, ids[every, np.minimum(at + 1, width - 1)], -1)
            rank[every, at] = np.where(right >= 0, self.pairs.get(best, right), NONE)
            has = at > 0
            rank[every[has], at[has] - 1] = self.pairs.get(ids[every[has], at[has] - 1], best[has])
        return out

    def _alone(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: a round merges the run of least-rank pairs that come next anyway."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.get(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            if len(at) > 1:  # of overlapping pairs, every second one of a run
                new = np.ones(len(at), dtype=bool)
                new[1:] = np.diff(at) > 1
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                at = at[run % 2 == 0]
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            joined = np.zeros(len(at), dtype=bool)
            joined[1:] = at[1:] - at[:-1] == 2
            left = np.where(joined, best, np.where(at > 0, ids[np.maximum(at - 1, 0)], -1))
            made = np.full(len(at), best, dtype=np.int32)
            lower = np.zeros(len(at), dtype=bool)
            for ok, pair in ((right >= 0, (made, right)), (left >= 0, (left, made))):
                lower[ok] |= self.pairs.get(pair[0][ok], pair[1][ok]) < best
            if lower.any():
                at = at[: int(np.argmax(lower)) + 1]
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
            now = at - np.arange(len(at))  # where the merged tokens are now
            rank = np.delete(rank, at)
            for k in (now - 1, now):
                k = k[(k >= 0) & (k < len(rank))]
                rank[k] = self.pairs.get(ids[k], ids[k + 1])
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(p) > SHARED_WIDTH:
                out[k] = self._alone(p).astype("<u4").tobytes()
            else:
                by_width.setdefault(max(4, 1 << (len(p) - 1).bit_length()) if len(p) > 24 else -(-len(p) // 4) * 4, []).append(k)
        for width, members in by_width.items():
            each = max(1, CELLS // width)
            for i in range(0, len(members), each):
                part = members[i : i + each]
                for k, ids in zip(part, self._shared([pieces[k] for k in part], width)):
                    out[k] = ids.astype("<u4").tobytes()
        return out

    # -- texts

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        found = [self.find(t) if t else [] for t in texts]
        new = list({p for f in found for p in f}.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list({p for f in found for p in f})
        self.known.update(zip(new, self.encode_pieces([p.encode("utf-8", "replace") for p in new])))
        get = self.known.__getitem__
        out = [b"".join(map(get, f)) for f in found]
        for p in new:
            if len(p) > SHORT:  # what is remembered is bounded in bytes too
                del self.known[p]
        return out

    def decode_batch(self, packed: list[bytes | None]) -> list[bytes]:
        get = self.tokens.__getitem__
        return [b"".join(map(get, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in packed]


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str, pattern: str) -> Tokenizer:
    with open(vocabulary, "rb") as f:
        return Tokenizer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c.lower() not in {n.lower() for n in new}]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new.values()], names=[*kept, *new])


def _schema(df: DataFrame, new: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in new}), *(T.StructField(n, t) for n, t in new.items())])


def encode(df: DataFrame, *, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens") -> DataFrame:
    """df with the packed token ids of text_col and their number."""

    bounded_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                ids = t.encode_batch(part.column(text_col).to_pylist())
                yield _with(part, {count_col: pa.array([len(x) // 4 for x in ids], pa.int64()), ids_col: pa.array(ids, pa.binary())})

    return df.mapInArrow(work, _schema(df, {count_col: T.LongType(), ids_col: T.BinaryType()}))


def decode(df: DataFrame, *, vocabulary: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the bytes that the packed ids stand for."""

    bounded_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, ids_col, 1 << 20):
                yield _with(part, {bytes_col: pa.array(t.decode_batch(part.column(ids_col).to_pylist()), pa.binary())})

    return df.mapInArrow(work, _schema(df, {bytes_col: T.BinaryType()}))


def multilingual() -> dict[str, str]:
    """The production vocabulary and pattern."""
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def digest(docs: DataFrame, **vocabulary: str) -> DataFrame:
    """Encode doc_id, text; decode again; number and digests of both."""
    back = decode(encode(docs, **vocabulary).drop("text"), **vocabulary)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(load(spark, sf_dir, "documents").select("doc_id", "text"), **multilingual())
