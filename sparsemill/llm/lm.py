"""Language-model scoring by deleted interpolation.

Model. P(w | u v) = m(a) c(u v w)/c(u v) + (1 - m(a)) P(w | v) and P(w | v) = l2(b) c(v w)/c(v) + l1(b) c(w)/N + l0(b) /(V+1),
with u, v the words before (or the text's beginning, twice), a and b buckets of c(u v) and c(v) by powers of two. The weights of each
bucket are learned by expectation-maximisation on held-out counts: one training document in FOLD is deleted from the counts, and its
tokens are explained by what the other training documents hold; first the l, then the m. Scores then use all training counts.
The text's score is the sum of log10 over its tokens, an end token included.

Distribution. Documents are dealt into chunks by a hash of (id, text); a chunk holds documents of one
kind only: learned from, learned from but deleted for the weights, or only scored. A chunk sends its
*distinct* words and word pairs with their counts, packed in one row for each range of the hash space;
ranges add up over chunks and answer with the corpus counts, in the order of the entries. Word triples follow in an exchange
of their own, when the files of the first one are gone, so that disk holds one of them at a time. Answers are
tables in the shared folder. For the weights, chunks of deleted documents sum their tokens over
cells (bucket, levels of the two ratios, eight to a power of two): a table of bounded size, whatever the
corpus, from which the driver runs the iterations. Words are told apart by 64-bit hashes, pairs and triples by the
lower 48 bits and the range, which grows finer with the corpus.

Defined results: null text is empty (one token, the end); null ids are scored and not learned from;
repeated rows count as often as they occur; with nothing to learn from every word is unknown (N = V = 0);
an empty table gives an empty result; columns named like the results are replaced, others are carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparsemill.llm.common import U64, Words, as_bytes, bounded_batches, bucket_runs, cores, doc_hash, free_name, free_shuffles, input_bytes, lean, load, materialise, mix, parts_for

CHUNK_BYTES, BUCKET_BYTES = 5 << 20, 14 << 20
#: One in FOLD training documents gives the held-out counts; kinds of chunks.
FOLD = 8
LEARN, DELETED, SCORED = 0, 1, 2
#: Buckets of context counts; levels a power of two and lowest exponent of a ratio's cell; EM steps.
CONTEXTS, LEVELS, LOWEST, STEPS = 25, 8, 40, 60
_END, _BEGIN = mix(np.array([3, 5], dtype=U64))
_A, _B = U64(0x9FB21C651E98DF25), U64(0xC2B2AE3D27D4EB4F)
WORDS, PAIRS, TRIPLES = 0, 1, 2
KEY_BYTES = (8, 6, 6)
_SQL = "part long, kind int, chunk long, data binary"
_ROWS = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])


def _pack(keys: np.ndarray, width: int) -> bytes:
    return keys.tobytes() if width == 8 else keys.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width == 8:
        return np.frombuffer(data, U64, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
    return out.reshape(-1).view(U64)


class _Chunk:
    """Tokens of a chunk's texts, and its distinct words, pairs and (if asked) triples."""

    def __init__(self, docs: pa.Table, text_col: str, triples: bool = False):
        words = Words(as_bytes(docs[text_col]), lower=True)
        n, per = len(words), np.diff(words.first)
        at = np.arange(n) + words.doc  # each earlier text has an end of its own
        self.first = words.first[:-1] + np.arange(len(per))
        self.n_tokens = per + 1
        tokens = np.full(n + len(per), _END, dtype=U64)
        tokens[at] = words.hashes()
        before = np.empty(len(tokens), dtype=U64)
        before[1:] = tokens[:-1]
        before[self.first] = _BEGIN
        two = mix(before * _A + (tokens ^ _B))
        self.pair, self.pair_at, self.pair_n = np.unique(two, return_inverse=True, return_counts=True)
        if triples:
            context = np.empty(len(tokens), dtype=U64)
            context[1:] = two[:-1]
            context[self.first] = mix(_BEGIN[None] * _A + (_BEGIN ^ _B))
            self.triple, self.triple_at, self.triple_n = np.unique(mix(context * _A + (tokens ^ _B)), return_inverse=True, return_counts=True)
        # the beginning is counted like a word, once a text, but is no token
        self.word, inverse, self.word_n = np.unique(np.concatenate((tokens, np.full(len(per), _BEGIN, dtype=U64))), return_inverse=True, return_counts=True)
        self.token_at = inverse[: len(tokens)]
        self.before_at = np.empty(len(tokens), dtype=np.int64)
        self.before_at[1:] = self.token_at[:-1]
        self.before_at[self.first] = inverse[len(tokens) :]

    def pair_context(self, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Each token's c(u v); where a text begins, the number of texts."""
        out = np.empty(len(self.pair_at), dtype=np.int64)
        out[1:] = pairs[self.pair_at[:-1]]
        out[self.first] = words[self.before_at[self.first]]
        return out


def _ask(buckets: int, chunk_col: str, text_col: str, triples: bool = False):
    """Words and pairs, or triples, of a chunk: a row for each range."""

    def work(docs: pa.Table) -> pa.Table:
        chunk, c, rows = docs[chunk_col][0].as_py(), _Chunk(docs, text_col, triples), []
        for kind, keys, counts in ((TRIPLES, c.triple, c.triple_n),) if triples else ((WORDS, c.word, c.word_n), (PAIRS, c.pair, c.pair_n)):
            for b, part in bucket_runs(keys, buckets):
                data = _pack(keys[part], KEY_BYTES[kind]) + (b"" if chunk % 3 == SCORED else counts[part].astype(np.uint32).tobytes())
                rows.append((b * 3 + kind, kind, chunk, data))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

    return work


def _add_up(rows: pa.Table) -> pa.Table:
    """Corpus counts for every entry: training, and to chunks of deleted documents also the deleted part.

    An answer's first byte says whether its counts have 4 bytes or 8: a word may occur more than 2^32 times. Their first bytes come first, then
    their second ones, and so on, which compresses well. One more row (chunk -1) has, for words, the sums of tokens and of distinct ones.
    """
    part, kind = rows["part"][0].as_py(), rows["kind"][0].as_py()
    chunks, blobs = rows["chunk"].to_pylist(), rows["data"].to_pylist()
    width = KEY_BYTES[kind]
    number = [len(x) // (width if c % 3 == SCORED else width + 4) for c, x in zip(chunks, blobs)]
    keys = np.concatenate([_unpack(x, n, width) for x, n in zip(blobs, number)])
    counts = np.concatenate([np.zeros(n, np.uint32) if c % 3 == SCORED else np.frombuffer(x, np.uint32, n, width * n) for c, x, n in zip(chunks, blobs, number)])
    del blobs
    lost = np.concatenate([counts[e - n : e] if c % 3 == DELETED else np.zeros(n, np.uint32) for c, n, e in zip(chunks, number, np.cumsum(number).tolist())])
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    total, deleted = (np.add.reduceat(x[order], begins, dtype=np.int64) for x in (counts, lost))
    out = []
    for c, n, e in zip(chunks, number, np.cumsum(number).tolist()):
        g = group[e - n : e]
        width = 4 if total[g].max() < 1 << 32 else 8
        out.append((part, kind, c, b"".join([bytes([width]), *(x[g].astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes() for x in ((total, deleted) if c % 3 == DELETED else (total,)))])))
    if kind == WORDS:
        real = keys[new] != _BEGIN
        learned, rest = total[real], (total - deleted)[real]
        out.append((part, kind, -1, f"{learned.sum()},{(learned > 0).sum()},{rest.sum()}".encode()))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _ROWS)], schema=_ROWS)


def _counts(answers: pa.Table, kind: int, n: int, deleted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(training, deleted) counts in the order of the entries: parts are ranges of the hash, in order."""
    rows = sorted((p, d) for p, k, d in zip(answers["part"].to_pylist(), answers["kind"].to_pylist(), answers["data"].to_pylist()) if k == kind)
    parts = [np.zeros((1 + deleted, 0), np.int64)]
    for _, d in rows:
        planes = np.frombuffer(d, np.uint8, offset=1).reshape(1 + deleted, d[0], -1)
        parts.append(np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f"<u{d[0]}")[..., 0].astype(np.int64))
    whole = np.concatenate(parts, axis=1)
    return whole[0], whole[1] if deleted else np.zeros(n, np.int64)


def _context(count: np.ndarray) -> np.ndarray:
    return np.minimum(CONTEXTS - 1, np.frexp(count.astype(np.float64))[1])  # 0: none, 1: 1, 2: 2-3, ...


def _level(ratio: np.ndarray) -> np.ndarray:
    """Cells of a ratio in (0, 1]; 0 is for none."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.clip(np.rint(np.log2(ratio) * LEVELS), -LOWEST * LEVELS, 0) + LOWEST * LEVELS + 1, 0).astype(np.int64)


_SPAN = LOWEST * LEVELS + 2


def _two(context: np.ndarray, pairs: np.ndarray, words: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Ratios of pairs and of words."""
    return pairs / np.maximum(1, context), words / max(1, tokens)


def _of_pairs(weights: np.ndarray, context: np.ndarray, two: np.ndarray, one: np.ndarray, distinct: int) -> np.ndarray:
    """P(w | v)."""
    w = weights[_context(context)]
    return w[:, 0] * two + w[:, 1] * one + w[:, 2] / (distinct + 1)


def _cells(chunk_col: str, text_col: str, rest: int, distinct: int = 0, weights: np.ndarray | None = None):
    """Tokens of deleted documents by (context bucket, levels of two ratios): of the pair's and the word's, or, given the weights of these, of the triple's and P(w | v)."""

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        c = _Chunk(docs, text_col, weights is not None)
        words, gone = _counts(answers, WORDS, len(c.word), True)
        words = words - gone
        pairs, gone = _counts(answers, PAIRS, len(c.pair), True)
        pairs = pairs - gone
        context = words[c.before_at]
        high, low = _two(context, pairs[c.pair_at], words[c.token_at], rest)
        if weights is not None:
            low = _of_pairs(weights, context, high, low, distinct)
            context = c.pair_context(words, pairs)
            triples, gone = _counts(answers, TRIPLES, len(c.triple), True)
            high = (triples - gone)[c.triple_at] / np.maximum(1, context)
        cell, n = np.unique((_context(context) * _SPAN + _level(high)) * _SPAN + _level(low), return_counts=True)
        return pa.table({"cell": pa.array(cell), "n": pa.array(n)})

    return work


def _ratios(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and both ratios of cells."""
    ratio = lambda k: np.where(k > 0, 2.0 ** ((k - 1 - LOWEST * LEVELS) / LEVELS), 0.0)
    return cells // _SPAN // _SPAN, ratio(cells // _SPAN % _SPAN), ratio(cells % _SPAN)


def _em(bucket: np.ndarray, parts: np.ndarray, n: np.ndarray, steps: int, unseen: list[float]) -> np.ndarray:
    """Weights of the parts by EM for each context bucket; buckets that saw nothing get the pooled ones, and all get unseen where there is nothing at all."""

    def em(at: np.ndarray) -> np.ndarray:
        w = np.full(parts.shape[1], 1 / parts.shape[1])
        for _ in range(steps):
            share = parts[at] * w
            share *= (n[at] / share.sum(axis=1))[:, None]
            w = np.maximum(share.sum(axis=0) / n[at].sum(), 1e-7)
            w /= w.sum()
        return w

    pooled = em(np.arange(len(bucket))) if len(bucket) else np.array(unseen)
    out = np.stack([em(at) if len(at := np.flatnonzero(bucket == b)) else pooled for b in range(CONTEXTS)])
    out[0] = np.array([0, *(out[0][1:] / out[0][1:].sum())])  # an unseen context says nothing
    return out


def learn_weights(cells: np.ndarray, n: np.ndarray, distinct: int, steps: int = STEPS) -> np.ndarray:
    """Weights (pair, word, uniform) of each bucket of c(v)."""
    bucket, two, one = _ratios(cells)
    return _em(bucket, np.stack([two, one, np.full(len(cells), 1 / (distinct + 1))], axis=1), n, steps, [0.4, 0.4, 0.2])


def learn_triples(cells: np.ndarray, n: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights (triple, P(w | v)) of each bucket of c(u v)."""
    bucket, three, lower = _ratios(cells)
    return _em(bucket, np.stack([three, lower], axis=1), n, steps, [0.4, 0.6])


def score(
    df: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True,
    chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """df with n_tokens, n_known, train_tokens, base_score and score; learn marks the rows to learn from."""
    results = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    bounded_batches(df.sparkSession)
    spark, size = df.sparkSession, input_bytes(df, text_col)
    df = df.select(*(c for c in df.columns if c.lower() not in results or c in (id_col, text_col)))
    chunks, buckets = parts_for(size, chunk_bytes, cores(spark)), parts_for(size * 2, bucket_bytes, cores(spark))
    chunk_col = free_name(df, "_chunk")
    h = doc_hash(id_col, text_col)
    kind = F.when(~F.coalesce(learn, F.lit(False)), SCORED).when(F.pmod(F.xxhash64(h, F.lit("fold")), F.lit(FOLD)) == 0, DELETED).otherwise(LEARN)
    dealt = df.withColumn(chunk_col, (F.pmod(h, F.lit(chunks)) * 3 + kind).cast("long"))
    slim = dealt.select(text_col, chunk_col)

    def counted(triples: bool) -> DataFrame:
        asked = slim.groupBy(chunk_col).applyInArrow(lean(_ask(buckets, chunk_col, text_col, triples)), _SQL)
        return materialise(asked.groupBy("part").applyInArrow(lean(_add_up), _SQL), "triples" if triples else "counts")

    def seen(answers: DataFrame, *more) -> tuple[np.ndarray, np.ndarray]:
        """Cells of deleted documents and their tokens."""
        deleted = slim.where(F.col(chunk_col) % 3 == DELETED).groupBy(chunk_col)
        rows = deleted.cogroup(answers.where(f"chunk % 3 = {DELETED}").groupBy("chunk")).applyInArrow(lean(_cells(chunk_col, text_col, rest, *more)), "cell long, n long")
        table = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        return table["cell"].to_numpy(), table["n"].to_numpy().astype(np.float64)

    answers = counted(False)
    free_shuffles(spark)
    sums = F.split(F.col("data").cast("string"), ",")
    stats = answers.where("chunk < 0").agg(*(F.sum(sums[k].cast("long")) for k in range(3)))
    tokens, distinct, rest = (x or 0 for x in stats.first())
    answers = answers.where("chunk >= 0")
    weights = learn_weights(*seen(answers), distinct)
    free_shuffles(spark)
    answers = answers.union(counted(True))
    free_shuffles(spark)
    of_triples = learn_triples(*seen(answers, distinct, weights))
    free_shuffles(spark)
    carried = [c for c in df.columns if keep_text or c != text_col]
    fields = {f.name: f for f in df.schema.fields}

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            n = [pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())] * 2
        else:
            c, is_deleted = _Chunk(docs, text_col, True), docs[chunk_col][0].as_py() % 3 == DELETED
            words, _ = _counts(answers, WORDS, len(c.word), is_deleted)
            pairs, _ = _counts(answers, PAIRS, len(c.pair), is_deleted)
            triples, _ = _counts(answers, TRIPLES, len(c.triple), is_deleted)
            count, context, longer = words[c.token_at], words[c.before_at], c.pair_context(words, pairs)
            p = _of_pairs(weights, context, *_two(context, pairs[c.pair_at], count, tokens), distinct)
            w = of_triples[_context(longer)]
            p = w[:, 0] * (triples[c.triple_at] / np.maximum(1, longer)) + w[:, 1] * p
            add = lambda x: np.add.reduceat(x, c.first)
            base = add(np.log10((count + 1.0) / (tokens + distinct + 1.0)))
            n = [pa.array(c.n_tokens, pa.int64()), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(base), tokens, np.int64)), pa.array(base), pa.array(add(np.log10(p)))]
        return pa.Table.from_arrays([*(docs[k] for k in carried), *n], names=[*carried, *results])

    schema = T.StructType([*(fields[c] for c in carried), *(T.StructField(k, t) for k, t in results.items())])
    return dealt.groupBy(chunk_col).cogroup(answers.groupBy("chunk")).applyInArrow(lean(work), schema)


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those with remainder 2 are held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    docs = docs.withColumn("held_out", F.coalesce(held, F.lit(False)))
    return score(docs, ~held, keep_text=False)
