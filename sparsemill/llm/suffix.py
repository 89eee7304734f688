r"""Benchmark decontamination with suffix arrays of the training documents.

A window is `window` consecutive words of a benchmark item, or all words of an item that has fewer.
A word of a document is hit if it lies inside any occurrence of a window. Words are runs of digits,
letters a-z (A-Z are lower-cased) and anything beyond ASCII.

Method. Some megabytes of documents form a shard. A shard's suffix array orders its suffixes of
words by prefix doubling, as far as the longest item reaches; suffixes that begin in a run of benchmark words
too short for any window can match none and are left out. Every suffix of every item is searched
in it by binary search, word by word: the range of suffixes that share its first d words is
narrowed to those that share d + 1, for all items at once. The range at a window's length holds all
occurrences of that window; the last range that is not empty gives the longest verbatim match and its places.

Distribution. Documents stay where they are read: no shuffle. Items are cut into blocks of at
most BLOCK_BYTES of text (or one item, if that is longer), whose size is summed before one is broadcast. With one block
the documents are read once; with more, once a block, and only documents that are hit meet in a join.

Defined results: null texts and texts without words hold no words, hit nothing and are not hit; repeated items count once; items
without an id hit words, but are neither counted nor named; repeated rows get equal results; a window that several
items share names all of them; an empty table of documents gives an empty result, one of items no hit; columns
named like the results are replaced, all others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparsemill.llm.common import Words, as_bytes, bounded_batches, in_struct, load, parts_for, slices

WINDOW = 10
#: Text of one shard, and of one block of items.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 8 << 20
#: Of each byte of a lower-cased text, whether it is no part of a word.
BETWEEN = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])

_SPANS = T.ArrayType(T.LongType())
_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("begins", _SPANS), T.StructField("ends", _SPANS), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()), T.StructField("longest_at", T.LongType()), T.StructField("longest_item", T.StringType()), T.StructField("longest_item_at", T.LongType()),
])
_FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string())),
    ("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string()), ("longest_item_at", pa.int64()),
])


# ---------------------------------------------------------------- items and suffix arrays


class Items:
    """A block of items: words as numbers from 1, and the suffixes that begin a window."""

    def __init__(self, ids: list[str | None], texts: list[bytes], window: int = WINDOW):
        words = Words(texts, lower=True, between=BETWEEN)
        h = words.hashes()
        self.ids, self.vocabulary = ids, np.unique(h)
        self.words = np.searchsorted(self.vocabulary, h).astype(np.int64) + 1
        size = np.diff(words.first)
        self.item = words.doc
        self.at = np.arange(len(h)) - words.first[words.doc]
        self.left = size[words.doc] - self.at
        self.need = np.minimum(size, window)[words.doc]
        self.suffixes = np.flatnonzero(self.left >= self.need)
        self.least = int(self.need.min()) if len(h) else 0
        self.longest = int(size.max()) if len(h) else 0


class Shard:
    """The suffix array of some texts, over runs of words that items have."""

    def __init__(self, texts: list[bytes], items: Items):
        self.texts = Words(texts, lower=True, between=BETWEEN)
        n = len(self.texts)
        numbers = np.zeros(n, dtype=np.int64)
        if len(items.vocabulary) and n:
            h = self.texts.hashes()
            at = np.minimum(np.searchsorted(items.vocabulary, h), len(items.vocabulary) - 1)
            numbers = np.where(items.vocabulary[at] == h, at + 1, 0)
        known = numbers > 0
        begin = known.copy()
        begin[1:] &= ~known[:-1] | (self.texts.doc[1:] != self.texts.doc[:-1])
        end = known.copy()
        end[:-1] &= ~known[1:] | (self.texts.doc[1:] != self.texts.doc[:-1])
        first, last = np.flatnonzero(begin), np.flatnonzero(end)
        size = last - first + 1
        first, size = first[size >= items.least], size[size >= items.least]
        # runs one after another, a 0 behind each; place: of each number, its word in the texts
        ends = np.cumsum(size + 1)
        self.place = np.repeat(first - (ends - size - 1), size + 1) + np.arange(ends[-1] if len(ends) else 0)
        self.numbers = np.zeros(len(self.place) + items.longest + 1, dtype=np.int64)
        inside = np.ones(len(self.place), dtype=bool)
        inside[ends - 1] = False
        self.numbers[: len(self.place)][inside] = numbers[self.place[inside]]
        self.order = self._sorted(inside, items.longest)

    def _sorted(self, inside: np.ndarray, reach: int) -> np.ndarray:
        """Suffixes in order of their first `reach` words (as far as their run goes), by prefix doubling."""
        n, rank, step, kinds = len(inside), self.numbers[: len(inside)], 0, -1
        while True:
            key = rank
            if step:
                key = rank * (int(rank.max(initial=0)) + 1)
                key[: max(0, n - step)] += rank[step:]
                key[~inside] = 0  # what is between runs comes first and ends every comparison
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, dtype=np.int64)
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            step = 2 * step or 1
            found = int(new.sum())
            if step >= reach or found == kinds:
                return order[inside[order]]
            kinds = found

    def search(self, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(d, suffixes of items, lo, hi) for d = 1, 2, ...: those whose first d words stand in order[lo:hi], and nowhere else."""
        live, d = items.suffixes, 0
        lo = hi = np.zeros(0, dtype=np.int64)
        while len(live) and len(self.order):
            word = items.words[live + d]
            if d:
                lo, hi = self._bound(lo, hi, d, word), self._bound(lo, hi, d, word + 1)
            else:
                first = self.numbers[self.order]
                lo, hi = np.searchsorted(first, word), np.searchsorted(first, word + 1)
            there = lo < hi
            live, lo, hi, d = live[there], lo[there], hi[there], d + 1
            yield d, live, lo, hi
            more = items.left[live] > d
            live, lo, hi = live[more], lo[more], hi[more]

    def _bound(self, lo: np.ndarray, hi: np.ndarray, d: int, word: np.ndarray) -> np.ndarray:
        """In each order[lo:hi], the first suffix whose word d is not below the given one."""
        lo, hi = lo.copy(), hi.copy()
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            below = (lo < hi) & (self.numbers[self.order[np.minimum(mid, len(self.order) - 1)] + d] < word)
            lo, hi = np.where(below, mid + 1, lo), np.where(below | (lo >= hi), hi, mid)
        return lo


def match(texts: list[bytes], items: Items) -> list[dict]:
    """What a shard of texts has of a block of items: of each text, the hit ranges, the items, and the longest match."""
    shard = Shard(texts, items)
    words = shard.texts
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    pairs, classes = [], []  # (text, class of equal windows), and the items of each class
    longest, place = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), 2), dtype=np.int64)
    for d, live, lo, hi in shard.search(items):
        full = items.need[live] <= d  # suffixes that have reached a window
        if not full.any():
            continue
        live, lo, hi = live[full], lo[full], hi[full]
        low, lead, back = np.unique(lo, return_index=True, return_inverse=True)  # ranges of one length are equal or apart
        high = hi[lead]
        at = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(int((high - low).sum()))
        which, word = np.repeat(np.arange(len(low)), high - low), shard.place[shard.order[at]]
        text = words.doc[word]
        longest[text] = d  # lengths rise, so the last to be written is the longest
        place[text, 0], place[text, 1] = word, live[lead][which]
        new = items.need[live] == d
        if new.any():
            by = np.argsort(back[new], kind="stable")
            names, cuts = np.unique(back[new][by], return_index=True)
            number = np.full(len(low), -1)
            number[names] = len(classes) + np.arange(len(names))
            classes += [np.unique(x) for x in np.split(items.item[live[new][by]], cuts[1:])]
            here = number[which] >= 0
            np.add.at(depth, word[here], 1)
            np.add.at(depth, word[here] + d, -1)
            pairs.append(np.unique(np.stack((text[here], number[which[here]])), axis=1))
    owner, owned = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)
    owned = owned[np.argsort(owner, kind="stable")]
    edges = np.searchsorted(np.sort(owner), np.arange(len(texts) + 1))
    covered = np.cumsum(depth[:-1]) > 0
    out = []
    for x in range(len(texts)):
        a, b = int(words.first[x]), int(words.first[x + 1])
        row = {"n_words": b - a, "begins": [], "ends": [], "items": [], "longest": 0, "longest_at": None, "longest_item": None, "longest_item_at": None}
        if edges[x] < edges[x + 1]:
            turns = np.flatnonzero(np.diff(np.concatenate(([0], covered[a:b].astype(np.int8), [0]))))
            names = {items.ids[k] for k in np.unique(np.concatenate([classes[c] for c in owned[edges[x] : edges[x + 1]]])).tolist()}
            at, suffix = place[x].tolist()
            row |= {"begins": turns[0::2].tolist(), "ends": turns[1::2].tolist(), "items": sorted(n for n in names if n is not None)}
            row |= {"longest": int(longest[x]), "longest_at": at - a, "longest_item": items.ids[items.item[suffix]], "longest_item_at": int(items.at[suffix])}
        out.append(row)
    return out


# ---------------------------------------------------------------- over tables


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Items]:
    """The items in blocks of bounded size, one at a time."""
    slim = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 16), F.lit(0))).first()[0]
    blocks = parts_for(total, block_bytes)
    for k in range(blocks):
        # by text: so an item's name does not change its block
        rows = slim.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("id", "text").toArrow()
        yield Items(rows["id"].to_pylist(), as_bytes(rows["text"]), window)


def _matched(docs: DataFrame, items: Items, text_col: str, shard_bytes: int, drop_text: bool) -> DataFrame:
    """docs with _found; without the text, if it is not asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kept = [f for f in docs.schema.fields if not drop_text or f.name != text_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, shard_bytes):
                found = pa.array(match(as_bytes(part.column(text_col)), shared.value), _FOUND_ARROW)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), found], names=[*(f.name for f in kept), "_found"])

    return docs.mapInArrow(work, T.StructType([*kept, T.StructField("_found", _FOUND)]))


def _united(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows with what other blocks of items have found (more: _key, _found) put together with their own."""
    each = more.groupBy("_key").agg(F.collect_list("_found").alias("_others"))  # one entry a block of items at most
    joined = rows.join(each, "_key", "left")
    fields = [f for f in joined.schema.fields if f.name not in ("_found", "_others", "_key")]

    def one(own: dict, others: list[dict] | None) -> dict:
        every = [own, *(others or [])]
        spans = sorted(s for f in every for s in zip(f["begins"], f["ends"]))
        begins, ends = [], []
        for a, b in spans:
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                begins.append(a)
                ends.append(b)
        best = max(every, key=lambda f: f["longest"])
        return best | {"n_words": own["n_words"], "begins": begins, "ends": ends, "items": sorted({x for f in every for x in f["items"]})}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(own, others) for own, others in zip(b.column("_found").to_pylist(), b.column("_others").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(found, _FOUND_ARROW)], names=[*(f.name for f in fields), "_found"])

    return joined.mapInArrow(work, T.StructType([*fields, T.StructField("_found", _FOUND)]))


def find_matches(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, keep_text: bool = True, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, found_col: str = "found",
) -> DataFrame:
    """docs with a struct found_col: n_words; begins and ends of the hit ranges of words (half-open); items, sorted; the longest verbatim match (longest words, at longest_at, from longest_item at longest_item_at)."""
    bounded_batches(docs.sparkSession)
    carried = [c for c in docs.columns if c.lower() != found_col.lower() and (keep_text or c != text_col)]
    slim = docs.select(F.col(text_col).cast("string").alias("_text"), F.xxhash64(id_col, text_col).alias("_hash"), F.col(id_col).alias("_id"), in_struct(carried))
    found = more = None
    for block in _blocks(items, item_col, item_text_col, window, block_bytes):
        if found is None:
            found = _matched(slim, block, "_text", shard_bytes, True)
        else:  # equal rows have equal matches, so any of them stands for all
            hit = _matched(slim.select("_text", "_hash", "_id"), block, "_text", shard_bytes, True).where(F.size("_found.begins") > 0)
            first = hit.dropDuplicates(["_hash", "_id"]).select(F.struct("_hash", "_id").alias("_key"), "_found")
            more = first if more is None else more.unionByName(first)
    if more is not None:
        found = _united(found.select(F.struct("_hash", "_id").alias("_key"), "_rest", "_found"), more)
    return found.select(*(F.col("_rest").getField(c).alias(c) for c in carried), F.col("_found").alias(found_col))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those in which a window of some item occurs; all columns as they were."""
    marked = find_matches(docs, items, found_col="_decontaminate", **options)
    return marked.where(F.size("_decontaminate.begins") == 0).drop("_decontaminate")


def op11_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of the whole table: hit words and the benchmark items whose windows occur in it."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    done = find_matches(docs, load(spark, sf_dir, "benchmark"), keep_text=False)
    f = F.col("found")
    hit: Column = F.aggregate(F.zip_with(f["ends"], f["begins"], lambda b, a: b - a), F.lit(0).cast("long"), lambda n, x: n + x)
    return done.select(
        "doc_id", f["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(f["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT item_id, w, least(len(w), 10)::BIGINT AS k, unnest(generate_series(1, len(w)::BIGINT - least(len(w), 10)::BIGINT + 1)) AS s FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM q),
p AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w)::BIGINT - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k),
h AS (SELECT doc_id, s, k, item_id FROM (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM p) JOIN v USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS x FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id"""
